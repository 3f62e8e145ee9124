"""Sweeps from one scan against numpy on the rows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import pairs as P
from tessera.operators import scoring as C
from tessera.operators import sweeps as W

NAN = float("nan")


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(3)
    n = 400
    c = {"size": r.normal(size=n), "a": r.normal(size=n), "b": r.exponential(size=n), "c": r.normal(size=n), "lat": r.normal(size=n)}
    c["b"][r.random(n) < 0.2] = NAN
    c["c"][r.random(n) < 0.1] = NAN
    y = c["size"] + 0.5 * c["a"] + np.nan_to_num(c["b"]) + r.normal(size=n)
    t1, t2, t3 = y.copy(), y * 2 + r.normal(size=n), r.normal(size=n)
    t1[r.random(n) < 0.3] = NAN
    t2[:90] = NAN
    c |= {"t1": t1, "t2": t2, "t3": t3}
    c["g"] = r.integers(0, 25, n)
    c["fold"] = np.where(c["g"] < 3, 0, r.integers(0, 5, n))
    rows = [(i, int(c["g"][i]), int(c["fold"][i]), *[None if np.isnan(c[k][i]) else float(c[k][i]) for k in ("size", "a", "b", "c", "lat", "t1", "t2", "t3")]) for i in range(n)]
    return c, spark.createDataFrame(rows, "k long, g long, fold int, size double, a double, b double, c double, lat double, t1 double, t2 double, t3 double")


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    use = s > 1e-9 * np.maximum(1, abs(m))
    z = (x[:, use] - m[use]) / s[use]
    w = np.zeros(x.shape[1])
    w[use] = np.linalg.lstsq(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()), rcond=None)[0] / s[use]
    return lambda v: y.mean() + (v - m) @ w


def imputed(c, names, train, rows, marked=True):
    """Design arrays of the training and the tested rows: medians of the training rows, marks of the columns with nulls anywhere."""
    out = []
    for k in names:
        out.append(np.where(np.isnan(c[k]), np.nanmedian(c[k][train]), c[k]))
    if marked:
        out += [np.isnan(c[k]).astype(float) for k in names if np.isnan(c[k]).any()]
    x = np.array(out).T.reshape(len(c["fold"]), -1)
    return x[train], x[rows]


def penalty(c, x, train, y, alphas, fold):
    if len(alphas) == 1:
        return alphas[0]
    inner = c["fold"][train]

    def loss(alpha):
        return sum(((y[inner == f] - ridge(x[inner != f], y[inner != f], alpha)(x[inner == f])) ** 2).sum() for f in np.unique(inner))

    return min(alphas, key=loss)


def scored(c, t, baseline, block=None, alphas=(0.0,), marked=True, wanted=None, base_alphas=(0.0,)):
    """(n, R2 of the baseline, R2 with the block on what it leaves)."""
    have = ~np.isnan(c[t]) if wanted is None else wanted & ~np.isnan(c[t])
    low, high = np.zeros(len(have)), np.zeros(len(have))
    for f in np.unique(c["fold"][have]):
        train, rows = have & (c["fold"] != f), have & (c["fold"] == f)
        x, v = imputed(c, baseline, train, rows, marked)
        y = c[t][train]
        m = ridge(x, y, penalty(c, x, train, y, base_alphas, f))
        low[rows] = m(v)
        if block is not None:
            left = y - m(x)
            z, u = imputed(c, block, train, rows, marked)
            high[rows] = low[rows] + ridge(z, left, penalty(c, z, train, left, alphas, f))(u)
    y = c[t][have]
    r2 = lambda p: 1 - ((y - p[have]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return have.sum(), r2(low), r2(high)


@pytest.mark.parametrize("alphas", [(0.0,), (0.1, 10.0, 1000.0)])
def test_scopes_and_targets(frame, alphas):
    c, df = frame
    scopes = {"one": ["a"], "gaps": ["b", "c"], "all": ["a", "b", "c", "lat"], "none": ["size"]}
    got = {(r.target, r.scope): r for r in W.scope_sweep(df, ["size"], scopes, ["t1", "t2", "t3"], "fold", alphas).collect()}
    assert len(got) == 12
    for (t, s), r in got.items():
        n, low, high = scored(c, t, ["size"], scopes[s], alphas)
        assert r.n == n and np.isclose(r.r2_baseline, low) and np.isclose(r.r2_full, high, atol=1e-8) and np.isclose(r.lift, high - low, atol=1e-8)


def test_arm_report(frame):
    """Arms on two baselines, by tiers, in random folds and in folds of whole groups."""
    c, df = frame
    df = df.withColumns({"tier": F.when(F.col("k") % 3 == 0, "x").otherwise("y"), "whole": (F.col("g") % 4).cast("int"), "size2": F.col("size") * F.col("size")})
    own = c | {"size2": c["size"] ** 2}
    got = {(r.folds, r.target, r.baseline, r.arm, r.tier): r for r in W.arm_report(df, ["t1", "t3"], {"one": ["a"], "gaps": ["b", "c"]}, {"line": ["size"], "curve": ["size", "size2"]}, {"random": "fold", "groups": "whole"}, "tier", (0.1, 10.0), "size").collect()}
    assert len(got) == 2 * 3 * (2 * 2 * 2 + 2)
    for folds, fold in (("random", c["fold"]), ("groups", c["g"] % 4)):
        now = own | {"fold": fold}
        for baseline, controls in (("line", ["size"]), ("curve", ["size", "size2"])):
            n, low, high = scored(now, "t1", controls, ["b", "c"], (0.1, 10.0))
            r = got[folds, "t1", baseline, "gaps", None]
            assert r.n == n and np.isclose(r.r2_baseline, low) and np.isclose(r.r2_full, high, atol=1e-8) and np.isclose(r.lift, high - low, atol=1e-8)
        n, r2, _ = scored(now, "size", ["a"], base_alphas=(0.1, 10.0))
        assert np.isclose(got[folds, "size", "", "one", None].r2_full, r2, atol=1e-8)
    rows = np.arange(400) % 3 == 0
    inside = got["random", "t3", "line", "one", "x"]
    low, y = np.zeros(400), c["t3"]
    for f in range(5):
        train = c["fold"] != f
        low[~train] = ridge(c["size"][train][:, None], y[train], 0.0)(c["size"][~train][:, None])
    assert inside.n == rows.sum() and np.isclose(inside.r2_baseline, 1 - ((y - low)[rows] ** 2).sum() / ((y[rows] - y[rows].mean()) ** 2).sum())


def test_leave_one_block_out(frame):
    c, df = frame
    got = {r.target: r for r in W.leave_one_out(df, {"A": ["a", "t3"], "B": ["b", "c"]}, ["size"], {"A": ["t3"], "B": ["b"]}, "fold", (1.0,)).collect()}
    for t, others in (("t3", ["b", "c"]), ("b", ["a", "t3"])):
        n, low, high = scored(c, t, ["size"], others, (1.0,))
        assert got[t].n == n and np.isclose(got[t].r2_baseline, low) and np.isclose(got[t].lift, high - low, atol=1e-8)


def test_drop_one_and_twins(frame):
    c, df = frame
    models = W.drop_one_models(["size"], {"A": ["a"], "B": ["b", "c"]}, ["lat"], [("A", "B")], {"proxy": ("A", ["c"])})
    by_name = {m.name: m for m in models}
    for block in "AB":
        twin = by_name[f"full_places_drop_{block}"]
        assert twin.family == "places" and "lat" in twin.columns and twin.reference == "full_places" and twin.withheld == block and "lat" not in by_name[f"full_drop_{block}"].columns
    assert by_name["full_no_proxy"].columns == ("size", "a", "b") and by_name["full_drop_A_no_proxy"].reference == "full_no_proxy"
    assert by_name["size_places"].columns == ("size", "lat") and by_name["mean"].columns == () and by_name["full_drop_A_B"].columns == ("size",)
    scores = W.drop_one(df, models, ["t1", "t2"], "fold", (0.1, 10.0), {"t2": ["a"]})
    got = {(r.target, r.model): r for r in scores.collect()}
    for (t, name), r in got.items():
        m = by_name[name]
        n, r2, _ = scored(c, t, m.columns, base_alphas=(0.1, 10.0))
        less = [k for k in m.columns if not (t == "t2" and k == "a")]
        ablated = scored(c, t, less, base_alphas=(0.1, 10.0))[1]
        assert r.n == n and np.isclose(r.r2, r2, atol=1e-8) and np.isclose(r.r2_ablated, ablated, atol=1e-8)
        if m.reference:
            assert np.isclose(r.contribution, got[t, m.reference].r2 - r.r2) and np.isclose(r.contribution_ablated, got[t, m.reference].r2_ablated - r.r2_ablated)
    both = {r.withheld: r for r in W.twins(scores).collect()}
    want = np.mean([got[t, "full_places_drop_B"].contribution_ablated for t in ("t1", "t2")])
    assert set(both) == {"A", "B"} and both["B"].n_targets == 2 and np.isclose(both["B"].places, want)


@pytest.mark.parametrize("alphas", [(0.0,), (5.0,), (0.1, 50.0)])
def test_group_effects_equal_dummies(frame, alphas):
    c, df = frame
    got = {r.model: r for r in W.group_effects(df, {"two": ["size", "a"], "none": []}, "t3", "fold", "g", alphas).collect()}

    def fit(train, alpha, names):
        x, y, g = np.array([c[k] for k in names]).T.reshape(len(c["g"]), -1)[train], c["t3"][train], c["g"][train]
        known = np.unique(g)
        d = (g[:, None] == known).astype(float)
        s = x.std(0)
        z = np.hstack([x / s, d])
        keep = np.diag([alpha] * x.shape[1] + [0.0] * len(known))
        w = np.linalg.lstsq(z.T @ z + keep, z.T @ y, rcond=None)[0]
        slope, effect = w[: x.shape[1]] / s, dict(zip(known, w[x.shape[1] :]))
        mean = np.mean([effect[v] for v in g])
        return lambda rows: np.array([c[k] for k in names]).T.reshape(len(c["g"]), -1)[rows] @ slope + np.array([effect.get(v, mean) for v in c["g"][rows]])

    for name, names in (("two", ["size", "a"]), ("none", [])):
        sse = 0.0
        for f in range(5):
            train, rows, best = c["fold"] != f, c["fold"] == f, alphas[0]
            if len(alphas) > 1:
                best = min(alphas, key=lambda a: sum(((c["t3"][c["fold"] == h] - fit(train & (c["fold"] != h), a, names)(c["fold"] == h)) ** 2).sum() for h in range(5) if h != f))  # noqa: B023
            sse += ((c["t3"][rows] - fit(train, best, names)(rows)) ** 2).sum()
        assert got[name].n == 400 and got[name].n_groups == 25 and np.isclose(got[name].r2, 1 - sse / ((c["t3"] - c["t3"].mean()) ** 2).sum(), atol=1e-8)


def test_samples_of_several_sizes(frame):
    c, df = frame
    shares = [0.4, 0.8]
    drawn = W.sampled(df, "k", shares, 3).select("k", "_round", "_step").collect()
    got = {(r.target, r.share, r.round): r for r in W.size_rounds(df, "k", ["size"], ["size", "a", "lat"], ["t1", "t2"], "fold", shares, 3, (0.0,)).collect()}
    assert len(got) == 12
    for (t, share, k), r in got.items():
        wanted = np.zeros(400, bool)
        wanted[[x.k for x in drawn if x._round == k and x._step <= shares.index(share)]] = True
        assert abs(wanted.mean() - share) < 0.1
        n, low, _ = scored(c, t, ["size"], wanted=wanted)
        high = scored(c, t, ["size", "a", "lat"], wanted=wanted)[1]
        assert r.n == n and np.isclose(r.r2_baseline, low, atol=1e-8) and np.isclose(r.lift, high - low, atol=1e-8)


def test_grain_arms(frame):
    c, df = frame
    coarse = df.groupBy("g", "fold").agg(*[F.avg(k).alias(k) for k in ("size", "a", "t3")])
    got = {r.arm: r for r in W.grain_arms(df, coarse, "k", ["size"], ["size", "a"], ["t3"], "fold", 4).collect()}
    rounds = W.size_rounds(df, "k", ["size"], ["size", "a"], ["t3"], "fold", [coarse.count() / 400], 4).collect()
    assert set(got) == {"fine", "coarse", "fine_sample"} and got["fine"].n == 400 and got["coarse"].n == coarse.count()
    assert np.isclose(got["fine"].lift, scored(c, "t3", ["size", "a"])[1] - scored(c, "t3", ["size"])[1])
    assert np.isclose(got["fine_sample"].lift, np.mean([r.lift for r in rounds])) and np.isclose(got["fine_sample"].sd, np.std([r.lift for r in rounds], ddof=1))


def test_block_scores_with_nulls(frame):
    """Arms and marginals keep all rows with a target; each fold fills with its own training medians."""
    c, df = frame
    got = C.arms(df, ["size"], {"gaps": ["b", "c"]}, "t1", "fold", (2.0,)).first()
    n, low, high = scored(c, "t1", ["size"], ["b", "c"], (2.0,))
    assert got["n"] == n and np.isclose(got["r2_baseline"], low) and np.isclose(got["lift"], high - low, atol=1e-8)
    got = C.marginal(df, "k", ["size"], ["b", "a"], "t1", "fold", (0.0,), turns=3).first()
    high = scored(c, "t1", ["size", "b", "a"])[1]
    assert got["n"] == n and np.isclose(got["r2_full"], high, atol=1e-8)
    rows = M.shuffles(df.where("t1 IS NOT NULL"), "k", ["b", "a"], [1, 2, 3]).select("turn", "k", "b", "a").collect()
    lifts = []
    for turn in (1, 2, 3):
        own = {k: v.copy() for k, v in c.items()}
        for r in rows:
            if r.turn == turn:
                own["b"][r.k], own["a"][r.k] = (NAN if r.b is None else r.b), r.a
        lifts.append(scored(own, "t1", ["size", "b", "a"])[1] - low)
    assert np.isclose(got["null_lift_mean"], np.mean(lifts), atol=1e-8)


def test_pair_tests_on_the_same_draws(frame):
    c, df = frame
    xs, ys, rounds, size = ["a", "b", "size"], ["t1", "t3"], 60, 100
    got = {(r.x, r.y): r for r in P.pair_tests(df, "k", xs, ys, rounds, rows=size).collect()}
    placed = df.select("k", P.blocks(df, "k", size).alias("block"), F.xxhash64("k", F.lit(43)).alias("h")).orderBy("h").collect()
    order = {}
    for r in placed:
        order.setdefault(r.block, []).append(r.k)
    assert len(order) == 4

    def r_of(x, y):
        both = ~np.isnan(x) & ~np.isnan(y)
        return np.corrcoef(x[both], y[both])[0, 1], both.sum()

    ps = {}
    for x in xs:
        for y in ys:
            seen, n = r_of(c[x], c[y])
            hits = 0
            for k in range(1, rounds + 1):
                moved = c[y].copy()
                for b, own in order.items():
                    moved[own] = c[y][np.array(own)[P.draw(k, b, len(own))]]
                hits += abs(r_of(c[x], moved)[0]) >= abs(seen) - 1e-12
            ps[x, y] = (hits + 1) / (rounds + 1)
            assert got[x, y].n == n and np.isclose(got[x, y].r, seen) and np.isclose(got[x, y].p, ps[x, y])
    low, m = 1.0, len(ps)
    for place, (pair, p) in reversed(list(enumerate(sorted(ps.items(), key=lambda v: v[1]), 1))):
        low = min(low, p * m / place)
        assert np.isclose(got[pair].q, low)
    top = P.top_of_each(P.pair_tests(df, "k", xs, ys, 1), most=2).collect()
    assert sorted((r.y, r.place) for r in top) == [("t1", 1), ("t1", 2), ("t3", 1), ("t3", 2)]


def test_constant_columns_have_no_r(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), None) for i in range(20)], "k long, c double, x double, e double")
    got = {r.x: r for r in P.pair_tests(df, "k", ["c", "x", "e"], ["x"], 9).collect()}
    assert got["c"].r is None and got["c"].p is None and got["c"].q is None and np.isclose(got["x"].r, 1) and got["x"].q is not None and got["e"].n == 0


def test_mantel_on_the_same_draws(spark):
    r = np.random.default_rng(1)
    n, rounds, size = 90, 40, 30
    a = r.normal(size=(n, 4))
    b = a[:, :2] + r.normal(size=(n, 2)) * 2
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(n)] + [(n, None, [1.0, 2.0])], "k long, a array<double>, b array<double>")
    got = P.mantel(df, "k", "a", "b", rounds=rounds, rows=size).first()
    placed = df.where("a is not null").select("k", F.pmod(F.xxhash64("k", F.lit(42)), F.lit(3)).alias("block"), F.xxhash64("k", F.lit(43)).alias("h")).orderBy("h").collect()
    order = {}
    for x in placed:
        order.setdefault(x.block, []).append(x.k)
    x, y = P.distances(a, a, "cosine"), P.distances(b, b, "euclidean")
    pairs = np.triu_indices(n, 1)
    corr = lambda y: np.corrcoef(x[pairs], y[pairs])[0, 1]
    hits = 0
    for k in range(1, rounds + 1):
        to = np.arange(n)
        for block, own in order.items():
            to[own] = np.array(own)[P.draw(k, block, len(own))]
        hits += corr(y[np.ix_(to, to)]) >= corr(y) - 1e-9
    assert (got.n_units, got.n_pairs) == (n, n * (n - 1) // 2) and np.isclose(got.r, corr(y)) and np.isclose(got.p, (hits + 1) / (rounds + 1))


def test_silhouettes_by_definition(spark):
    r = np.random.default_rng(2)
    v = np.vstack([r.normal(size=(30, 3)), r.normal(size=(20, 3)) + 4, [[9, 9, 9]]])
    labels = {"two": (np.arange(51) >= 30).astype(int), "alone": np.minimum(np.arange(51) // 25, 2), "one": np.zeros(51, int)}
    rows = [(v[i].tolist(), *[None if n == "two" and i == 7 else int(x[i]) for n, x in labels.items()]) for i in range(51)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 0)], "v array<double>, two int, alone int, one int")
    got = {x.labelling: x for x in P.silhouettes(df, "v", {n: n for n in labels}).collect()}
    for name, own in labels.items():
        use = np.array([i for i in range(51) if not (name == "two" and i == 7)])
        d = ((v[use][:, None] - v[use][None]) ** 2).sum(2)
        lab, s = own[use], []
        for i in range(len(use)):
            same = (lab == lab[i]) & (np.arange(len(use)) != i)
            others = [d[i, lab == k].mean() for k in np.unique(lab) if k != lab[i]]
            if others:
                s.append((min(others) - d[i, same].mean()) / max(min(others), d[i, same].mean()) if same.any() else 0.0)
        assert got[name].n == len(use) and got[name].k == len(np.unique(lab))
        assert got[name].silhouette is None if not s else np.isclose(got[name].silhouette, np.mean(s))


def test_nearest_by_cells(spark, monkeypatch):
    """All pairs give the same, for clusters, for vectors spread evenly, for a group of one and for copies."""
    from tessera.operators import nearest as N

    monkeypatch.setattr(N, "ROWS", 60)
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 5))
    v = np.vstack([centres[r.integers(0, 12, 500)] + 0.05 * r.normal(size=(500, 5)), r.normal(size=(150, 5)), [[0.0] * 5], [[1.0, 0, 0, 0, 0]] * 2])
    g = ["a"] * 500 + ["b"] * 150 + ["b", "c", "d"]
    rows = [(i, x, v[i].tolist()) for i, x in enumerate(g)] + [(900, None, [1.0] * 5), (901, "a", None), (902, "a", v[3].tolist())]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    got = {x.k: x.best for x in N.nearest(df, "k", "v", "g").collect()}
    v, g, ids = np.vstack([v, v[3:4]]), [*g, "a"], [*range(653), 902]
    norm = np.linalg.norm(v, axis=1)
    u = v / np.where(norm > 0, norm, 1)[:, None]
    for i, k in enumerate(ids):
        others = [j for j in range(len(ids)) if j != i and g[j] == g[i] and norm[j] > 0]
        if norm[i] > 0 and others:
            assert np.isclose(got.pop(k), (u[others] @ u[i]).max()), k
    assert not got


def test_nearest_writes_no_row_for_a_vector_and_a_cell(spark, monkeypatch):
    """A block names the cells that its vectors need, each once; several blocks and hot cells give what one product of matrices does."""
    from tessera.operators import nearest as N

    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "BLOCK", 150)
    r = np.random.default_rng(3)
    v = np.vstack([r.normal(size=(500, 6)), np.tile([[1.0, 0, 0, 0, 0, 0]], (100, 1)) + 1e-3 * r.normal(size=(100, 6))])
    df = spark.createDataFrame([(i, "a", x.tolist()) for i, x in enumerate(v)], "k long, g string, v array<double>")
    got = {x.k: x.best for x in N.nearest(df, "k", "v", "g").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T - 9 * np.eye(len(u))
    assert len(got) == len(v) and np.allclose([got[i] for i in range(len(v))], near.max(axis=1))
    points = pd.DataFrame({"g": "a", "id": range(600), "v": list(u), "n": 600, "cell": -1, "best": near.max(axis=1)})
    pivots = pd.DataFrame({"g": "a", "cell": range(30), "v": list(u[:30]), "n": 600, "radius": 3.0})
    assert sorted(N.visits(("a", 0), points, pivots)["cell"]) == list(range(30))


@pytest.mark.parametrize("kinds", [("cosine", "euclidean"), ("euclidean", "cosine")])
def test_mantel_turns_columns_as_it_turns_distances(spark, kinds):
    """All rounds by one product of matrices, and cells of several blocks, against every round's own distances."""
    r = np.random.default_rng(4)
    u1, u2, y = P.unit(r.normal(size=(7, 3))), P.unit(r.normal(size=(5, 3))), r.random(size=(7, 5))
    u1[2] = 0
    orders = tuple(np.stack([r.permutation(n) for _ in range(6)]) for n in (7, 5))
    assert np.allclose(P.turned_cosines(u1, u2, y, orders), P.turned(1 - u1 @ u2.T, y, orders))
    a = r.normal(size=(200, 3))
    df = spark.createDataFrame([(i, x.tolist(), (x[:2] + r.normal(size=2)).tolist()) for i, x in enumerate(a)], "k long, a array<double>, b array<double>")
    one, many = (P.mantel(df, "k", "a", "b", kinds, 20, rows=20, together=n).first() for n in (1, 3))
    assert one.n_pairs == many.n_pairs == 200 * 199 // 2 and np.isclose(one.r, many.r) and one.p == many.p
