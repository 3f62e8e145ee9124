"""Scores, folds and resampling against plain numpy on the same rows; draws by their invariants."""

import math

import numpy as np
import pytest

from tessera.functions import distributions as D
from pyspark.sql import functions as F
from test_sweeps import scored

from tessera.operators import models as M
from tessera.operators import regional as R
from tessera.operators import scoring as C
from tessera.operators.ordered import numbered
from tessera.operators import statistics as ST
from tessera.operators.statistics import uniform
from tessera.plans import catalog
from tessera.plans.evaluation import panel as old_panel
from tessera.plans.evaluation import units
from tessera.plans.registry import Tables
from tessera.plans.scores import TIERS, intervals, panel, vectors


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def p(t):
    return panel(t).toPandas().sort_values("k").reset_index(drop=True)


def ridge(x, y, alpha):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-9, sd, np.inf)
    z = (x - mean) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]) + 1e-12 * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: y.mean() + (v - mean) / sd @ b


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def oof(x, y, fold, alpha=0.0):
    out = np.empty(len(y))
    for f in np.unique(fold):
        out[fold == f] = ridge(x[fold != f], y[fold != f], alpha)(x[fold == f])
    return out


def oof_residual(x, z, y, fold, alpha, tiers=None):
    out = np.empty(len(y))
    for f in np.unique(fold):
        a, b = fold != f, fold == f
        base = ridge(x[a], y[a], 0.0)
        left, got = y[a] - base(x[a]), base(x[b])
        for level in [None] if tiers is None else np.unique(tiers):
            inside, here = (np.ones(a.sum(), bool), np.ones(b.sum(), bool)) if tiers is None else (tiers[a] == level, tiers[b] == level)
            if tiers is None or inside.sum() >= 20:
                got[here] += ridge(z[a][inside], left[inside], alpha)(z[b][here])
        out[b] = got
    return out


def test_arms(t, p):
    y, fold, x, z = p["y"].to_numpy(), p["fold"].to_numpy(), p[["size"]].to_numpy(), p[["n", "bal"]].to_numpy()
    got = {(r["arm"], r["tier"]): r for r in C.arms(panel(t), ["size"], {"both": ["n", "bal"]}, "y", "fold", (2.0,), "tier").collect()}
    full, alone, base = oof_residual(x, z, y, fold, 2.0), oof(z, y, fold, 2.0), oof(x, y, fold)
    assert got["both", None]["lift"] == pytest.approx(r2(y, full) - r2(y, base), abs=1e-9)
    assert got["both", None]["r2_alone"] == pytest.approx(r2(y, alone), abs=1e-9)
    for level in TIERS:
        k = (p["tier"] == level).to_numpy()
        assert got["both", level]["lift"] == pytest.approx(r2(y[k], full[k]) - r2(y[k], base[k]), abs=1e-8)


def test_chosen_penalty_and_tiers(t, p):
    y, fold, x, z, tiers = p["y"].to_numpy(), p["fold"].to_numpy(), p[["size"]].to_numpy(), p[["n", "bal"]].to_numpy(), p["tier"].to_numpy()
    cells = C.cross_products(panel(t), ["size", "n", "bal", "y"], ["fold", "tier"])
    want = r2(y, oof_residual(x, z, y, fold, 3.0, tiers))
    assert C.r2_of(cells, "y", C.residual_by_tier(cells, ["size"], ["n", "bal"], "y", (3.0,), least=20))[1] == pytest.approx(want, abs=1e-8)
    alphas = (0.1, 10.0, 1000.0)
    out = np.empty(len(y))
    for f in range(5):
        a = fold != f
        best = min(alphas, key=lambda al: ((y[a] - oof(z[a], y[a], fold[a], al)) ** 2).sum())
        out[~a] = ridge(z[a], y[a], best)(z[~a])
    assert C.r2_of(cells, "y", C.linear(cells, ["n", "bal"], "y", alphas))[1] == pytest.approx(r2(y, out), abs=1e-8)


def test_reduction_inside_folds(t):
    e, names = vectors(t)
    d = e.toPandas()
    v, y, fold, size = d[names].to_numpy(), d["y"].to_numpy(), d["fold"].to_numpy(), d[["size"]].to_numpy()
    out = np.empty(len(y))
    for f in range(5):
        a = fold != f
        mean = v[a].mean(axis=0)
        parts = np.linalg.svd(v[a] - mean, full_matrices=False)[2][:4]
        low = lambda k: np.hstack([size[k], (v[k] - mean) @ parts.T])
        out[~a] = ridge(low(a), y[a], 5.0)(low(~a))
    found = C.cross_products(e, ["size", *names, "y"], ["fold"])
    assert C.r2_of(found, "y", C.reduced(found, ["size"], names, "y", 4, (5.0,)))[1] == pytest.approx(r2(y, out), abs=1e-7)


def test_marginal_and_its_nulls(t, p):
    y, fold = p["y"].to_numpy(), p["fold"].to_numpy()
    got = C.marginal(panel(t), "k", ["size"], ["n", "bal"], "y", "fold", (0.0,), turns=9, ablate=("n",)).first()
    low, high = r2(y, oof(p[["size"]].to_numpy(), y, fold)), r2(y, oof(p[["size", "n", "bal"]].to_numpy(), y, fold))
    assert (got["r2_reduced"], got["r2_full"]) == pytest.approx((low, high), abs=1e-9)
    assert got["lift_ablated"] == pytest.approx(r2(y, oof(p[["size", "bal"]].to_numpy(), y, fold)) - low, abs=1e-9)
    assert got["p"] == 0.1 and got["null_lift_mean"] < 0.1 * got["lift"] and got["n"] == len(p)


def test_partial_effects_and_gradient(t, p):
    got = {r["column"]: r for r in C.partial_effects(panel(t), ["n", "bal"], "y", ["size"], "g").collect()}
    x = np.hstack([np.ones((len(p), 1)), p[["size"]].to_numpy(), np.array([p["g"] == g for g in sorted(set(p["g"]))[1:]], float).T])
    left = lambda v: v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    ey = left(p["y"].to_numpy())
    free = len(p) - np.linalg.matrix_rank(x) - 1
    for c in ("n", "bal"):
        ex = left(p[c].to_numpy())
        r = ex @ ey / math.sqrt(ex @ ex * (ey @ ey))
        assert got[c]["partial_r"] == pytest.approx(r, abs=1e-9) and got[c]["effect"] == pytest.approx(ex @ ey / (ex @ ex), rel=1e-8)
        assert got[c]["p"] == pytest.approx(2 * D.t_sf(abs(r) * math.sqrt(free / (1 - r * r)), free), rel=1e-6)
    assert got["n"]["q"] == pytest.approx(min(got["bal"]["p"] if got["bal"]["p"] > got["n"]["p"] else 1, 2 * min(got["n"]["p"], got["bal"]["p"]) if got["n"]["p"] < got["bal"]["p"] else got["n"]["p"]), rel=1e-9)
    y = p["y"].to_numpy()
    flags = np.array([p["tier"] == level for level in TIERS[1:]], float).T
    one = np.ones((len(p), 1))
    raw, left_ = (np.linalg.lstsq(np.hstack(m), y, rcond=None)[0] for m in ((one, flags), (one, flags, p[["size"]].to_numpy())))
    for i, r in enumerate(C.tier_gradient(panel(t), "y", "tier", TIERS, "size").collect()):
        assert (r["raw"], r["controlled"]) == pytest.approx((raw[i + 1], left_[i + 1]), abs=1e-9)


def test_intervals(t, spark):
    got = {(r["arm"], r["against"]): r for r in intervals(t).collect()}
    assert all(r["low"] <= r["high"] and r["covers_zero"] == (r["low"] <= 0 <= r["high"]) for r in got.values())
    arms = sorted({a for a, b in got if b is None})
    for a in arms:
        for b in arms:
            if a < b:
                assert got[a, b]["point"] == pytest.approx(got[a, None]["point"] - got[b, None]["point"])
    whole = spark.createDataFrame([(k, arm, float(k * k) + (arm == "a")) for k in range(9) for arm in "ab"], "target int, arm string, v double")
    shifted = C.score_intervals(whole, "target", "arm", "v", rounds=50).where("against is not null").first()
    assert [shifted[c] for c in ("low", "high", "point")] == pytest.approx([1.0] * 3)  # the targets' own differences cancel in each draw
    with pytest.raises(ValueError):
        C.score_intervals(spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (1, "b", 1.0)], "t int, a string, v double"), "t", "a", "v")
    r = catalog.QUERIES["q113_row_bootstrap"](spark, t.dir).first()
    assert r["low"] < r["point"] < r["high"]
    small = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 7) + 0.5 * (i % 3)) for i in range(60)], "k long, y double, a double, b double")
    got = C.row_bootstrap(small, "k", "y", "a", "b", rounds=40).first()
    u = {(x.k, x._k): x.u for x in small.select("k", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("_k")).select("k", "_k", uniform(F.col("k"), F.col("_k"), F.lit(42)).alias("u")).collect()}
    steps, data = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]), np.array([tuple(x) for x in small.orderBy("k").collect()])
    y, a, b = data[:, 1:].T
    lead = lambda w: ((w * (y - a) ** 2).sum() - (w * (y - b) ** 2).sum()) / ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum())
    leads = [lead(np.array([(u[i, k] >= steps).sum() for i in range(60)])) for k in range(1, 41)]
    assert (got["point"], got["low"], got["high"]) == pytest.approx((lead(np.ones(60)), *np.quantile(leads, [0.025, 0.975])))


def test_temporal_and_size(t, p):
    got = {r["column"]: r for r in C.size_explained(panel(t), ["size"], ["n"], "fold").collect()}
    x, fold, n = p["size"].to_numpy(), p["fold"].to_numpy(), p["n"].to_numpy()
    assert got["n"]["linear_r2"] == pytest.approx(max(0, r2(n, oof(x[:, None], n, fold))), abs=1e-8)
    assert got["n"]["curve_r2"] == pytest.approx(max(0, r2(n, oof(np.stack([x, x**2, x**3], axis=1), n, fold))), abs=1e-4)


def test_older_queries_against_numpy(t, spark, sf_dir):
    """The queries on models that SQL has no words for."""
    d = old_panel(t).toPandas().sort_values("k").reset_index(drop=True)
    y, fold = d["y"].to_numpy(), d["fold"].to_numpy()
    rows = {n: catalog.QUERIES[n](spark, sf_dir).collect() for n in ("q86_ridge_oof", "q87_drop_one", "q88_placebo", "q89_noise_floor", "q93_permutation_p", "q94_bootstrap_ci", "q95_flexible_baseline", "q96_training_size", "q97_grain")}
    columns = {k: d[k].to_numpy(dtype=float) for k in ("size", "n", "gap", "y")} | {"fold": fold}
    arms = {"size": ["size"], "size_bal": ["size", "gap"], "all": ["size", "n", "gap"]}
    for r in rows["q86_ridge_oof"]:
        n, want, _ = scored(columns, "y", arms[r["model"]], base_alphas=(0.1, 1.0, 10.0, 100.0))
        assert r["n"] == n == len(d) and r["r2"] == pytest.approx(want, abs=2e-6)
    groups = {r["g"]: r["fold"] for r in M.group_folds(old_panel(t), "g", 5).collect()}
    by_nation = d["g"].map(groups).to_numpy()
    full = {"full": ["size", "n", "bal"], "without_size": ["n", "bal"], "without_count": ["size", "bal"], "without_balance": ["size", "n"]}
    for r in rows["q87_drop_one"]:
        assert r["r2"] == pytest.approx(r2(y, oof(d[full[r["model"]]].to_numpy(), y, by_nation)), abs=2e-6)
    real = next(r for r in rows["q88_placebo"] if r["model"] == "real")
    assert {r["n"] for r in rows["q88_placebo"]} == {len(d)} and real["r2"] == pytest.approx(r2(y, oof(d[["size", "n"]].to_numpy(), y, fold)), abs=2e-6)
    assert all(r["r2"] < real["r2"] - 0.1 for r in rows["q88_placebo"] if r["model"] != "real")
    noise = {r["model"]: r["r2"] for r in rows["q89_noise_floor"]}
    drawn = old_panel(t).withColumns(M.gaussian(4, "k", 1)).toPandas().sort_values("k")
    assert noise["size"] == pytest.approx(r2(y, oof(d[["size"]].to_numpy(), y, fold)), abs=2e-6)
    assert noise["noise"] == pytest.approx(r2(y, oof(drawn[["size", *[f"noise_{i}" for i in range(4)]]].to_numpy(), y, fold)), abs=2e-6)
    [perm] = rows["q93_permutation_p"]
    r = np.corrcoef(d["n"], d["bal"])[0, 1]
    assert perm["r"] == pytest.approx(r, abs=1e-6) and 0.01 <= perm["p"] <= 1
    ns = units(t).select("k", "n", "bal")
    first = [x.k for x in numbered(ns, "k", 42).orderBy("position").collect()]
    rounds = numbered(ns.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(99)))), "k", 42, ["_k"]).select("_k", "position", "k").collect()
    n_of, bal_of = dict(zip(d["k"], d["n"])), dict(zip(d["k"], d["bal"]))
    own = {k: [0] * len(d) for k in range(1, 100)}
    for x in rounds:
        own[x._k][x.position] = bal_of[x.k]
    base = [n_of[k] for k in first]
    hits = sum(abs(np.corrcoef(base, v)[0, 1]) >= abs(r) - 1e-12 for v in own.values())
    assert perm["p"] == pytest.approx((hits + 1) / 100)
    [boot] = rows["q94_bootstrap_ci"]
    half = 1.96 * d["bal"].std() / math.sqrt(len(d))
    assert boot["mean"] == pytest.approx(d["bal"].mean()) and abs(boot["low"] - boot["mean"] + half) < 0.4 * half and abs(boot["high"] - boot["mean"] - half) < 0.4 * half
    flexible = {r["model"]: r["r2"] for r in rows["q95_flexible_baseline"]}
    x = d[["size", "n", "bal"]].to_numpy()
    assert flexible["linear"] == pytest.approx(r2(y, oof(x, y, fold)), abs=2e-6)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    curves = np.hstack([z, z**2, z**3, z[:, :1] * z[:, 1:2], z[:, :1] * z[:, 2:], z[:, 1:2] * z[:, 2:]])
    assert flexible["flexible"] == pytest.approx(r2(y, oof(curves, y, fold)), abs=1e-3)
    sizes = {r["model"]: r["n"] for r in rows["q96_training_size"]}
    assert sizes == {f"n{k}": min(k, len(d)) for k in (60, 200, 600)}
    grain = {r["model"]: r for r in rows["q97_grain"]}
    assert grain["unit"]["r2"] == pytest.approx(r2(y, oof(d[["size", "n"]].to_numpy(), y, fold)), abs=2e-6) and grain["nation"]["n"] == d["g"].nunique()
    sample = [r["c_custkey"] for r in R.keyed_sample(t.customer.repartition(7), "c_custkey", 20).collect()]
    assert sorted(sample) == sorted(r["c_custkey"] for r in R.keyed_sample(t.customer, "c_custkey", 20).collect())
    markets = {r["unit"]: r["market"] for r in catalog.QUERIES["q91_kmeans_markets"](spark, sf_dir).collect()}
    lat, lon = np.radians(np.arange(25) * 6.5 - 80), np.radians(np.arange(25) * 13.7 - 170)
    at = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    label = np.array([markets[i] for i in range(25)])
    centres = np.array([at[label == k].mean(axis=0) for k in sorted(set(label))])
    assert len(centres) == 5 and (((at[:, None] - centres) ** 2).sum(2).argmin(1) == np.searchsorted(sorted(set(label)), label)).all()  # each unit is with the nearest centre


def test_introductions_against_plain_regex(t, spark, sf_dir):
    import re

    from tessera.functions import text as T

    texts = {r["doc_id"]: r["text"] for r in t.documents.collect()}
    for r in catalog.QUERIES["q41_introduction_features"](spark, sf_dir).collect():
        text, own = texts[r["doc_id"]], f"Nation{r['doc_id'] % 7}, State"
        years = [int(y) for y in re.findall(T.FOUNDING, text)]
        assert r["founded"] == (min(years) if years else None)
        at = text.lower().find("nation" + str(r["doc_id"] % 7))
        rest = re.sub(f"nation{r['doc_id'] % 7}", "", text[max(at, 0) :], flags=re.I)
        rest = re.sub(r"\bstate\b", "", rest, flags=re.I)
        assert r["n_chars"] == len(re.sub(r"[ \t\n\x0B\f\r]+", " ", re.sub(r"^[\s,.;:()-]+", "", rest)).strip(" ")), r["doc_id"]
        assert r["n_names"] == len(set(re.findall(r"\b([A-Z][a-z]{2,})\b", text)) - set(T.COMMON_NAMES) - set(re.findall(r"[A-Za-z]+", own)))
        for name, pattern in (T.INSTITUTION | T.TRANSPORT).items():
            assert r[name] == bool(re.search(pattern, text)), (name, r["doc_id"])


def test_components_of_whole_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    assert x.shape[1] == 64
    x -= x.mean(axis=0)
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:2].T
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in catalog.QUERIES["q90_pca_scores"](spark, sf_dir).collect()}
    have = np.array([got[r["vec_id"]] for r in rows])
    for k in range(2):
        assert min(np.abs(have[:, k] - want[:, k]).max(), np.abs(have[:, k] + want[:, k]).max()) < 1e-4


def test_buckets_adapt_to_offset_and_spread(spark, monkeypatch):
    from tessera.operators import ordered as O

    monkeypatch.setattr(O, "ROWS", 5_000)
    df = spark.range(200_000).select((F.col("id") + 1_700_000_000).cast("double").alias("epoch"), (F.lit(1e6) + F.rand(1) * 1e-3).alias("noise"), F.exp(F.randn(2) * 5).alias("wide"))
    for c in df.columns:
        sizes = [r[0] for r in O.with_bucket(df, c, O.splitters(df, c)).groupBy("_b").count().select("count").collect()]
        assert len(sizes) >= 38 and max(sizes) <= 2 * 5_000, (c, max(sizes))
    below = O.cumulative(df, "epoch").agg(F.max(F.abs(F.col("below") - (F.col("epoch") - 1_700_000_000)))).first()[0]
    assert below == 0
    monkeypatch.setattr(O, "SPLITTERS", 8)  # fewer than needed: stretches between splitters are cut evenly
    at, parts = O.splitters(df, "epoch")
    sizes = O.with_bucket(df, "epoch", (at, parts)).groupBy("_b").agg(F.count("*").alias("n"), F.min("epoch").alias("a"), F.max("epoch").alias("b")).orderBy("_b").collect()
    assert parts == 5 and max(r.n for r in sizes) <= 2 * 5_000 and all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    numbers = O.numbered(df.withColumn("k", F.col("epoch")), "k", 3)
    assert numbers.select("position").distinct().count() == 200_000 and numbers.agg(F.max("position")).first()[0] == 199_999


def test_signed_ranks_with_ties(spark):
    import itertools

    for values in ([1, -1, 2, 2, -3], [1, 1, 1, 1], [-2, 4, 4, -4, 5, 6, 0, 0], []):
        d = [v for v in values if v]
        size = sorted(map(abs, d))
        ranks = [size.index(abs(v)) + (size.count(abs(v)) + 1) / 2 for v in d]
        w = sum(r for v, r in zip(d, ranks) if v > 0)
        every = [sum(r for s, r in zip(signs, ranks) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        want = min(1.0, 2 * min(np.mean([x <= w for x in every]), np.mean([x >= w for x in every])))
        got = ST.signed_rank_test(spark.createDataFrame([(float(v),) for v in values], "d double"), "d").first()
        assert (got["n"], got["w_plus"]) == (len(d), w) and got["p"] == pytest.approx(want)


def grown(x, y, rows, leaf, depth):
    """The best split of variance by plain search, all thresholds between values; the first among equals."""
    mean, best = y[rows].mean(), None
    spread = lambda r: ((y[r] - y[r].mean()) ** 2).sum()
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for a, b in zip(values, values[1:]):
                left, right = rows[x[rows, j] <= (a + b) / 2], rows[x[rows, j] > (a + b) / 2]
                gain = spread(rows) - spread(left) - spread(right)
                if min(len(left), len(right)) >= leaf and (best is None or gain > best[0] + 1e-9):
                    best = gain, j, (a + b) / 2, left, right
    if best is None or best[0] <= 1e-9:
        return lambda v: np.full(len(v), mean)
    _, j, at, left, right = best
    low, high = grown(x, y, left, leaf, depth - 1), grown(x, y, right, leaf, depth - 1)
    return lambda v: np.where(v[:, j] <= at, low(v), high(v))


def test_boosted_trees_with_nulls(spark):
    """Equal to trees grown by plain search, in which a split sends nulls to either side."""
    r = np.random.default_rng(6)
    n = 60
    a, b = r.integers(0, 12, n).astype(float), r.integers(0, 9, n).astype(float)
    y = np.where(a > 6, 3.0, 0.0) + b * 0.2 + r.normal(size=n) * 0.3
    hole = r.random(n) < 0.3
    y[hole] += 2.5
    fold = np.arange(n) % 2
    df = spark.createDataFrame([(i, None if hole[i] else float(a[i]), float(b[i]), float(y[i]), int(fold[i])) for i in range(n)], "k int, a double, b double, y double, fold int")
    got = np.array([x.predicted for x in M.boosted(df, ["a", "b"], "y", "fold", trees=3, step=0.5, leaf=3, depth=2).orderBy("k").collect()])
    x = np.stack([np.where(hole, -M.FAR, a), np.where(hole, M.FAR, a), b], axis=1)
    want = np.empty(n)
    for f in (0, 1):
        train, rows = fold != f, fold == f
        now, out = None, None
        for k in range(3):
            goal = y[train] if now is None else 2 * (y[train] - now)
            tree = grown(x[train], goal, np.arange(train.sum()), 3, 2)
            step = 1.0 if now is None else 0.5
            now = step * tree(x[train]) + (0 if now is None else now)
            out = step * tree(x[rows]) + (0 if out is None else out)
        want[rows] = out
    far = ~np.isclose(got, want, atol=1e-6)
    assert far.sum() <= 3 and hole[far].all()  # a null that meets a split which saw none goes either way
