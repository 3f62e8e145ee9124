"""Out-of-fold scores of feature blocks, from cross-product sums alone.

One scan gives the sums of products of [1, columns] for each cell (a fold, and a tier or a shuffle where one is asked for). A
fitted model is a vector of weights over [1, columns], its squared error in a cell is a quadratic form in the cell's sums,
and a residual is again such a vector. So no model needs another scan, whatever the number of rows, arms and penalties."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as D
from tessera.functions.semantics import ratio
from tessera.operators.models import shuffles
from tessera.operators.ordered import quantiles
from tessera.operators.products import Cells, Weights, cross_products, filled_cells
from tessera.operators.statistics import clean, uniform


def ridge(m: np.ndarray, xs: np.ndarray, target: Weights, alpha: float) -> Weights:
    """Weights over [1, columns] of the model of a target (itself such weights) on the design rows xs (each such weights too),
    standardised, with an unnormalised penalty; constant design columns get 0."""
    n = m[0, 0]
    mean, mean_t = xs @ m[0] / n, target @ m[0] / n
    c = xs @ m @ xs.T / n - np.outer(mean, mean)
    ct = xs @ m @ target / n - mean * mean_t
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    use = sd > 1e-9 * np.maximum(1, np.abs(mean))
    beta = np.zeros(len(xs))
    if use.any():
        z = c[np.ix_(use, use)] / np.outer(sd[use], sd[use]) + alpha / n * np.eye(use.sum())
        beta[use] = np.linalg.lstsq(z, ct[use] / sd[use], rcond=None)[0] / sd[use]
    out = beta @ xs if len(xs) else np.zeros(len(target))
    out[0] += mean_t - mean @ beta
    return out


def error(m: np.ndarray, target: Weights, w: Weights) -> float:
    return float((target - w) @ m @ (target - w))


def chosen(cells: Cells, inside: Callable[[tuple], bool], xs: np.ndarray, target: Weights, alphas: Sequence[float]) -> float:
    """The penalty with the least squared error over the folds inside, each predicted from the others."""
    if len(alphas) == 1:
        return alphas[0]
    folds = sorted({k[0] for k in cells.sums if inside(k)})

    def loss(alpha: float) -> float:
        out = 0.0
        for f in folds:
            rest = cells.total(lambda k: inside(k) and k[0] != f)
            if rest[0, 0] > 1:
                out += error(cells.total(lambda k: inside(k) and k[0] == f), target, ridge(rest, xs, target, alpha))
        return out

    return min(alphas, key=loss)


def r2_of(cells: Cells, y: str, fits: dict[tuple, Weights], wanted: Callable[[tuple], bool] = lambda k: True) -> tuple[int, float | None]:
    """(rows, R2) of out-of-fold weights by cell, around the mean of the rows wanted; None at zero variance."""
    target = cells.unit(y)
    m = cells.total(wanted)
    spread = m[cells.at[y], cells.at[y]] - m[0, cells.at[y]] ** 2 / max(m[0, 0], 1)
    sse = sum(error(s, target, fits[k]) for k, s in cells.sums.items() if wanted(k))
    return int(m[0, 0]), (float(1 - sse / spread) if spread > 1e-12 * max(1.0, abs(m[cells.at[y], cells.at[y]])) else None)


def designs(cells: Cells, columns: Sequence[str]) -> np.ndarray:
    return cells.design(columns)


def by_fold(cells: Cells, fit: Callable[[object, Callable[[tuple], bool]], Weights]) -> dict[tuple, Weights]:
    found = {f: fit(f, lambda k, f=f: k[0] != f) for f in cells.folds}
    return {k: found[k[0]] for k in cells.sums}


def linear(cells: Cells, xs: Sequence[str], y: str, alphas: Sequence[float] = (0.0,)) -> dict[tuple, Weights]:
    """One joint model a fold."""
    target = cells.unit(y)

    def fit(fold, inside):
        x = cells.design(xs, fold)
        return ridge(cells.total(inside), x, target, chosen(cells, inside, x, target, alphas))

    return by_fold(cells, fit)


def out_of_fold(df: DataFrame, models: dict[str, Sequence[str]], y: str, fold: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """(model, n, r2) of each named column list, all from one scan. Rows need a target; nulls of other columns are filled by each
    fold's training median, beside a mark that the models see too."""
    cells = filled_cells(df, sorted({c for xs in models.values() for c in xs}), y, fold)[None]
    rows = [(name, *r2_of(cells, y, linear(cells, xs, y, alphas))) for name, xs in models.items()]
    return df.sparkSession.createDataFrame(rows, "model string, n long, r2 double")


def residual(cells: Cells, controls: Sequence[str], block: Sequence[str], y: str, alphas: Sequence[float] = (0.0,)) -> dict[tuple, Weights]:
    """Unpenalised controls, then the block on what they leave of the training rows; both are added up."""
    target = cells.unit(y)

    def fit(fold, inside):
        m, z = cells.total(inside), cells.design(block, fold)
        base = ridge(m, cells.design(controls, fold), target, 0.0)
        return base + ridge(m, z, target - base, chosen(cells, inside, z, target - base, alphas))

    return by_fold(cells, fit)


def residual_by_tier(cells: Cells, controls: Sequence[str], block: Sequence[str], y: str, alphas: Sequence[float] = (0.0,), least: int = 60) -> dict[tuple, Weights]:
    """Like residual(), but the block has a model of its own in each tier (the cells' second key); tiers with fewer than `least`
    training rows keep the controls alone. The controls are shared."""
    x, z, target = designs(cells, controls), designs(cells, block), cells.unit(y)
    out = {}
    for f, tier in cells.sums:
        base = ridge(cells.total(lambda k, f=f: k[0] != f), x, target, 0.0)
        mine = lambda k, f=f, tier=tier: k[0] != f and k[1] == tier
        m = cells.total(mine)
        out[f, tier] = base + ridge(m, z, target - base, chosen(cells, mine, z, target - base, alphas)) if m[0, 0] >= least else base
    return out


def reduced(cells: Cells, controls: Sequence[str], vectors: Sequence[str], y: str, width: int, alphas: Sequence[float] = (0.0,)) -> dict[tuple, Weights]:
    """A joint model on the controls and the first principal components of the vectors, which each fold takes from its training rows alone."""
    x, v, target = designs(cells, controls), designs(cells, vectors), cells.unit(y)

    def fit(_, inside):
        m = cells.total(inside)
        mean = v @ m[0] / m[0, 0]
        values, parts = np.linalg.eigh(v @ m @ v.T / m[0, 0] - np.outer(mean, mean))
        z = np.vstack([x, parts[:, np.argsort(-values)[:width]].T @ v])
        return ridge(m, z, target, chosen(cells, inside, z, target, alphas))

    return by_fold(cells, fit)


def tier_interactions(df: DataFrame, features: Sequence[str], tier: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with an indicator of each level and each feature in the slot of its row's level, 0 elsewhere; and the new columns' names."""
    made: dict[str, Column] = {}
    for i, level in enumerate(levels):
        inside = F.coalesce(F.col(tier) == level, F.lit(False))
        made[f"tier_{i}"] = inside.cast("double")
        made |= {f"tier_{i}_{c}": F.when(inside, F.col(c).cast("double")).otherwise(0.0) for c in features}
    return df.withColumns(made), list(made)


def typed_block(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """log1p of the columns of kind count; flags stay."""
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) if kind == "count" else F.col(c).cast("double") for c, kind in kinds.items()})


def spliced(a: DataFrame, b: DataFrame, key: str, tier: str, tiers: Sequence[str], vector: str, tolerance: float | None = None) -> DataFrame:
    """a with the vectors of b in the rows of some tiers; rows that b lacks keep their own. With a tolerance, the other rows must agree
    in both sets up to it: ValueError says how many don't."""
    other = b.select(key, F.col(vector).alias("_other"))
    both = a.join(other, key, "left")
    inside = F.col(tier).isin(*tiers)
    if tolerance is not None:
        apart = F.exists(F.zip_with(vector, "_other", lambda x, y: F.abs(x - y)), lambda d: d.isNull() | (d > tolerance))
        if n := both.where(~F.coalesce(inside, F.lit(False)) & F.col("_other").isNotNull() & apart).count():
            raise ValueError(f"{n} rows outside {', '.join(map(str, tiers))} differ by more than {tolerance}")
    return both.withColumn(vector, F.when(inside, F.coalesce("_other", F.col(vector))).otherwise(F.col(vector))).drop("_other")


def arms(df: DataFrame, baseline: Sequence[str], blocks: dict[str, Sequence[str]], y: str, fold: str, alphas: Sequence[float] = (0.0,), tier: str | None = None) -> DataFrame:
    """(arm, n, r2_baseline, r2_alone, lift) of each block: alone, and on what the baseline leaves, against the baseline's
    out-of-fold R2, which is the same for all. With a tier also (tier, ...) rows that score the same predictions inside each.
    Rows need a target; nulls of other columns are filled by each fold's training median, beside a mark."""
    columns = sorted({*baseline, *(c for b in blocks.values() for c in b)} - {y})
    cells = filled_cells(df, columns, y, fold, [tier] if tier else [])[None]
    base = linear(cells, baseline, y)
    fits = {name: (linear(cells, block, y, alphas), residual(cells, baseline, block, y, alphas)) for name, block in blocks.items()}
    rows = []
    for level in [None, *(sorted({k[1] for k in cells.sums}) if tier else [])]:
        wanted = (lambda k: True) if level is None else (lambda k, level=level: k[1] == level)
        n, low = r2_of(cells, y, base, wanted)
        for name, (alone, both) in fits.items():
            full = r2_of(cells, y, both, wanted)[1]
            rows.append((name, level, n, low, r2_of(cells, y, alone, wanted)[1], full - low if full is not None and low is not None else None))
    out = df.sparkSession.createDataFrame(rows, "arm string, tier string, n long, r2_baseline double, r2_alone double, lift double")
    return out if tier else out.drop("tier")


def marginal(df: DataFrame, key: str, base: Sequence[str], block: Sequence[str], y: str, fold: str, alphas: Sequence[float] = (0.0,), turns: int = 49, ablate: Sequence[str] = ()) -> DataFrame:
    """(n, n_added, r2_reduced, r2_full, lift, lift_ablated, null_lift_mean, null_lift_p95, p): what a block adds to a base, also
    without some columns on both sides, against the lifts of the block with its rows shuffled. All shuffles are one join. Rows need
    a target; nulls of other columns are filled by each fold's training median, beside a mark, in each shuffle anew."""
    columns = sorted({*base, *block} - {y})
    cells = filled_cells(df, columns, y, fold)[None]
    n, low = r2_of(cells, y, linear(cells, base, y, alphas))
    high = r2_of(cells, y, linear(cells, [*base, *block], y, alphas))[1]
    rest, more = [c for c in base if c not in ablate], [c for c in block if c not in ablate]
    ablated = r2_of(cells, y, linear(cells, [*rest, *more], y, alphas))[1] - r2_of(cells, y, linear(cells, rest, y, alphas))[1] if more else 0.0
    x, target = designs(cells, [*base, *block]), cells.unit(y)
    fixed = [chosen(cells, lambda k: True, x, target, alphas)]
    whole = df.select(key, fold, *[F.col(c).cast("double").alias(c) for c in [*columns, y]]).na.drop(subset=[key, fold, y])
    null = filled_cells(shuffles(whole, key, list(block), range(1, turns + 1)), columns, y, fold, turn="turn") if turns else {}
    lifts = [r2_of(own, y, linear(own, [*base, *block], y, fixed))[1] - low for _, own in sorted(null.items())]
    lift = high - low
    row = (n, len(block), low, high, lift, ablated, float(np.mean(lifts)) if lifts else None, float(np.percentile(lifts, 95)) if lifts else None, (sum(v >= lift for v in lifts) + 1) / (turns + 1))
    return df.sparkSession.createDataFrame([row], "n long, n_added long, r2_reduced double, r2_full double, lift double, lift_ablated double, null_lift_mean double, null_lift_p95 double, p double")


def transfer(df: DataFrame, early: str, late: str, errors: tuple[str, str] | None, models: dict[str, tuple[Sequence[str], str | None]], fold: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """(model, n, n_predictors, r2_change, contribution, noise_share, change_sd): each model's out-of-fold R2 on late - early.

    A model is its columns and the model it is compared with, whose R2 less its own is the contribution. The noise share is
    the mean of both vintages' squared errors by the change's variance."""
    rows = df.where(F.col(early).isNotNull() & F.col(late).isNotNull()).withColumn("_change", F.col(late) - F.col(early))
    columns = sorted({c for xs, _ in models.values() for c in xs})
    cells = cross_products(rows, [*columns, "_change"], [fold])
    noise = F.avg(F.pow(F.col(errors[0]), 2) + F.pow(F.col(errors[1]), 2)) if errors else F.lit(None).cast("double")
    about = rows.agg(noise.alias("noise"), F.stddev_samp("_change").alias("sd")).first()
    share = about["noise"] / about["sd"] ** 2 if about["noise"] is not None and about["sd"] else None
    scored = {name: r2_of(cells, "_change", linear(cells, xs, "_change", alphas)) for name, (xs, _) in models.items()}
    out = [(name, scored[name][0], len(xs), scored[name][1], scored[ref][1] - scored[name][1] if ref else None, share, about["sd"]) for name, (xs, ref) in models.items()]
    return df.sparkSession.createDataFrame(out, "model string, n long, n_predictors long, r2_change double, contribution double, noise_share double, change_sd double")


def size_explained(df: DataFrame, size: Sequence[str], columns: Sequence[str], fold: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """(column, linear_r2, curve_r2, gain): how well size columns, and all their powers and products up to the third degree, tell
    each column out of fold, floored at 0."""
    basis: dict[str, Column] = {}
    for i, a in enumerate(size):
        for j, b in enumerate(size[i:], i):
            basis[f"{a}*{b}"] = F.col(a) * F.col(b)
            basis |= {f"{a}*{b}*{c}": F.col(a) * F.col(b) * F.col(c) for c in size[j:]}
    cells = cross_products(df.withColumns(basis), [*size, *basis, *columns], [fold])
    rows = []
    for c in columns:
        one, three = (max(0.0, r2_of(cells, c, linear(cells, xs, c, alphas))[1] or 0.0) for xs in (list(size), [*size, *basis]))
        rows.append((c, one, three, max(0.0, three - one)))
    return df.sparkSession.createDataFrame(rows, "column string, linear_r2 double, curve_r2 double, gain double")


def centred(df: DataFrame, columns: Sequence[str], group: str | None) -> tuple[np.ndarray, int, int]:
    """(products of the columns less their group's mean, rows, groups), by two aggregates; one group without a group column."""
    full = df.select(*([group] if group else []), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    k = len(columns)
    parts = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)] + [F.sum(F.col(a) * F.col(columns[j])).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j in range(i, k)]
    groups = full.groupBy(*([group] if group else [])).agg(F.count(F.lit(1)).alias("n"), *parts)
    r = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not r["n"]:
        return np.zeros((k, k)), 0, 0
    return np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), r["n"], r["g"]


def partial_effects(df: DataFrame, columns: Sequence[str], y: str, controls: Sequence[str], group: str | None = None) -> DataFrame:
    """(column, is_flag, n_true, raw_difference, partial_r, effect, column_sd, effect_per_sd, p, q): each column's relation with y when
    both are freed of the controls, and of the groups' means; p by Student's t, q by Benjamini and Hochberg over the columns.

    All columns are measured on the same rows, those with target, controls and group: a column's nulls are filled with its
    median over them. n_true and the raw difference of the target's means are those of flags that are neither all nor none."""
    names = [*controls, *columns, y]
    rows = df.select(*([group] if group else []), *[clean(c).alias(c) for c in dict.fromkeys(names)]).na.drop(subset=[y, *controls, *([group] if group else [])])
    gaps = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    fills = {c: (quantiles(rows, c, [0.5]).first() or [[0.0]])[0][0] for c in columns if gaps[c]}
    rows = rows.na.fill({c: v if v is not None else 0.0 for c, v in fills.items()}) if fills else rows
    c, n, groups = centred(rows, names, group)
    k, last = len(controls), len(names) - 1
    parts = []
    for i, x in enumerate(columns):
        v = F.col(x)
        parts += [F.stddev_samp(v).alias(f"sd{i}"), F.bool_and(v.isin(0.0, 1.0)).alias(f"f{i}"), F.count_if(v == 1).alias(f"n{i}"), (F.avg(F.when(v == 1, F.col(y))) - F.avg(F.when(v == 0, F.col(y)))).alias(f"d{i}")]
    about = rows.agg(*parts).first()
    inner = c[:k, :k]
    rank = groups + (int(np.linalg.matrix_rank(inner)) if k else 0)
    solve = lambda j: np.linalg.lstsq(inner, c[:k, j], rcond=None)[0] if k else np.zeros(0)
    out, by = [], solve(last)
    left_y = c[last, last] - by @ c[:k, last]
    for i, name in enumerate(columns):
        j = k + i
        bx = solve(j)
        left_x, both = c[j, j] - bx @ c[:k, j], c[j, last] - bx @ c[:k, last]
        known = left_x > 1e-12 * max(1.0, c[j, j]) and left_y > 0
        r, effect = (both / np.sqrt(left_x * left_y), both / left_x) if known else (0.0, 0.0)
        free = n - rank - 1
        p = 2 * D.t_sf(abs(r) * np.sqrt(free / max(1e-12, 1 - r * r)), free) if free > 0 else 1.0
        sd, flag = about[f"sd{i}"] or 0.0, about[f"f{i}"]
        out.append([name, flag, about[f"n{i}"] if flag else None, about[f"d{i}"] if flag else None, float(r), float(effect), float(sd), float(effect * sd), float(p), 1.0])
    best = 1.0
    for place, i in enumerate(sorted(range(len(out)), key=lambda i: -out[i][8])):
        best = min(best, out[i][8] * len(out) / (len(out) - place))
        out[i][9] = best
    return df.sparkSession.createDataFrame([tuple(r) for r in out], "column string, is_flag boolean, n_true long, raw_difference double, partial_r double, effect double, column_sd double, effect_per_sd double, p double, q double")


def tier_gradient(df: DataFrame, y: str, tier: str, levels: Sequence[str], size: str) -> DataFrame:
    """(tier, raw, controlled, share_left, raw_r2, controlled_r2): each tier's gap to the first, before and after a size control, and the share that is left of it."""
    rows = df.where(F.col(y).isNotNull() & F.col(tier).isin(*levels))
    names = {f"_t{i}": F.when(F.col(tier) == level, 1.0).otherwise(0.0) for i, level in enumerate(levels[1:], 1)}
    cells = cross_products(rows.withColumns(names).withColumn("_all", F.lit(0)), [*names, size, y], ["_all"])
    m, target = cells.total(lambda k: True), cells.unit(y)
    fits = [ridge(m, designs(cells, xs), target, 0.0) for xs in (list(names), [*names, size])]
    spread = m[cells.at[y], cells.at[y]] - m[0, cells.at[y]] ** 2 / m[0, 0]
    scores = [float(1 - error(m, target, w) / spread) for w in fits]
    out = []
    for i, level in enumerate(levels[1:], 1):
        raw, left = (float(w[cells.at[f"_t{i}"]]) for w in fits)
        out.append((level, raw, left, left / raw if raw else None, *scores))
    return df.sparkSession.createDataFrame(out, "tier string, raw double, controlled double, share_left double, raw_r2 double, controlled_r2 double")


def row_bootstrap(df: DataFrame, key: str, y: str, low: str, high: str, rounds: int = 500, seed: int = 42) -> DataFrame:
    """(point, low, high): the R2 of one fixed prediction less that of another, and percentiles 2.5 and 97.5 of it over rounds that
    draw each row a Poisson(1) number of times, by a hash of its key: no round moves rows."""
    u = uniform(F.col(key), F.col("_k"), F.lit(seed))
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1)) for i in range(8)])
    drawn = F.when(F.col("_k") == 0, 1).otherwise(sum(((u >= float(s)).cast("int") for s in steps), F.lit(0)))
    rows = df.select(key, *[F.col(c).cast("double").alias(n) for c, n in ((y, "_y"), (low, "_a"), (high, "_b"))]).na.drop()
    many = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).withColumn("_w", drawn)
    w = F.col("_w")
    spread = F.sum(w * F.col("_y") * F.col("_y")) - F.pow(F.sum(w * F.col("_y")), 2) / F.sum(w)
    loss = lambda p: F.sum(w * F.pow(F.col("_y") - F.col(p), 2))
    deltas = many.groupBy("_k").agg(ratio(loss("_a") - loss("_b"), spread).alias("d"))
    bounds = quantiles(deltas.where("_k > 0"), "d", [0.025, 0.975])
    return deltas.where("_k = 0").select(F.col("d").alias("point")).crossJoin(F.broadcast(bounds)).select("point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def score_intervals(scores: DataFrame, target: str, arm: str, value: str, cluster: str | None = None, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(arm, against, point, low, high, covers_zero): each arm's mean over the targets, and with `against` its lead over another arm.

    A round draws targets (or whole clusters of targets) with replacement, and all arms are scored on the same draw, so what
    they share cancels in the leads. ValueError where an arm lacks a target. For score tables: one row a target and arm."""
    table = scores.select(F.col(target).alias("t"), F.col(arm).cast("string").alias("arm"), F.col(value).cast("double").alias("v"), (F.col(cluster) if cluster else F.col(target)).cast("string").alias("c"))
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("t"), F.count_distinct("arm").alias("a"), F.count("v").alias("v")).first()
    if shape["n"] != shape["t"] * shape["a"] or shape["v"] != shape["n"]:
        raise ValueError("every arm must score every target once")
    units = sorted(r[0] for r in table.select("c").distinct().collect())
    spark: SparkSession = scores.sparkSession
    named = spark.createDataFrame(list(enumerate(units)), "i long, c string")
    place = F.floor(uniform(F.col("k"), F.col("d"), F.lit(seed)) * len(units))
    draws = spark.range(1, rounds + 1).withColumnRenamed("id", "k").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(len(units))))).select("k", place.alias("i"))
    every = draws.groupBy("k", "i").agg(F.count(F.lit(1)).alias("w")).unionByName(named.select(F.lit(0).cast("long").alias("k"), "i", F.lit(1).cast("long").alias("w")))
    by_unit = table.groupBy("c", "arm").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).join(named, "c")
    means = every.join(by_unit, "i").groupBy("k", "arm").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    a, b = means.alias("a"), means.alias("b")
    leads = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.arm") < F.col("b.arm"))).select(F.col("a.k").alias("k"), F.col("a.arm").alias("arm"), F.col("b.arm").alias("against"), (F.col("a.m") - F.col("b.m")).alias("m"))
    both = means.select("k", "arm", F.lit(None).cast("string").alias("against"), "m").unionByName(leads)
    pair = ["arm", "against"]
    points = both.where("k = 0").select(*pair, F.col("m").alias("point"))
    bounds = both.where("k > 0").groupBy(*pair).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # one row a round
    joined = points.join(bounds.withColumnsRenamed({"arm": "_a", "against": "_b"}), (F.col("arm") == F.col("_a")) & F.col("against").eqNullSafe(F.col("_b")))
    low, high = F.col("q")[0], F.col("q")[1]
    return joined.select(*pair, "point", low.alias("low"), high.alias("high"), ((low <= 0) & (high >= 0)).alias("covers_zero"))


def summary_by_model(scores: DataFrame, model: str, reference: str, contribution: str) -> DataFrame:
    """(model, n_targets, mean, n_positive) of the models that have a reference; null and empty ones have none."""
    named = scores.where(F.coalesce(F.col(reference), F.lit("")) != "")
    return named.groupBy(F.col(model).alias("model")).agg(F.count(F.lit(1)).alias("n_targets"), F.avg(contribution).alias("mean"), F.count_if(F.col(contribution) > 0).alias("n_positive"))


def means_by(scores: DataFrame, owner: str, target: str, columns: Sequence[str]) -> DataFrame:
    """(owner, n_targets, mean of each score column) over the targets of each owner."""
    return scores.groupBy(owner).agg(F.count(target).alias("n_targets"), *[F.avg(c).alias(c) for c in columns])
