"""Statistics on columns: one pass of sums where a formula allows, hash-seeded resampling where it doesn't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import distributions as D
from tessera.functions.semantics import col, ratio
from tessera.operators.ordered import average_ranks, cumulative, numbered


def clean(x) -> Column:
    """NaN to null, so that correlations skip it."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def corr(x, y) -> Column:
    """An aggregate: Pearson correlation of the rows complete in both; null at zero variance, where the built-in one raises."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, r, n) for all pairs from one scan and one wide aggregate, on the rows complete for each pair; r is null at zero variance."""
    parts = []
    for i, (x, y) in enumerate(pairs):
        a, b = clean(x), clean(y)
        both = a.isNotNull() & b.isNotNull()
        parts += [corr(a, b).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(pairs)])
    return df.agg(*parts).select(F.explode(rows).alias("p")).select("p.*")


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd, low, high) of each numeric column, by one aggregate; the deviation of a single row is 0."""
    parts = []
    for i, c in enumerate(columns):
        x = clean(c)
        parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(n) for k, n in (("n", "n"), ("m", "mean"), ("s", "sd"), ("a", "low"), ("b", "high"))]) for i, c in enumerate(columns)])
    return df.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")


def partial(rxy, rxz, ryz) -> Column:
    """Correlation of x and y given z; 0 where z leaves nothing of one."""
    x, y, z = col(rxy), col(rxz), col(ryz)
    return ratio(x - y * z, F.sqrt((1 - y * y) * (1 - z * z)), 0.0)


def r2(y: str, predicted: str) -> Column:
    """An aggregate: 1 - SSE / SST around the target's mean, from sums."""
    n, s, s2 = F.count(F.lit(1)), F.sum(y), F.sum(F.col(y) * F.col(y))
    return 1 - ratio(F.sum(F.pow(F.col(y) - F.col(predicted), 2)), s2 - s * s / n)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, x, "_a", by), y, "_b", by)
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 2, corr("_a", "_b")).alias("rho"), F.count(F.lit(1)).alias("n"))


def signed_ranks(df: DataFrame, difference: str) -> DataFrame:
    """(w_plus, n): sum of the average ranks of |difference| over positive ones; zeros are left out."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    sizes = cumulative(d, "_a", extra=[F.count_if(F.col(difference) > 0).alias("_up")])
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    return sizes.agg(F.coalesce(F.sum(F.col("_up") * rank), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def signed_rank_test(df: DataFrame, difference: str) -> DataFrame:
    """(n, w_plus, z, p): Wilcoxon's signed-rank test, two-sided; exact over the ranks as they are, ties included, up to 50 pairs, normal
    with the ties' correction beyond. Zeros are left out; without any pair p is 1."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    sizes = cumulative(d, "_a", extra=[F.count_if(F.col(difference) > 0).alias("_up")]).withColumn("_r", F.col("below") + (F.col("n") + 1) / 2.0)
    t = F.col("n").cast("double")
    r = sizes.agg(F.coalesce(F.sum(F.col("_up") * F.col("_r")), F.lit(0.0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties")).first()
    ranks = [x["_r"] for x in sizes.select("_r", "n").collect() for _ in range(x["n"])] if 0 < r["n"] <= 50 else None
    row = (r["n"], r["w"], D.signed_rank_z(r["w"], r["n"], r["ties"]), D.signed_rank_p(r["w"], r["n"], ranks, r["ties"]))
    return df.sparkSession.createDataFrame([row], "n long, w_plus double, z double, p double")


def cluster_dependence(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """(n, k, m0, icc, design_effect, n_effective): one-way ICC floored at 0, Kish's mean cluster size and what follows from them."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    a = g.agg(F.sum("m").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"))
    between, within = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), (F.col("s2") - F.col("b")) / (F.col("n") - F.col("k"))
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("k") - 1)
    a = a.withColumn("m0", m0).withColumn("between", between).withColumn("within", within)
    icc = F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("between") - F.col("within"), F.col("between") + (F.col("m0") - 1) * F.col("within")), F.lit(0.0)))
    a = a.withColumn("icc", F.when((F.col("within") <= 0) | (F.col("m0") <= 1), 0.0).otherwise(icc)).withColumn("design_effect", 1 + (F.col("m0") - 1) * F.col("icc"))
    return a.select("n", "k", "m0", "icc", "design_effect", (F.col("n") / F.col("design_effect")).alias("n_effective"))


def uniform(*keys) -> Column:
    """A number in [0, 1) fixed by the keys, wherever the row is computed."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def permutation_p(df: DataFrame, key: str, x: str, y: str, rounds: int = 499, seed: int = 42) -> DataFrame:
    """(r, p): two-sided, (as large or larger + 1) / (rounds + 1). All rounds are one join: the x at a place of one random order
    meet the y at that place of the round's own, so y's rows are shuffled once a round, in buckets of bounded size."""
    rows = df.select(key, clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    turns = rows.select(key, "y", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_k"))
    a, b = numbered(rows.select(key, "x"), key, seed).select("position", "x"), numbered(turns, key, seed, ["_k"]).select("position", "_k", "y")
    null = a.join(b, "position").groupBy("_k").agg(corr("x", "y").alias("rk"))
    seen = rows.agg(corr("x", "y").alias("r"))
    return null.crossJoin(F.broadcast(seen)).groupBy("r").agg(((F.sum((F.abs("rk") >= F.abs("r") - 1e-12).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def bootstrap(df: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high): percentiles 2.5 and 97.5 of means of resampled rows. A row's count in a round is Poisson(1), drawn from its hash, so rounds need no join and no shuffle of rows."""
    u = uniform(F.col(key), F.col("_k"), F.lit(seed))
    steps, total = [], 0.0
    p = 0.36787944117144233
    for i in range(8):
        total += p
        steps.append(total)
        p /= i + 1
    n = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    drawn = df.where(F.col(value).isNotNull()).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", n)
    means = drawn.groupBy("_k").agg(ratio(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("m"))
    out = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(out))


def histogram2d(df: DataFrame, x: str, y: str, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    cut = lambda c, r: F.least(F.lit(bins), F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / bins)) + 1)
    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(cut(x, x_range).alias("bx"), cut(y, y_range).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two labellings of the same rows, from their contingency table."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2.0
    t = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cell = t.agg(F.sum(two("n")).alias("c"), F.sum("n").alias("m"))
    ra, rb = (t.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(f"s{x}")) for x in (a, b))
    joined = cell.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))
    expected = F.col(f"s{a}") * F.col(f"s{b}") / (F.col("m") * (F.col("m") - 1) / 2.0)
    return joined.select(ratio(F.col("c") - expected, (F.col(f"s{a}") + F.col(f"s{b}")) / 2 - expected).alias("ari"))


def width_of(df: DataFrame, vector: str) -> int:
    """The length of the longest vector."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def vector_sums(vector: str, width: int, how=F.sum) -> list[Column]:
    """Aggregates of each dimension, _v0 on: rows are added up as they are, none is split into its dimensions."""
    return [how(F.get(vector, F.lit(i)).cast("double")).alias(f"_v{i}") for i in range(width)]


def mean_vectors(df: DataFrame, vector: str, width: int, by: Sequence[str] = (), out: str = "mean") -> DataFrame:
    """(by, n, out) of the rows that have a vector."""
    g = df.where(F.col(vector).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *vector_sums(vector, width, F.avg))
    return g.select(*by, "n", F.array(*[F.col(f"_v{i}") for i in range(width)]).alias(out))


def variance_share(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Share of the vectors' total variance that lies between labels, from one vector of sums a label."""
    width = width_of(df, vector)
    known = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    g = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("sq"), *vector_sums(vector, width))
    between = sum((F.col(f"_v{i}") * F.col(f"_v{i}") for i in range(width)), F.lit(0.0)) / F.col("n")
    a = g.agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum(between).alias("b"), *[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(width)])
    centre = sum((F.col(f"_v{i}") * F.col(f"_v{i}") for i in range(width)), F.lit(0.0)) / F.col("n")
    return a.select(ratio(F.col("b") - centre, F.col("sq") - centre).alias("between_share"))
