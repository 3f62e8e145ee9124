"""Order statistics of whole columns, with no task that holds a whole column or a whole group.

Equal values are counted first. Distinct values are then dealt to buckets that keep their order, and numbered inside; what
lies before a bucket comes from the buckets' sums. Buckets lie between splitters that a sketch of the column gives, and where
those are too few for its rows, each stretch between two splitters is cut evenly: so a bucket has about ROWS rows whatever
the column's size, offset or spread. A column of ROWS rows or fewer is one bucket."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should have, and splitters that a sketch gives at most.
ROWS, SPLITTERS = 50_000, 2048


def splitters(df: DataFrame, x: str) -> tuple[list[float], int]:
    """(ascending splitters, even parts of each stretch between two), by one aggregate over the column."""
    shares = [i / SPLITTERS for i in range(SPLITTERS + 1)]
    r = df.agg(F.count(x).alias("n"), F.percentile_approx(x, shares, 5 * SPLITTERS).alias("q")).first()
    wanted = math.ceil(r["n"] / ROWS)
    if wanted <= 1:
        return [], 1
    step = max(1, SPLITTERS // wanted)
    places = sorted({*range(0, SPLITTERS + 1, step), SPLITTERS})
    return sorted({r["q"][i] for i in places}), max(1, math.ceil(wanted / SPLITTERS))


def with_bucket(df: DataFrame, x: str, found: tuple[list[float], int], out: str = "_b") -> DataFrame:
    """df with a whole number that never falls while x rises."""
    from pyspark.ml.feature import Bucketizer

    at, parts = found
    inner = at[1:-1]
    if not inner:
        return df.withColumn(out, F.lit(0).cast("long"))
    dealt = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=x, outputCol=out).transform(df).withColumn(out, F.col(out).cast("long"))
    if parts == 1:
        return dealt
    edge = lambda i: F.element_at(F.array(*map(F.lit, [at[0], *inner, at[-1]])), (F.col(out) + i).cast("int"))
    inside = F.try_divide(F.col(x) - edge(1), edge(2) - edge(1))
    part = F.least(F.greatest(F.floor(F.coalesce(inside, F.lit(0.0)) * parts), F.lit(0)), F.lit(parts - 1))
    return dealt.withColumn(out, F.col(out) * parts + part)


def cumulative(df: DataFrame, x: str, by: Sequence[str] = (), count: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """(by, x, n, below, total, extra) of each distinct value: its rows, the rows of its group below it, and all of the group.

    Nulls and NaN of x and rows with a null group are left out. With `count`, rows stand for so many each. `extra` are further
    aggregates of a value's rows."""
    value = F.col(x).cast("double")
    known = df.where(value.isNotNull() & ~F.isnan(value)).withColumn(x, value)
    for c in by:
        known = known.where(F.col(c).isNotNull())
    found = splitters(known, x)
    counts = known.groupBy(*by, x).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"), *extra)
    group = [F.col(c) for c in by] or [F.lit(0)]
    if not found[0]:
        whole = Window.partitionBy(*group)
        return counts.withColumns({"below": F.sum("n").over(whole.orderBy(x)) - F.col("n"), "total": F.sum("n").over(whole)})
    counts = with_bucket(counts, x, found)
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")
    sums = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_n")).select(*by, "_b", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*by, "_b").orderBy(x)) - F.col("n")
    return counts.join(sums, [*by, "_b"]).withColumn("below", F.col("_before") + inside).drop("_b", "_before")


def quantiles(df: DataFrame, x: str, shares: Sequence[float], by: Sequence[str] = (), count: str | None = None, out: str = "q") -> DataFrame:
    """(by, out): exact quantiles of each group with linear interpolation, as an array in the order of the shares.
    Between two equal values it is that value itself, so an edge never parts equal rows from each other by its rounding."""
    parts = []
    for i, p in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("_x")))
        parts += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    found = cumulative(df.select(*by, F.col(x).alias("_x"), *([count] if count else [])), "_x", by, count).groupBy(*by).agg(*parts)
    return found.select(*by, F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(shares))]).alias(out))


def average_ranks(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """df with ranks from 1, ties by their mean; rows without a value or a group go."""
    values = df.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(x).alias("_x"))
    ranks = cumulative(values, "_x", [f"_by_{c}" for c in by]).select(*[f"_by_{c}" for c in by], "_x", (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    same = F.col(x).cast("double") == F.col("_x")
    for c in by:
        same &= F.col(c) == F.col(f"_by_{c}")
    return df.join(ranks, same).drop("_x", *[f"_by_{c}" for c in by])


def numbered(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """df with the numbers 0, 1, ... in each group, in the order of a hash of key, group and seed: a random order that every
    evaluation repeats. Rows with one key are numbered in any order among themselves. Hashes are even, so as many buckets as
    the rows need, a power of two, hold about ROWS rows each."""
    bits = max(0, math.ceil(math.log2(max(1, df.count() / ROWS))))
    rows = df.withColumn("_h", F.xxhash64(key, *by, F.lit(seed)))
    group = [F.col(c) for c in by] or [F.lit(0)]
    order = ["_h", key]
    if not bits:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).drop("_h")
    rows = rows.withColumn("_b", F.shiftright("_h", 64 - bits))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")
    sums = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_b", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    return rows.join(sums, [*by, "_b"]).withColumn(out, F.col("_before") + inside).drop("_h", "_b", "_before")


def quantile_bin(df: DataFrame, x: str, q: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Bins 1..q by interpolated quantile edges, right-closed, the lowest included; ties share a bin and equal edges merge."""
    edges = quantiles(df, x, [i / q for i in range(1, q)], by, out="_edges")
    joined = df.join(edges, list(by), "left") if by else df.crossJoin(F.broadcast(edges))
    below = F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(x)))
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), (below + 1).cast("long"))).drop("_edges")
