"""Hot buckets and connected components, for the operators on pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, staged


def cells(rows: DataFrame, key: str, ident: str, limit: int) -> DataFrame:
    """rows with cell_a, cell_b and part, so that any two rows of one key meet in a cell (key, cell_a, cell_b).

    A key of at most limit rows is one cell. A larger one is cut into parts by a hash of ident, and each pair of parts is a
    cell: its rows are spread over many tasks, none of which holds much more than twice the limit. Only counts of the large
    keys are joined; no row is dropped."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = counts.select(F.col(key).alias("_key"), F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
    parted = rows.join(large, F.col(key) == F.col("_key"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int"))
    other = parted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.withColumn("cell_a", F.least("part", "_other")).withColumn("cell_b", F.greatest("part", "_other")).drop("_key", "_parts", "_other")


def united(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By row, the smallest id of the rows that the links (i, j) between places connect it with, its own among them."""
    root = np.arange(len(ids))
    while len(i):  # the smaller of two roots wins until nothing changes
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    small = ids.copy()
    np.minimum.at(small, root, ids)
    return small[root]


#: Rounds after which components() gives up; each at least halves the longest path, so no input reaches it.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge (a, b) of longs: root is the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes. Links stay distributed; each round is written to
    the shared folder, and only a count and a checksum reach the driver. Joins are of two tables, so that Spark can split
    the partition of a node with very many links."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large_least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = staged(both.where("v > u").join(large_least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        old, now = now, staged(small.distinct(), "links")
        discard(old, large_least, large, least)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
