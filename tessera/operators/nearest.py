"""Exact nearest neighbours by cosine inside groups, without joining a group with itself.

The vectors of a group of more than ROWS are dealt to the nearest of some pivots, about the square root of its size. Angles obey the triangle
inequality: nothing in a cell is nearer to a vector than its angle to the cell's pivot less the cell's radius. So each vector
first looks through its own cell, and then only into cells that this bound doesn't exclude. For that, vectors stay in blocks of about
BLOCK: a block names the cells that one of its vectors may need, only those meet it, one block of them at a time, and inside each
vector skips the cells that it doesn't need. So no row is written for a vector and a cell. All comparisons are products of
matrices over parts of bounded size, and hot groups and cells are many parts. Where vectors are spread evenly in many
dimensions the bound excludes little, and an exact search compares most pairs, in any order of theirs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import unit_vector
from tessera.operators.staging import cut
from tessera.operators.statistics import uniform

#: Vectors of a part that are compared at a time, those that are held against the pivots at a time, and a group's pivots at most.
ROWS, DEALT, PIVOTS = 1024, 4096, 1024
#: Vectors of a block on average, which look into other cells together.
BLOCK = 16384
#: More than the rounding of an angle.
SLACK = 1e-6


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def part_of(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.greatest(parts, F.lit(1))).cast("int")


def deal(key: tuple, points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each point's cell, the pivot's place in the order of their ids, and its angle to it."""
    if points.empty:
        return pd.DataFrame({"g": [], "id": [], "v": [], "n": [], "cell": [], "angle": []})
    pivots = pivots.sort_values("id")
    a = angles(matrix(points["v"]), matrix(pivots["v"]))
    best = a.argmin(axis=1)
    return points[["g", "id", "v", "n"]].assign(cell=pivots["cell"].to_numpy()[best], angle=a[np.arange(len(a)), best])


def bounds(points: pd.DataFrame, v: np.ndarray, cells: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(points, cells): whether another cell may hold something nearer than a point has found."""
    found = np.arccos(np.clip(points["best"].fillna(-1.0).to_numpy(), -1.0, 1.0))
    return (angles(v, centres) - radius < found[:, None] + SLACK) & (points["cell"].to_numpy()[:, None] != cells)


def visits(key: tuple, points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The cells that one of a block's points may need."""
    if points.empty or pivots.empty:
        return pd.DataFrame({"g": [], "block": [], "cell": []})
    cells, centres, needed = pivots["cell"].to_numpy(), matrix(pivots["v"]), np.zeros(len(pivots), bool)
    for i in range(0, len(points), ROWS):
        part = points.iloc[i : i + ROWS]
        needed |= bounds(part, matrix(part["v"]), cells, centres, pivots["radius"].to_numpy()).any(axis=0)
    return pd.DataFrame({"g": key[0], "block": key[1], "cell": cells[needed]})


def further(key: tuple, points: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """(id, best) of a block's points in a part of the cells that they need; of each cell its own middle and radius tell who needs it."""
    if points.empty or targets.empty:
        return pd.DataFrame({"id": [], "best": []})
    cells, held = [], []
    for cell, own in targets.groupby("cell", sort=False):
        cells.append(cell)
        held.append(matrix(own["v"]))
    middles = np.stack([m.mean(axis=0) for m in held])
    size = np.linalg.norm(middles, axis=1, keepdims=True)
    middles = np.where(size > 0, middles / np.where(size > 0, size, 1), np.stack([m[0] for m in held]))
    radius = np.array([angles(m, c[None]).max() for m, c in zip(held, middles)])
    best = np.full(len(points), -np.inf)
    for i in range(0, len(points), ROWS):
        part = points.iloc[i : i + ROWS]
        v = matrix(part["v"])
        for k, who in enumerate(bounds(part, v, np.array(cells), middles, radius).T):
            rows = np.flatnonzero(who)
            for j in range(0, len(held[k]) if len(rows) else 0, ROWS):
                best[i + rows] = np.maximum(best[i + rows], (v[rows] @ held[k][j : j + ROWS].T).max(axis=1))
    known = np.isfinite(best)
    return pd.DataFrame({"id": points["id"].to_numpy()[known], "best": best[known]})


def top(key: tuple, queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    if queries.empty or targets.empty:
        return pd.DataFrame({"id": [], "best": []})
    near = matrix(queries["v"]) @ matrix(targets["v"]).T
    near[queries["id"].to_numpy()[:, None] == targets["id"].to_numpy()] = -np.inf
    best = near.max(axis=1)
    known = np.isfinite(best)
    return pd.DataFrame({"id": queries["id"].to_numpy()[known], "best": best[known]})


def apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can meet another table made from the same one."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def inside(targets: DataFrame) -> DataFrame:
    """(id, best) of each point against all others of its cell, part by part."""
    parts = F.ceil(F.col("size") / ROWS).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    a = targets.withColumn("qpart", part_of("id", parts)).withColumn("tpart", every)
    b = targets.withColumn("tpart", part_of("id", parts)).withColumn("qpart", every)
    by = ["g", "cell", "qpart", "tpart"]
    found = a.select(*by, "id", "v").groupBy(*by).cogroup(apart(b.select(*by, "id", "v")).groupBy(*by)).applyInPandas(top, "id long, best double")
    return found.groupBy("id").agg(F.max("best").alias("best"))


def nearest(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(key, best): the highest cosine of each vector to another one of its group. Keys are whole numbers and unique; rows without
    group or direction (null or zero vectors) are left out, and so is one that is alone in its group."""
    points = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("id"), unit_vector(vector).alias("v")).where(F.exists("v", lambda x: x != 0))
    points = points.join(points.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    share = F.when(F.col("n") > ROWS, F.least(F.lit(float(PIVOTS)), F.sqrt(F.col("n").cast("double"))) / F.col("n")).otherwise(0.0)
    order = F.xxhash64("id", F.lit(7))
    first = points.groupBy("g").agg(F.min_by(F.struct("id", "v", "n"), order).alias("p")).select("g", "p.*")
    pivots = points.where(uniform(F.col("id"), F.lit(3)) < share).unionByName(first.select(*points.columns)).dropDuplicates(["g", "id"])
    pivots = pivots.withColumn("cell", F.col("id"))
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = points.withColumn("part", part_of("id", parts)).groupBy("g", "part").cogroup(apart(pivots.withColumn("part", every)).groupBy("g", "part")).applyInPandas(deal, "g string, id long, v array<double>, n long, cell long, angle double")
    dealt = cut(dealt)
    cells = dealt.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"))
    targets = dealt.join(cells, ["g", "cell"])
    own = cut(inside(targets))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # A cell is in one block, a hot one in several.
    targets = targets.withColumn("block", F.pmod(F.xxhash64("cell", part_of("id", F.ceil(F.col("size") / ROWS))), blocks).cast("int"))
    seen = cut(targets.join(own, "id", "left").select("g", "block", "id", "v", "n", "cell", "best"))
    known = pivots.select("g", "cell", "v", "n").join(cells, ["g", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    needed = seen.groupBy("g", "block").cogroup(apart(known).groupBy("g", "block")).applyInPandas(visits, "g string, block int, cell long")
    queries = seen.withColumn("tpart", F.explode(F.sequence(F.lit(0), blocks - 1)))
    by = ["g", "block", "tpart"]
    met = apart(seen.select("g", "cell", F.col("block").alias("tpart"), "v")).join(needed, ["g", "cell"])
    others = queries.select(*by, "id", "v", "cell", "best").groupBy(*by).cogroup(apart(met.select(*by, "v", "cell")).groupBy(*by)).applyInPandas(further, "id long, best double")
    return own.unionByName(others).groupBy(F.col("id").alias(key)).agg(F.max("best").alias("best"))
