"""What models are made of: folds, shuffles and noise by hashes, components and curvature from sums of products, clusters and trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.operators.products import cross_products
from tessera.operators.regional import hash_number
from tessera.operators.staging import cut
from tessera.operators.statistics import r2, uniform


def random_fold(key: str, folds: int = 5, seed: int = 42) -> Column:
    return (hash_number(key, seed) % folds).cast("int")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, n, fold): whole groups, the largest first, to the fold with the fewest rows. One row a group reaches the driver."""
    sizes = sorted(((r[group], r["n"]) for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    load, out = [0] * folds, []
    for g, n in sizes:
        f = load.index(min(load))
        load[f] += n
        out.append((g, n, f))
    return df.sparkSession.createDataFrame(out, f"{group} {df.schema[group].dataType.simpleString()}, n long, fold int")


def shuffled(df: DataFrame, key: str, block: Sequence[str], turn: int) -> DataFrame:
    """df with a block's rows dealt to other rows: what stands at a place of one random order meets what stands at that place of the turn's own."""
    return shuffles(df, key, block, [turn]).drop("turn")


def shuffles(df: DataFrame, key: str, block: Sequence[str], turns: Sequence[int]) -> DataFrame:
    """(turn, ...): df once for each turn, with the block's rows dealt anew; all turns are one join."""
    left = numbered(df.drop(*block), key, 0)
    many = df.select(key, *block).withColumn("turn", F.explode(F.array(*map(F.lit, turns))))
    return left.join(numbered(many, key, 1, ["turn"]).drop(key), "position").drop("position")


def gaussian(width: int, key: str, draw: int, prefix: str = "noise") -> dict[str, Column]:
    """Standard normal columns fixed by key and draw (Box-Muller on hashes), the same in every evaluation."""
    two_pi = 2 * np.pi
    return {f"{prefix}_{i}": F.sqrt(-2 * F.ln(1 - uniform(F.col(key), F.lit(draw), F.lit(2 * i)))) * F.cos(two_pi * uniform(F.col(key), F.lit(draw), F.lit(2 * i + 1))) for i in range(width)}


def principal(df: DataFrame, columns: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained shares) from one gram; the largest weight of each component is positive."""
    g = cross_products(df.withColumn("_one", F.lit(0)), columns, ["_one"]).total(lambda k: True)
    n = g[0, 0]
    mean = g[0, 1:] / n
    values, vectors = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return mean, parts, values[order] / max(values.sum(), 1e-300)


def with_components(df: DataFrame, columns: Sequence[str], k: int, prefix: str = "pc") -> DataFrame:
    mean, parts, _ = principal(df, columns, k)
    return df.withColumns({f"{prefix}{i + 1}": sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, p)), F.lit(0.0)) for i, p in enumerate(parts)})


def curvature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squares, cubes and products of size columns without what the columns themselves explain, whitened; degenerate directions are
    dropped. The columns are standardised first, so that none is taken for degenerate for its unit."""
    about = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: (F.col(c) - F.lit(about[f"m_{i}"])) / F.lit(about[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}
    made = {f"{c}^2": z[c] * z[c] for c in columns} | {f"{c}^3": z[c] * z[c] * z[c] for c in columns}
    made |= {f"{a}*{b}": z[a] * z[b] for i, a in enumerate(columns) for b in columns[i + 1 :]}
    wide = df.withColumns(made)
    names, k = list(made), len(columns)
    g = cross_products(wide.withColumn("_one", F.lit(0)), [*columns, *names], ["_one"]).total(lambda k: True)
    n = g[0, 0]
    coef = np.linalg.lstsq(g[: k + 1, : k + 1], g[: k + 1, k + 1 :], rcond=None)[0]
    rest = g[k + 1 :, k + 1 :] - g[k + 1 :, : k + 1] @ coef
    values, vectors = np.linalg.eigh((rest + rest.T) / 2)
    keep = values > 1e-16 * max(values.max(), 1e-300) if values.max() > 0 else np.zeros(len(values), bool)
    keep &= np.sqrt(np.maximum(values, 0)) > 1e-8 * np.sqrt(max(values.max(), 1e-300))
    out = {}
    for j, (v, vec) in enumerate(zip(values[keep], vectors[:, keep].T)):
        w = vec * np.sqrt(n / v)
        fitted = coef @ w
        out[f"curve_{j}"] = sum((F.col(f"`{c}`") * float(x) for c, x in zip(names, w)), F.lit(0.0)) - sum((F.col(c) * float(x) for c, x in zip(columns, fitted[1:])), F.lit(float(fitted[0])))
    return wide.withColumns(out).drop(*names)


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seeds: int = 10, out: str = "cluster") -> DataFrame:
    """The best of several seeds by training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)
    rows = cut(plain)
    best = min((KMeans(k=k, seed=42 + s, featuresCol="_x", predictionCol=out).fit(rows) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_x")


#: What stands for a null in a boosted column, on either side of all values.
FAR = 1e12


def boosted(df: DataFrame, columns: Sequence[str], y: str, fold: str, trees: int = 200, step: float = 0.06, leaf: int = 40, depth: int = 5, bins: int = 32) -> DataFrame:
    """Out-of-fold predictions of gradient-boosted trees on the rows with a target.

    A null has a direction of its own at each split: a column with nulls is offered twice, with them below and above all its
    values, and a split that takes the one or the other sends them to that side (to either, where a split was grown without
    any). Columns of no value at all are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = df.where(F.col(y).isNotNull() & F.col(fold).isNotNull())
    known = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in columns]).first()
    made = {}
    for c in columns:
        if known[c] == known["_all"]:
            made[f"_{c}"] = F.col(c).cast("double")
        elif known[c]:
            made |= {f"_{c}_{side}": F.coalesce(F.col(c).cast("double"), F.lit(at)) for side, at in (("low", -FAR), ("high", FAR))}
    plain = cut(VectorAssembler(inputCols=list(made), outputCol="_x").transform(rows.withColumns(made)))
    model = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=trees, stepSize=step, minInstancesPerNode=leaf, maxDepth=depth, maxBins=bins, seed=42, predictionCol="predicted")
    parts = [model.fit(plain.where(F.col(fold) != f)).transform(plain.where(F.col(fold) == f)) for f in sorted(r[0] for r in rows.select(fold).distinct().collect())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_x", *made)


def boosted_lifts(df: DataFrame, baseline: Sequence[str], blocks: dict[str, Sequence[str]], y: str, fold: str, **settings) -> DataFrame:
    """(block, n, r2_baseline, r2_full, lift_gbm) of each block beside the baseline, in trees of the same settings."""
    score = lambda columns: boosted(df, columns, y, fold, **settings).agg(F.count(F.lit(1)).alias("n"), r2(y, "predicted").alias("r2")).first()
    low = score(list(baseline))
    rows = [(name, low["n"], low["r2"], high, high - low["r2"]) for name, block in blocks.items() for high in [score([*baseline, *block])["r2"]]]
    return df.sparkSession.createDataFrame(rows, "block string, n long, r2_baseline double, r2_full double, lift_gbm double")
