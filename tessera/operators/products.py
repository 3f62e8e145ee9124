"""Sums of products of columns by cell: one aggregate, whose result depends on the number of columns and cells alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import quantiles

#: Up to this many columns the products are column expressions of one aggregate, beyond it products of matrices.
EXPRESSIONS = 24
Weights = np.ndarray


class Cells:
    """Sums of products of [1, columns] by cell; a cell's key is a tuple that begins with its fold."""

    def __init__(self, columns: Sequence[str], sums: dict[tuple, np.ndarray]):
        self.columns, self.sums = list(columns), sums
        self.at = {c: i + 1 for i, c in enumerate(self.columns)}

    @property
    def folds(self) -> list:
        return sorted({k[0] for k in self.sums})

    def total(self, wanted: Callable[[tuple], bool]) -> np.ndarray:
        size = len(self.columns) + 1
        return sum((m for k, m in self.sums.items() if wanted(k)), np.zeros((size, size)))

    def unit(self, column: str) -> Weights:
        w = np.zeros(len(self.columns) + 1)
        w[self.at[column]] = 1.0
        return w

    def design(self, columns: Sequence[str], fold=None) -> np.ndarray:
        """Weights of a model's columns, as one sees them that is tested on a fold."""
        return np.array([self.unit(c) for c in columns]).reshape(-1, len(self.columns) + 1)


class Filled(Cells):
    """Cells of columns that had nulls: 0 stands for a null, with a mark beside it. Filled with a value, such a column is itself plus
    value times mark, so each fold can fill it with the median of its own training rows. Models see the marks as well."""

    def __init__(self, columns: Sequence[str], sums: dict[tuple, np.ndarray], marks: dict[str, str], fills: dict[tuple, float]):
        super().__init__(columns, sums)
        self.marks, self.fills = marks, fills

    def design(self, columns: Sequence[str], fold=None) -> np.ndarray:
        holed = [c for c in columns if c in self.marks]
        rows = [self.unit(c) + (self.fills.get((c, fold), 0.0) * self.unit(self.marks[c]) if c in self.marks else 0.0) for c in columns]
        return np.array([*rows, *(self.unit(self.marks[c]) for c in holed)]).reshape(-1, len(self.columns) + 1)


def cross_products(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> Cells:
    """Rows with a null in any column or key are left out."""
    full = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    k = len(columns) + 1
    sums: dict[tuple, np.ndarray] = {}
    if len(columns) <= EXPRESSIONS:
        vector = [F.lit(1.0), *[F.col(c) for c in columns]]
        for r in full.groupBy(*by).agg(*[F.sum(vector[i] * vector[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).collect():
            m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            sums[tuple(r[b] for b in by)] = m
        return Cells(columns, sums)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(list(by), sort=False):
                v = np.hstack([np.ones((len(rows), 1)), rows[list(columns)].to_numpy(dtype=float)])
                held[key] = held.get(key, 0.0) + v.T @ v
        for key, m in held.items():
            place = np.arange(m.size)
            yield pd.DataFrame({**{b: [x] * m.size for b, x in zip(by, key)}, "_i": place, "_s": m.reshape(-1)})

    schema = ", ".join(f"{b} {full.schema[b].dataType.simpleString()}" for b in by) + ", _i int, _s double"
    for r in full.mapInPandas(products, schema).groupBy(*by, "_i").agg(F.sum("_s").alias("s")).collect():
        sums.setdefault(tuple(r[b] for b in by), np.zeros((k, k))).flat[r["_i"]] = r["s"]
    return Cells(columns, sums)


def fold_medians(df: DataFrame, columns: Sequence[str], fold: str, by: Sequence[str] = ()) -> dict[tuple, float]:
    """By (column, fold, by): the median over the rows of the other folds. Values are counted once by fold."""
    folds = [r[0] for r in df.select(fold).distinct().collect()]
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = df.select(fold, *by, F.explode(pairs).alias("p")).select(fold, *by, "p.c", "p.v").where("v IS NOT NULL").groupBy(fold, *by, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    others = F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col(fold)))
    every = counts.withColumn("without", others).groupBy("c", "without", *by, "v").agg(F.sum("n").alias("n"))
    return {(r["c"], r["without"], *(r[b] for b in by)): r["q"][0] for r in quantiles(every, "v", [0.5], ["c", "without", *by], "n").collect()}


def filled_cells(df: DataFrame, columns: Sequence[str], y: str, fold: str, by: Sequence[str] = (), turn: str | None = None) -> dict:
    """The cells of rows that have target, fold and keys, by turn (None without turns): nulls of the columns stay in, see Filled."""
    columns = [c for c in dict.fromkeys(columns) if c != y]
    keys = [fold, *by, *([turn] if turn else [])]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*columns, y]]).na.drop(subset=[*keys, y])
    gaps = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    marks = {c: f"{c} is null" for c in columns if gaps[c]}
    fills = fold_medians(rows, list(marks), fold, [turn] if turn else []) if marks else {}
    whole = rows.withColumns({m: F.col(c).isNull().cast("double") for c, m in marks.items()}).na.fill(0.0, list(marks))
    found = cross_products(whole, [*columns, *marks.values(), y], keys)
    out: dict = {}
    for k, m in found.sums.items():
        out.setdefault(k[-1] if turn else None, {})[k[:-1] if turn else k] = m
    return {t: Filled(found.columns, sums, marks, {k[:2]: v for k, v in fills.items() if not turn or k[2] == t}) for t, sums in out.items()}
