"""Sinks: stamped tables, dictionaries of columns, JSON statistics, summaries, idempotent enrichment."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.statistics import corr


def stamped(df: DataFrame, as_of_date: str) -> DataFrame:
    """df with a constant as_of_date (ISO); one that df has already gives way."""
    return df.drop("as_of_date").withColumn("as_of_date", F.lit(as_of_date))


def write_stamped(df: DataFrame, path: str, key: str, as_of_date: str) -> None:
    """One row a key; ValueError where a key is null or repeated."""
    from tessera.operators.regional import assert_unique

    if df.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} has nulls")
    stamped(assert_unique(df, key), as_of_date).write.mode("overwrite").parquet(path)


def from_records(spark, records: Sequence[dict], schema: str, explode: str | None = None) -> DataFrame:
    """A table of result records; a nested list can become rows."""
    df = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in records], schema)
    return df if explode is None else df.withColumn(explode, F.explode(explode)).select(*[c for c in df.columns if c != explode], f"{explode}.*")


def dictionary(df: DataFrame, described: dict[str, str], size: str | None = None, proxy_at: float = 0.3) -> DataFrame:
    """(column, dtype, description, nulls, fire_rate, size_r, size_tier) by one aggregate; an undocumented column raises."""
    if missing := [c for c in df.columns if c not in described]:
        raise ValueError(f"columns without a description: {missing}")
    number = {c for c, d in df.dtypes if d in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")}
    parts: list[Column] = []
    for i, c in enumerate(df.columns):
        v = F.col(c).cast("double") if c in number else F.lit(None).cast("double")
        parts += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.avg((v != 0).cast("int")).alias(f"f{i}"), (corr(v, size) if size and c in number and c != size else F.lit(None).cast("double")).alias(f"r{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("dtype"), F.lit(described[c]).alias("description"), F.col(f"n{i}").alias("nulls"), F.col(f"f{i}").alias("fire_rate"), F.col(f"r{i}").alias("size_r")) for i, (c, d) in enumerate(df.dtypes)])
    out = df.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("size_tier", F.when(F.col("size_r").isNull(), "unknown").when(F.abs("size_r") >= proxy_at, "size_proxy").otherwise("independent"))


def status(column: str, size: Sequence[str], identifiers: Sequence[str], diagnostics: Sequence[str]) -> str:
    return "identifier" if column in identifiers else "size control" if column in size else "diagnostic" if column in diagnostics else "ships"


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a result table; ValueError beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a summary")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def statistics_json(tables: dict[str, DataFrame]) -> str:
    """Small result tables as one JSON object: a single row as an object, several as a list."""
    out = {}
    for name, df in tables.items():
        rows = [r.asDict(recursive=True) for r in df.limit(10_001).collect()]
        if len(rows) > 10_000:
            raise ValueError(f"{name} is too large for statistics")
        out[name] = rows[0] if len(rows) == 1 else rows
    return json.dumps(out, indent=2, default=str)


def enrich(spark, path: str, columns: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> None:
    """Recompute columns of a table in place: earlier ones go first, the result is written beside the table and then renamed, so a failure leaves the old table whole."""
    fresh = f"{path}-{uuid.uuid4().hex}"
    compute(spark.read.parquet(path).drop(*columns)).write.parquet(fresh)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{path}-old-{uuid.uuid4().hex}"
    fs.rename(Path(path), Path(old))
    fs.rename(Path(fresh), Path(path))
    fs.delete(Path(old), True)
