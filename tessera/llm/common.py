"""What the operators of this package share: text columns, staged tables, worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package; a cluster ships it with its jobs."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from the session. Only a local session, which has a single
    machine, gets one of its own where none is set; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        path = f"{shared_dir(spark)}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        fs, place = file_system(spark, path)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _RUNS[app] = path
    return _RUNS[app]


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in tables:
        fs, place = file_system(df.sparkSession, df._staged_at)
        fs.delete(place, True)


def strings(values) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x if isinstance(x, str) else "" for x in values]


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What make() gives, kept in this process until another operator keeps something: a worker that serves one stage after
    another holds the caches of a single one."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def per_text(make: Callable[[], Callable[[str], tuple]], schema: str, names: list[str]) -> Callable[[Column], Column]:
    """A struct-valued function of a text column. make() runs once in each task and returns the function of one text."""

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = make()
        for texts in batches:
            yield pd.DataFrame([one(t) for t in strings(texts)], columns=names, dtype=object)

    return apply


def appended(df: DataFrame, column: Column, names: list[str]) -> DataFrame:
    """df with the fields of a struct column; own columns of the same names give way to them."""
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    hold = "_" + uuid.uuid4().hex[:8]
    return df.withColumn(hold, column).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{hold}.{n}").alias(n) for n in names])
