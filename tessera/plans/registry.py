"""Queries and their SQL twins, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, by attribute; reading one is lazy and prunes columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def facts(self) -> DataFrame:
        """Order lines with their customer's nation and region, part and supplier nation."""
        o = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.customer.select("c_custkey", "c_nationkey")
        p = self.part.select("p_partkey", "p_type", "p_brand")
        s = self.supplier.select("s_suppkey", "s_nationkey")
        joined = self.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        joined = joined.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.join(self.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))

    @property
    def yearly(self) -> DataFrame:
        """(unit, year, total, n): order totals of each nation and year."""
        o = self.orders.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return o.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


FACTS = "facts AS (SELECT l.*, o_custkey, o_orderdate, c_nationkey, n_regionkey, p_type, p_brand, s_nationkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey)"
YEARLY = "yearly AS (SELECT c_nationkey AS unit, CAST(year(o_orderdate) AS BIGINT) AS year, sum(o_totalprice) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("{FACTS}", FACTS).replace("{YEARLY}", YEARLY)
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
