"""Aggregations of keyed regional tables: shares, concentration, pivots, re-derivation on coarser groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import col, ratio
from tessera.functions.text import last_part


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or ValueError where a key occurs twice; pivots and one-to-one joins would choose a row silently."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)} isn't unique")
    return df


def location_quotient(cells: DataFrame, unit: str, sector: str, value: str, out: str = "lq") -> DataFrame:
    """(sector share in the unit) / (sector share overall), from one total for each unit and sector; null at a zero base.

    The base comes from the same rows by two small aggregates, whose sizes are those of the units and the sectors."""
    sums = cells.groupBy(unit, sector).agg(F.sum(value).alias("v"))
    units = sums.groupBy(unit).agg(F.sum("v").alias("unit_total"))
    sectors = sums.groupBy(sector).agg(F.sum("v").alias("sector_total"))
    both = sums.join(units, unit).join(sectors, sector).crossJoin(F.broadcast(sums.agg(F.sum("v").alias("all_total"))))
    return both.select(unit, sector, F.col("v").alias(value), ratio(ratio("v", "unit_total"), ratio("sector_total", "all_total")).alias(out))


def herfindahl(flows: DataFrame, keys: Sequence[str], partner: str, value: str, out: str = "hhi") -> DataFrame:
    """Sum of squared partner shares; null where the total isn't positive."""
    sums = flows.groupBy(*keys, partner).agg(F.sum(value).alias("v"))
    total = F.sum("v")
    return sums.groupBy(*keys).agg(F.when(total > 0, ratio(F.sum(F.col("v") * F.col("v")), total * total)).alias(out))


def remap(flows: DataFrame, partner: str, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Partners by their group; those without one keep their own key."""
    g = groups.select(F.col(key).alias("_k"), F.col(group).cast("string").alias("_g"))
    return flows.join(g, F.col(partner) == F.col("_k"), "left").withColumn(partner, F.coalesce("_g", F.col(partner).cast("string"))).drop("_k", "_g")


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], amount: str, prefix: str = "") -> DataFrame:
    """One column for each of the fixed values, absent ones 0, by conditional sums in a single aggregate."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(column) == v, F.col(amount))), F.lit(0.0)).alias(f"{prefix}{v}") for v in values])


def pivot_strict(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], amount: str, prefix: str = "") -> DataFrame:
    """One column for each of the fixed values, absent ones null. A second row for a cell raises when the result is computed: the
    same aggregate counts the cell's rows, so no job of its own checks them."""
    cells = []
    for v in values:
        mine = F.col(column) == v
        many = F.raise_error(F.lit(f"{', '.join(keys)}, {column} isn't unique at {v}"))
        cells.append(F.when(F.count_if(mine) > 1, many).otherwise(F.max(F.when(mine, F.col(amount)))).alias(f"{prefix}{v}"))
    return df.groupBy(*keys).agg(*cells)


def weighted_mean(value, weight) -> Column:
    """An aggregate that skips rows without a value; null where the weights don't sum above 0."""
    w = F.when(col(value).isNotNull(), col(weight))
    return F.when(F.sum(w) > 0, ratio(F.sum(col(value) * col(weight)), F.sum(w)))


def ratio_of_sums(a, b) -> Column:
    """An aggregate: sum(a) / sum(b) where sum(b) > 0."""
    return F.when(F.sum(col(b)) > 0, ratio(F.sum(col(a)), F.sum(col(b))))


def sum_of_logs(log_value) -> Column:
    """An aggregate: the log10 of the summed levels behind log10 values, not the sum of logs."""
    return F.log10(F.sum(F.pow(F.lit(10.0), col(log_value))))


def star(keys: DataFrame, key: str, blocks: Sequence[DataFrame]) -> DataFrame:
    """Left joins of blocks onto a key list; a column that two blocks share raises."""
    seen: set[str] = set(keys.columns)
    for b in blocks:
        if clash := (set(b.columns) - {key}) & seen:
            raise ValueError(f"columns in two blocks: {sorted(clash)}")
        seen |= set(b.columns)
        keys = keys.join(b, key, "left")
    return keys


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join whose keys must be unique on both sides."""
    return star(assert_unique(left, key), key, [assert_unique(right, key)])


def outer_merge(key: str, blocks: Sequence[DataFrame]) -> DataFrame:
    """All keys of any block: union of the blocks in long form and one aggregate, rather than a chain of full joins."""
    names = [c for b in blocks for c in b.columns if c != key]
    wide = None
    for b in blocks:
        part = b.select(key, *[(F.col(c) if c in b.columns else F.lit(None)).cast("double").alias(c) for c in names])
        wide = part if wide is None else wide.unionByName(part)
    return wide.groupBy(key).agg(*[F.max(c).alias(c) for c in names])


def velocity(df: DataFrame, unit: str, time: str, value: str, steps: int = 3, out: str = "velocity") -> DataFrame:
    """(last - the one `steps` observations before) / steps, by place among the observations; null with too few."""
    w = Window.partitionBy(unit).orderBy(time)
    back = df.where(F.col(value).isNotNull()).withColumn("_b", F.lag(value, steps).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(time))))
    return back.where("_r = 1").select(unit, ((F.col(value) - F.col("_b")) / steps).alias(out), F.col(value).alias(f"{value}_latest"))


def best_per_group(df: DataFrame, keys: Sequence[str], *order: Column, most: int = 1) -> DataFrame:
    """The first row of each group, or the first few; the order must end with a unique key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def modal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return best_per_group(counts, keys, F.desc("n"), F.asc(value))


def keyed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of key and seed that other engines have too: the same rows however the table is partitioned."""
    return df.orderBy(hash_number(key, seed), key).limit(n)


def hash_number(key: str, seed: int) -> Column:
    """A whole number below 2^32: the first eight hex digits of the MD5 of key, a dash and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def bh(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q values: the running minimum of p * m / rank from the largest p down, at most 1. For tables of test results, which are small."""
    up = Window.orderBy(p)
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def missing_by_place(df: DataFrame, name: str, value: str) -> DataFrame:
    """(state, n_missing, city_share, rate) of the rows without a value: by what follows the last comma of their display name, the
    share of independent cities among them, and their share of all rows."""
    everyone = df.agg(F.count(F.lit(1)).alias("_all"))
    gone = df.where(F.col(value).isNull()).groupBy(last_part(name).alias("state"))
    found = gone.agg(F.count(F.lit(1)).alias("n_missing"), F.avg(F.contains(F.col(name), F.lit(" City,")).cast("int")).alias("city_share"))
    return found.crossJoin(F.broadcast(everyone)).withColumn("rate", ratio("n_missing", "_all")).drop("_all")


def complete(keys: DataFrame, found: DataFrame, columns: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """All rows of keys, with defaults where found has none."""
    return keys.join(found, list(columns), "left").na.fill(defaults)


def feature_columns(columns: Sequence[str], identifiers: Sequence[str], size: Sequence[str]) -> list[str]:
    """A block's feature columns: all but identifiers and size controls."""
    return [c for c in columns if c not in {*identifiers, *size}]


def other_columns(blocks: dict[str, Sequence[str]], without: Sequence[str]) -> list[str]:
    """The columns of all blocks but the named ones; a column that two blocks share raises."""
    names = [c for b in blocks.values() for c in b]
    if len(set(names)) < len(names):
        raise ValueError(f"columns in two blocks: {sorted({c for c in names if names.count(c) > 1})}")
    return [c for name, b in blocks.items() if name not in without for c in b]
