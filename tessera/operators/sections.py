"""Features of units made of ordered titled sections. A section table has a unit, an order, a title and a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.semantics import ratio


def positioned(s: DataFrame, unit: str, order: str) -> DataFrame:
    """With rank (from 0) and position: rank / (sections - 1), 0 for a single one."""
    w = Window.partitionBy(unit)
    ranked = s.withColumn("rank", F.row_number().over(w.orderBy(order)) - 1).withColumn("n_sections", F.count(F.lit(1)).over(w))
    return ranked.withColumn("position", ratio("rank", F.col("n_sections") - 1, 0.0))


def count_features(unit: str, order: str, title: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_sections"), F.countDistinct(title).alias("n_titles"), F.sum((title == "").cast("long")).alias("n_untitled"), F.max(order).cast("long").alias("max_id"), (F.max(order) + 1 - F.countDistinct(order)).cast("long").alias("n_gaps")]


def gini(sorted_values: Column) -> Column:
    """Of an ascending array; 0 for an empty one or a total that isn't positive."""
    n = F.size(sorted_values)
    total = F.aggregate(sorted_values, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(sorted_values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when((n > 0) & (total > 0), 2 * weighted / (n * total) - (n + 1) / n).otherwise(0.0)


def gini_of(df: DataFrame, unit: str, value: str, out: str = "gini") -> DataFrame:
    """By ranks rather than a collected list, so a unit of any size is sorted by Spark."""
    w = Window.partitionBy(unit).orderBy(value)
    r = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum(F.col(value).cast("double"))
    return r.groupBy(unit).agg(F.when(total > 0, 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0).alias(out))


def length_features(length: str, stub: int = 200) -> list[Column]:
    x, n = F.col(length), F.count(F.lit(1))
    return [F.sum(x).cast("long").alias("chars"), F.avg(x).alias("mean_chars"), F.percentile(x, F.lit(0.5)).alias("median_chars"), F.max(x).cast("long").alias("max_chars"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd_chars"), F.sum((x < stub).cast("long")).alias("n_stubs"), (F.sum((x < stub).cast("double")) / n).alias("stub_share"), ratio(F.max(x), F.sum(x), 0.0).alias("largest_share")]


def top_share(df: DataFrame, unit: str, value: str, k: int = 3, out: str = "top3_share") -> DataFrame:
    w = Window.partitionBy(unit).orderBy(F.desc(value))
    r = df.withColumn("_i", F.row_number().over(w))
    return r.groupBy(unit).agg(ratio(F.sum(F.when(F.col("_i") <= k, F.col(value))), F.sum(value), 0.0).alias(out))


def decay_slope(df: DataFrame, unit: str, value: str, out: str = "decay_slope") -> DataFrame:
    """OLS slope of log1p(value) on its rank from the largest; 0 below two rows."""
    r = df.withColumn("_i", (F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(value))) - 1).cast("double"))
    return r.groupBy(unit).agg(F.coalesce(F.regr_slope(F.log1p(F.col(value).cast("double")), F.col("_i")), F.lit(0.0)).alias(out))


def vocabulary(df: DataFrame, unit: str, title: str, above: float) -> DataFrame:
    """(title, n_units, share) of titles that more than a share of the units have."""
    all_units = df.agg(F.countDistinct(unit).alias("_all"))
    counts = df.groupBy(title).agg(F.countDistinct(unit).alias("n_units"))
    return counts.crossJoin(F.broadcast(all_units)).withColumn("share", F.col("n_units") / F.col("_all")).drop("_all").where(F.col("share") > above)


def conformity(df: DataFrame, unit: str, title: str, modal: float = 0.5, rare: float = 0.01) -> DataFrame:
    """Against the modal titles: Jaccard (1 if both are empty), modal titles that are missing, and rare titles; mean rarity is 1 - mean share.

    Counts over distinct (unit, title) rows joined with the titles' shares; no set is collected."""
    distinct = df.select(unit, title).distinct()
    shares = vocabulary(df, unit, title, -1.0).select(title, "share")
    n_modal = shares.agg(F.sum((F.col("share") > modal).cast("long")).alias("_modal"))
    both = distinct.join(shares, title).groupBy(unit).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("share") > modal).cast("long")).alias("_in"), F.sum((F.col("share") < rare).cast("long")).alias("n_rare"), (1 - F.avg("share")).alias("mean_rarity"))
    return both.crossJoin(F.broadcast(n_modal)).select(unit, ratio("_in", F.col("_n") + F.col("_modal") - F.col("_in"), 1.0).alias("jaccard"), (F.col("_modal") - F.col("_in")).alias("n_missing"), "n_rare", "mean_rarity")


def joined_text(order: str, text: str, sep: str = " ", where: Column | None = None) -> Column:
    """An aggregate: texts in order, joined; bounded by the sections of one unit."""
    rows = F.struct(order, text)
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows if where is None else F.when(where, rows))), lambda r: r[text]), sep)


def densities(text: str) -> list[Column]:
    """Aggregates: shares of character classes in a unit's characters, 0 without any."""
    total = F.sum(F.length(text))
    return [ratio(F.sum(F.regexp_count(text, F.lit(p))), total, 0.0).alias(n) for n, p in (("digit_share", "[0-9]"), ("upper_share", "[A-Z]"), ("comma_share", ","), ("stop_share", r"\."))]


def title_flags(s: DataFrame, unit: str, title: Column, vocabulary: Sequence[str], prefix: str = "has_title_") -> DataFrame:
    """One 0/1 column for each title of the vocabulary, by one aggregate; two titles with one slug raise."""
    slugs: dict[str, str] = {}
    for v in vocabulary:
        name = re.sub(r"[^a-z0-9]+", "_", v.lower()).strip("_") or "untitled"
        if name in slugs:
            raise ValueError(f"titles {slugs[name]!r} and {v!r} share the column {name!r}")
        slugs[name] = v
    return s.groupBy(unit).agg(*[F.max((title == v).cast("double")).alias(prefix + name) for name, v in slugs.items()])


def bucket_shares(s: DataFrame, unit: str, bucket: str, amount: str, buckets: Sequence[str], prefix: str = "share_") -> DataFrame:
    """Each bucket's share of a unit's amount, absent ones 0; a unit without any amount is all of the last bucket."""
    parts = [F.coalesce(F.sum(F.when(F.col(bucket) == b, F.col(amount))), F.lit(0)).cast("double").alias(f"_{b}") for b in buckets]
    sums = s.groupBy(unit).agg(*parts)
    total = sum((F.col(f"_{b}") for b in buckets), F.lit(0.0))
    return sums.select(unit, *[F.coalesce(ratio(f"_{b}", total), F.lit(float(b == buckets[-1]))).alias(prefix + b) for b in buckets])


def bucket_densities(s: DataFrame, unit: str, bucket: str, text: str, buckets: Sequence[str], pattern: str, prefix: str = "density_") -> DataFrame:
    """How often a pattern occurs for each character of a unit's texts of each bucket; 0 without any character."""
    mine = lambda b, x: F.sum(F.when(F.col(bucket) == b, x))
    return s.groupBy(unit).agg(*[ratio(mine(b, F.regexp_count(text, F.lit(pattern))), mine(b, F.length(text)), 0.0).alias(prefix + b) for b in buckets])


def section_lexicon(units: DataFrame, s: DataFrame, unit: str, order: str, title: str, text: str, scope: str = "economy", prefix: str = "sec_", edges: Callable[[str], str] = T.unicode) -> DataFrame:
    """For each unit: whether its sections in a scope, joined in order, hold the industries' words, how many do, whether it has
    such a section, and its number of sections. Units without one get false and 0. edges: of words, T.unicode or T.ascii_only."""
    inside = T.in_scope(title, scope)
    # The texts of one unit's sections are joined, so that a phrase across their border counts.
    found = s.groupBy(unit).agg(joined_text(order, text, where=inside).alias("_text"), F.max(inside.cast("int")).alias("_has"), F.count(F.lit(1)).alias("_n"))
    flags = T.flags(F.coalesce("_text", F.lit("")), T.INDUSTRY, edges)
    out = units.select(unit).join(found, unit, "left").select(unit, *[c.alias(prefix + n) for n, c in flags.items()], (F.coalesce("_has", F.lit(0)) == 1).alias(f"has_{scope}_section"), F.coalesce("_n", F.lit(0)).alias("n_body_sections"))
    return out.withColumn(f"{prefix}n_industry_mentions", sum((F.col(prefix + n).cast("long") for n in flags), F.lit(0)))


def assembled(units: DataFrame, s: DataFrame, unit: str, lead: str, tier: str, order: str, title: str, text: str, scopes: dict[str, str]) -> DataFrame:
    """(unit, text): a unit's lead, and for the tiers with a scope its sections of that scope in order, joined by spaces."""
    tiers = units.select(unit, tier)
    wanted = F.lit(False)
    for name, scope in scopes.items():
        wanted = wanted | ((F.col(tier) == name) & T.in_scope(title, scope))
    more = s.join(tiers, unit).groupBy(unit).agg(joined_text(order, text, where=wanted).alias("_more"))
    return units.join(more, unit, "left").select(unit, T.squeeze(F.concat_ws(" ", F.coalesce(lead, F.lit("")), F.coalesce("_more", F.lit("")))).alias("text"))
