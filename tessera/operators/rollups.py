"""Tables that sum up features, tiers, markets, clusters and scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import haversine, ratio
from tessera.operators.ordered import quantiles
from tessera.operators.regional import ratio_of_sums, sum_of_logs, weighted_mean
from tessera.operators.statistics import adjusted_rand, clean, corr, mean_vectors, spearman


def gated_pairs(pairs: DataFrame, distance: str, gap: str, keys: Sequence[str], most: int = 20, shares: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """(list, place, keys, distance, gap): of the pairs beyond the upper quantile of the distance those that differ least, of those
    within the lower one those that differ most. A report: `most` of each."""
    edges = quantiles(pairs, distance, shares, out="_q")
    near = pairs.crossJoin(F.broadcast(edges))
    out = None
    for name, gate, order in (("far", F.col(distance) >= F.col("_q")[1], F.asc("_g")), ("near", F.col(distance) <= F.col("_q")[0], F.desc("_g"))):
        part = near.where(gate).withColumn("_g", F.round(gap, 9)).orderBy(order, *keys).limit(most).select(F.lit(name).alias("list"), *keys, distance, gap)
        out = part if out is None else out.unionByName(part)
    return out


def size_scan(df: DataFrame, features: dict[str, str], proxy: str, second: str, least: int = 30, threshold: float = 0.7) -> DataFrame:
    """(feature, block, n, r, r_squared, is_proxy, r_second) of each feature against a size proxy and a second one, on the rows that
    have all three, by one aggregate; a feature with fewer rows than `least`, or constant on them, is left out."""
    parts = []
    for i, f in enumerate(features):
        x, a, b = clean(f), clean(proxy), clean(second)
        here = x.isNotNull() & a.isNotNull() & b.isNotNull()
        own = lambda v: F.when(here, v)  # noqa: B023, E731
        parts += [F.count_if(here).alias(f"n{i}"), corr(own(x), own(a)).alias(f"r{i}"), corr(own(x), own(b)).alias(f"s{i}")]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(block).alias("block"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"), F.col(f"s{i}").alias("r_second")) for i, (f, block) in enumerate(features.items())])
    found = df.agg(*parts).select(F.explode(rows).alias("f")).select("f.*").where((F.col("n") >= least) & F.col("r").isNotNull())
    return found.select("feature", "block", "n", "r", (F.col("r") * F.col("r")).alias("r_squared"), (F.abs("r") >= threshold).alias("is_proxy"), "r_second")


def tier_table(df: DataFrame, tier: str, shares: Sequence[str], medians: Sequence[str], flags: Sequence[str], value: str, before: str, after: str, other: str, large: float = 0.5) -> DataFrame:
    """One row a tier: its rows and their share, its share of the columns summed over all tiers, medians, the value's spread and
    extremes, flags, how much and how many rows moved between two vintages, the rank agreement of the vintages, and the value's
    relation with another column. A move is |after / before - 1|, known where both are."""
    move = F.abs(ratio(after, before) - 1)
    rows = df.where(F.col(tier).isNotNull()).withColumn("_move", move)
    total = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in shares])
    linked = F.when(F.col(value).isNotNull() & F.col(other).isNotNull(), F.col(value))
    g = rows.groupBy(tier).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in shares], F.max(value).alias("max"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        F.avg((F.col("_move") > large).cast("double")).alias("share_large_moves"), F.count("_move").alias("n_paired"), F.count(linked).alias("n_linked"), corr(value, other).alias("r_other"),
    )
    g = g.crossJoin(F.broadcast(total))
    out = [F.col("n"), ratio("n", "_n").alias("share_rows"), *[ratio(c, f"_{c}").alias(f"share_{c}") for c in shares], "max", *[f"n_{f}" for f in flags], "share_large_moves", "n_paired", "n_linked", "r_other"]
    found = g.select(tier, *out)
    spread = quantiles(rows, value, [0.25, 0.5, 0.75, 0.99], [tier]).select(tier, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("q")[3].alias("p99"))
    found = found.join(spread, tier, "left")
    for c in [*medians, "_move"]:
        found = found.join(quantiles(rows, c, [0.5], [tier]).select(tier, F.col("q")[0].alias(f"median_{c.strip('_')}")), tier, "left")
    for name, (x, y) in {"rank_stability": (before, after), "rank_other": (value, other)}.items():
        found = found.join(spearman(rows, x, y, [tier]).select(tier, F.col("rho").alias(name)), tier, "left")
    return found


def market_aggregate(df: DataFrame, group: str, weight: str, kinds: dict[str, tuple]) -> tuple[DataFrame, dict[str, str]]:
    """One row a group: n_units, the summed weight, and every column by its kind; and how each came about. Kinds: ("sum",),
    ("weighted",), ("ratio", numerator, denominator), ("log",) of summed levels behind a log10; the last two are re-derived from
    sums rather than averaged."""
    made: dict[str, Column] = {}
    source = {}
    for c, (kind, *of) in kinds.items():
        made[c] = {"sum": lambda: F.sum(c), "weighted": lambda: weighted_mean(c, weight), "ratio": lambda: ratio_of_sums(*of), "log": lambda: sum_of_logs(c)}[kind]()  # noqa: B023
        source[c] = {"sum": "summed", "weighted": f"weighted by {weight}"}.get(kind, "re-derived")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_units"), F.sum(weight).alias(weight), *[v.alias(c) for c, v in made.items()]), source


def allocation_trial(cells: DataFrame, unit: str, sector: str, zone: str, value: str, held: Column) -> DataFrame:
    """(method, n, mae, r): two fillings of held-out cells' quotients, held against the true ones. The zone's quotient stands in; or
    what a zone's known cells leave of its sector total is dealt to its held-out units by their size, which meets the total exactly."""
    rows = cells.withColumn("_held", held)
    units = rows.groupBy(unit, zone).agg(F.sum(value).alias("size"))
    sectors = rows.groupBy(sector).agg(F.sum(value).alias("in_sector"))
    zones = rows.groupBy(zone, sector).agg(F.sum(value).alias("in_zone"), F.sum(F.when(~F.col("_held"), F.col(value))).alias("known"))
    total = rows.agg(F.sum(value).alias("all"))
    every = rows.join(units, [unit, zone]).join(sectors, sector).join(zones, [zone, sector]).join(units.groupBy(zone).agg(F.sum("size").alias("zone_size")), zone)
    open_ = every.where("_held").groupBy(zone, sector).agg(F.sum("size").alias("open_size"))
    base = ratio("in_sector", "all")
    trial = every.where("_held").join(open_, [zone, sector]).crossJoin(F.broadcast(total)).select(
        ratio(ratio(value, "size"), base).alias("lq"), ratio(ratio("in_zone", "zone_size"), base).alias("zone"),
        ratio((F.col("in_zone") - F.coalesce("known", F.lit(0.0))) / F.col("open_size"), base).alias("allocated"),
    )
    both = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("guess")) for m in ("zone", "allocated")])
    return trial.select("lq", F.explode(both).alias("m")).select("lq", "m.*").groupBy("method").agg(F.count("guess").alias("n"), F.avg(F.abs(F.col("lq") - F.col("guess"))).alias("mae"), corr("lq", "guess").alias("r"))


def cluster_distances(df: DataFrame, key: str, label: str, lat: str, lon: str) -> DataFrame:
    """(label, n, mean_km, corpus_km): the mean distance of a cluster's pairs, and of all pairs. For tables of units: a pair is met once,
    in a triangular join."""
    a = df.select(F.col(key).alias("k1"), F.col(label).alias("l1"), F.col(lat).alias("a1"), F.col(lon).alias("o1"))
    b = df.select(F.col(key).alias("k2"), F.col(label).alias("l2"), F.col(lat).alias("a2"), F.col(lon).alias("o2"))
    pairs = a.join(b, F.col("k1") < F.col("k2")).withColumn("km", haversine("a1", "o1", "a2", "o2"))
    whole = pairs.agg(F.avg("km").alias("corpus_km"))
    inside = pairs.where("l1 = l2").groupBy(F.col("l1").alias(label)).agg(F.avg("km").alias("mean_km"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(inside, label, "left").crossJoin(F.broadcast(whole)).select(label, "n", "mean_km", "corpus_km")


def label_agreement(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(a, b, ari) of every two labellings of the same rows, such as clusterings from several seeds."""
    out = None
    for a, b in combinations(labels, 2):
        part = adjusted_rand(df.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari")
        out = part if out is None else out.unionByName(part)
    return out


def mean_pool(keys: DataFrame, key: str, chunks: DataFrame, vector: str, width: int) -> DataFrame:
    """(key, n_chunks, vector): the mean of each key's chunk vectors; the zero vector where it has none."""
    found = keys.select(key).join(mean_vectors(chunks, vector, width, [key]), key, "left")
    return found.select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"), F.coalesce("mean", F.array_repeat(F.lit(0.0), width)).alias("vector"))


def basket_summary(scores: DataFrame, placebos: DataFrame, targets: Sequence[str], full: str = "full") -> DataFrame:
    """(statistic, model, value) of one basket of targets: the full model's mean lift and how many targets it helps, every model's mean
    contribution and how many targets have it, and the noise floor, which is the placebos' mean, deviation and highest.

    Targets that have no score are counted as excluded. scores: as drop_one() gives them; placebos: (target, contribution)."""
    basket, wanted = scores.where(F.col("target").isin(*targets)), len(set(targets))
    row = lambda statistic, model, value: F.struct(F.lit(statistic).alias("statistic"), model.alias("model"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    head = basket.where(F.col("model") == full).agg(F.avg("lift_over_size").alias("lift"), F.count_if(F.col("lift_over_size") > 0).alias("up"), F.count_distinct("target").alias("n"))
    one = head.select(F.explode(F.array(row("n_targets", none, F.col("n")), row("n_excluded", none, F.lit(wanted) - F.col("n")), row("mean_lift", F.lit(full), F.col("lift")), row("n_helped", F.lit(full), F.col("up")))).alias("r"))
    by = basket.where("contribution_ablated IS NOT NULL").groupBy("model").agg(F.avg("contribution_ablated").alias("c"), F.count_if(F.col("contribution_ablated") > 0).alias("up"))
    two = by.select(F.explode(F.array(row("mean_contribution", F.col("model"), F.col("c")), row("n_positive", F.col("model"), F.col("up")))).alias("r"))
    floor = placebos.where(F.col("target").isin(*targets)).agg(F.avg("contribution").alias("m"), F.stddev_samp("contribution").alias("s"), F.max("contribution").alias("h"))
    three = floor.select(F.explode(F.array(row("noise_mean", none, F.col("m")), row("noise_sd", none, F.col("s")), row("noise_highest", none, F.col("h")))).alias("r"))
    return one.unionByName(two).unionByName(three).select("r.*")
