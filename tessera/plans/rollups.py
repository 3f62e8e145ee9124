"""Queries that sum up tiers, markets, pairs and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rollups as U
from tessera.operators import statistics as ST
from tessera.plans.regions import PLACES, cells, pairs
from tessera.plans.registry import query, r6
from tessera.plans.sweeps import BUYERS, buyers


@query(f"WITH {PLACES}, q AS (SELECT quantile_cont(km, 0.25) AS near, quantile_cont(km, 0.75) AS far FROM d) SELECT * FROM (SELECT 'far' AS list, i, j, round(km, 3) AS km, round(gap, 6) AS gap FROM d, q WHERE km >= far ORDER BY round(d.gap, 9), i, j LIMIT 20) UNION ALL SELECT * FROM (SELECT 'near', i, j, round(km, 3), round(gap, 6) FROM d, q WHERE km <= near ORDER BY round(d.gap, 9) DESC, i, j LIMIT 20)")
def q143_near_and_far(t):
    """Nations far apart that are alike, and nations close together that aren't."""
    return U.gated_pairs(pairs(t), "km", "gap", ["i", "j"]).select("list", "i", "j", r6("km", 3).alias("km"), r6("gap").alias("gap"))


SCANNED = {"bal": "A", "gap": "A", "seg": "B", "building": "B", "price": "C", "urgent": "C"}


@query(f"WITH {BUYERS}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, '{b}' AS block, {c} AS x, size AS a, spend AS s FROM buyers" for c, b in SCANNED.items()) + ") SELECT feature, block, count(*) AS n, round(corr(x, a), 6) AS r, round(corr(x, a) ** 2, 6) AS r_squared, abs(corr(x, a)) >= 0.5 AS is_proxy, round(corr(x, s), 6) AS r_second FROM f WHERE x IS NOT NULL AND a IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30 AND stddev_pop(x) > 0")
def q144_size_scan(t):
    """Every feature against the number of orders and, beside it, what they come to."""
    found = U.size_scan(buyers(t), SCANNED, "size", "spend", threshold=0.5)
    return found.select("feature", "block", "n", r6("r").alias("r"), r6("r_squared").alias("r_squared"), "is_proxy", r6("r_second").alias("r_second"))


MOVED = "x AS (SELECT c_custkey AS k, n_regionkey AS tier, avg(CASE WHEN year(o_orderdate) <= 1996 THEN o_totalprice END) AS before, avg(CASE WHEN year(o_orderdate) > 1996 THEN o_totalprice END) AS after, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS n_orders, c_acctbal AS bal, count(*) < 9 AS thin FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_regionkey, c_acctbal)"
RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY tier, p ORDER BY before) + (count(*) OVER (PARTITION BY tier, p, before) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY tier, p ORDER BY after) + (count(*) OVER (PARTITION BY tier, p, after) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY tier, p ORDER BY bal) + (count(*) OVER (PARTITION BY tier, p, bal) - 1) / 2.0 AS rl FROM (SELECT *, before IS NOT NULL AND after IS NOT NULL AS p FROM x)), l AS (SELECT tier, corr(ra, rl) AS rho FROM (SELECT tier, rank() OVER (PARTITION BY tier ORDER BY after) + (count(*) OVER (PARTITION BY tier, after) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY tier ORDER BY bal) + (count(*) OVER (PARTITION BY tier, bal) - 1) / 2.0 AS rl FROM x WHERE after IS NOT NULL) GROUP BY 1)"


@query(
    f"WITH {MOVED}, {RANKED}, a AS (SELECT count(*) AS n, sum(spend) AS spend, sum(n_orders) AS orders FROM x) SELECT x.tier, count(*) AS n, round(count(*) / any_value(a.n), 6) AS share_rows, round(sum(x.spend) / any_value(a.spend), 6) AS share_spend, round(sum(n_orders) / any_value(a.orders), 6) AS share_n_orders, round(max(after), 4) AS max, count(CASE WHEN thin THEN 1 END) AS n_thin, "
    "round(avg(CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN CAST(abs(after / before - 1) > 0.5 AS INT) END), 6) AS share_large_moves, count(CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN 1 END) AS n_paired, count(after) AS n_linked, round(corr(after, bal), 6) AS r_other, round(quantile_cont(after, 0.5), 4) AS median, round(quantile_cont(after, 0.75) - quantile_cont(after, 0.25), 4) AS iqr, round(quantile_cont(after, 0.99), 4) AS p99, round(median(bal), 4) AS median_bal, round(median(abs(after / before - 1)), 6) AS median_move, "
    "(SELECT round(corr(rb, ra), 6) FROM r WHERE p AND r.tier = x.tier) AS rank_stability, (SELECT round(rho, 6) FROM l WHERE l.tier = x.tier) AS rank_other FROM x, a GROUP BY x.tier"
)
def q145_tier_table(t):
    """Regions as tiers of customers: shares, spread, flags, moves between two spans of years and the agreement of ranks."""
    year = F.year("o_orderdate")
    c = t.customer.join(t.nation.select("n_nationkey", F.col("n_regionkey").alias("tier")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t.orders.groupBy("o_custkey").agg(F.avg(F.when(year <= 1996, F.col("o_totalprice"))).alias("before"), F.avg(F.when(year > 1996, F.col("o_totalprice"))).alias("after"), F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    x = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("tier", "before", "after", "spend", "n_orders", F.col("c_acctbal").alias("bal"), (F.col("n_orders") < 9).alias("thin"))
    found = U.tier_table(x, "tier", ["spend", "n_orders"], ["bal"], ["thin"], "after", "before", "after", "bal")
    four, six = ("max", "median", "iqr", "p99", "median_bal"), ("share_rows", "share_spend", "share_n_orders", "share_large_moves", "r_other", "median_move", "rank_stability", "rank_other")
    return found.withColumns({c: r6(c, 4) for c in four} | {c: r6(c) for c in six})


@query("WITH {FACTS}, a AS (SELECT n_regionkey AS market, c_nationkey, sum(l_quantity) AS q, sum(l_extendedprice) AS v, sum(l_extendedprice) / sum(l_quantity) AS price, log10(sum(l_extendedprice)) AS size, avg(l_discount) AS discount FROM facts GROUP BY 1, 2), w AS (SELECT market, count(*) AS n_units, sum(q) AS v1, sum(v) / sum(q) AS v2, log10(sum(v)) AS v3, sum(q * discount) / sum(q) AS v4 FROM a GROUP BY 1) SELECT market, n_units, 'price' AS name, round(v2, 6) AS value, 're-derived' AS provenance FROM w UNION ALL SELECT market, n_units, 'size', round(v3, 6), 're-derived' FROM w UNION ALL SELECT market, n_units, 'discount', round(v4, 6), 'weighted by q' FROM w UNION ALL SELECT market, n_units, 'v', round(v1 * v2, 6), 'summed' FROM w")
def q146_market_provenance(t):
    """Nations' columns by region, each with how it was made."""
    a = t.facts.groupBy(F.col("n_regionkey").alias("market"), "c_nationkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("discount"))
    a = a.withColumns({"price": F.col("v") / F.col("q"), "size": F.log10("v")})
    wide, source = U.market_aggregate(a, "market", "q", {"price": ("ratio", "v", "q"), "size": ("log",), "discount": ("weighted",), "v": ("sum",)})
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.lit(s).alias("provenance")) for c, s in source.items()])
    return wide.select("market", "n_units", F.explode(rows).alias("r")).select("market", "n_units", "r.name", r6("r.value").alias("value"), "r.provenance")


@query(
    "WITH {FACTS}, c AS (SELECT c_nationkey AS unit, n_regionkey AS zone, p_type AS sector, sum(l_quantity) AS v, (c_nationkey + length(p_type)) % 3 = 0 AS held FROM facts GROUP BY 1, 2, 3), u AS (SELECT unit, sum(v) AS size FROM c GROUP BY 1), s AS (SELECT sector, sum(v) AS ins FROM c GROUP BY 1), z AS (SELECT zone, sector, sum(v) AS inz, coalesce(sum(CASE WHEN NOT held THEN v END), 0) AS known FROM c GROUP BY 1, 2), zs AS (SELECT zone, sum(v) AS zsize FROM c GROUP BY 1), o AS (SELECT zone, sector, sum(size) AS osize FROM c JOIN u USING (unit) WHERE held GROUP BY 1, 2), "
    "t AS (SELECT v / size / (ins / (SELECT sum(v) FROM c)) AS lq, inz / zsize / (ins / (SELECT sum(v) FROM c)) AS zone_, (inz - known) / osize / (ins / (SELECT sum(v) FROM c)) AS allocated FROM c JOIN u USING (unit) JOIN s USING (sector) JOIN z USING (zone, sector) JOIN zs USING (zone) JOIN o USING (zone, sector) WHERE held) SELECT 'zone' AS method, count(*) AS n, round(avg(abs(lq - zone_)), 6) AS mae, round(corr(lq, zone_), 5) AS r FROM t UNION ALL SELECT 'allocated', count(*), round(avg(abs(lq - allocated)), 6), round(corr(lq, allocated), 5) FROM t"
)
def q147_allocation_trial(t):
    """Held-out cells by their zone's quotient, and by what the zone's known cells leave; a trial, never a default."""
    zones = t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("zone"))
    held = (F.col("unit") + F.length("sector")) % 3 == 0
    return U.allocation_trial(cells(t).join(zones, "unit"), "unit", "sector", "zone", "v", held).select("method", "n", r6("mae").alias("mae"), r6("r", 5).alias("r"))


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))))"


@query(f"WITH g AS (SELECT n_nationkey AS unit, n_regionkey AS region, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.7 - 170 AS lon FROM nation), d AS (SELECT x.region AS a, y.region AS b, {KM} AS km FROM g x JOIN g y ON x.unit < y.unit) SELECT region, count(*) AS n, (SELECT round(avg(km), 4) FROM d WHERE a = region AND b = region) AS mean_km, (SELECT round(avg(km), 4) FROM d) AS corpus_km FROM g GROUP BY 1")
def q148_cluster_distances(t):
    g = t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.7 - 170).alias("lon"))
    return U.cluster_distances(g, "unit", "region", "lat", "lon").select("region", "n", r6("mean_km", 4).alias("mean_km"), r6("corpus_km", 4).alias("corpus_km"))


def ari_sql(a: str, b: str) -> str:
    two = "sum(s * (s - 1) / 2)"
    return f"SELECT '{a}' AS a, '{b}' AS b, round((c - x * y / (m * (m - 1) / 2)) / ((x + y) / 2 - x * y / (m * (m - 1) / 2)), 6) AS ari FROM (SELECT (SELECT {two} FROM (SELECT count(*) AS s FROM l GROUP BY {a}, {b})) AS c, (SELECT {two} FROM (SELECT count(*) AS s FROM l GROUP BY {a})) AS x, (SELECT {two} FROM (SELECT count(*) AS s FROM l GROUP BY {b})) AS y, (SELECT count(*) FROM l) AS m)"


@query("WITH l AS (SELECT c_nationkey AS nation, c_custkey % 7 AS seven, c_nationkey // 5 AS band FROM customer) " + " UNION ALL ".join(ari_sql(a, b) for a, b in (("nation", "seven"), ("nation", "band"), ("seven", "band"))))
def q149_label_agreement(t):
    """How far three labellings of the customers agree, pair by pair."""
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("seven"), F.floor(F.col("c_nationkey") / 5).alias("band"))
    return U.label_agreement(rows, ["nation", "seven", "band"]).select("a", "b", r6("ari").alias("ari"))


@query("WITH k AS (SELECT DISTINCT label FROM embeddings UNION ALL SELECT 1 + max(label) FROM embeddings), p AS (SELECT label, d, avg(v) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT k.label, coalesce(n, 0) AS n_chunks, round(sqrt(coalesce((SELECT sum(m * m) FROM p WHERE p.label = k.label), 0)), 6) AS length FROM k LEFT JOIN n ON n.label = k.label")
def q150_pooled_vectors(t):
    """The length of each label's mean vector; a label without vectors has the zero vector."""
    e = t.embeddings.select("label", "embedding")
    width = ST.width_of(e, "embedding")
    keys = e.select("label").distinct().unionByName(e.agg((F.max("label") + 1).alias("label")))
    pooled = U.mean_pool(keys, "label", e, "embedding", width)
    return pooled.select("label", "n_chunks", r6(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("length"))
