"""Queries on regional tables: ingest rules, joins, aggregates, ordered analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import semantics as S
from tessera.operators import ordered as O
from tessera.operators import regional as R
from tessera.plans.registry import query, r6

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CELLS = "cells AS (SELECT c_nationkey AS unit, p_type AS sector, sum(l_quantity) AS v, count(*) AS n FROM facts GROUP BY 1, 2)"
LQ = "lqs AS (SELECT unit, sector, v, n, (v / nullif(sum(v) OVER (PARTITION BY unit), 0)) / nullif(sum(v) OVER (PARTITION BY sector) / nullif(sum(v) OVER (), 0), 0) AS lq FROM cells)"
WIDE = ", ".join(f"max(CASE WHEN sector = '{t}' THEN lq END) AS lq_{t}" for t in TYPES)


def unit():
    return F.col("c_nationkey").alias("unit")


def flows(t):
    """Sums of the order lines by unit, sector and partner: the one aggregate of the facts that cells and partner sums come from."""
    return t.facts.groupBy(unit(), F.col("p_type").alias("sector"), F.col("s_nationkey").alias("partner")).agg(F.sum("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"))


def cells(t):
    return flows(t).groupBy("unit", "sector").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def lq(t):
    return R.location_quotient(cells(t), "unit", "sector", "v")


def wide_lq(t):
    return R.pivot_strict(lq(t), ["unit"], "sector", TYPES, "lq", "lq_")


@query(f"WITH {{FACTS}}, {CELLS}, {LQ} SELECT unit, sector, v, round(lq, 6) AS lq FROM lqs")
def q01_lq_by_nation_ptype(t):
    return lq(t).withColumn("lq", r6("lq"))




@query(f"WITH {{FACTS}}, {CELLS}, {LQ}, s AS (SELECT *, n < (SELECT avg(n) FROM cells) AS hidden FROM lqs) SELECT unit, {', '.join(f'''max(CASE WHEN sector = '{x}' AND NOT hidden THEN round(lq, 6) END) AS lq_{x}''' for x in TYPES)}, CAST(sum(CASE WHEN hidden THEN 1 ELSE 0 END) AS BIGINT) AS n_suppressed FROM s GROUP BY unit")
def q02_lq_wide_suppressed(t):
    c = cells(t)
    hidden = c.crossJoin(F.broadcast(c.agg(F.avg("n").alias("least")))).select("unit", "sector", (F.col("n") < F.col("least")).alias("hidden"))
    shown = lq(t).join(hidden, ["unit", "sector"]).withColumn("lq", F.when(~F.col("hidden"), r6("lq")))
    wide = R.pivot_strict(shown, ["unit"], "sector", TYPES, "lq", "lq_")
    return wide.join(hidden.groupBy("unit").agg(F.sum(F.col("hidden").cast("long")).alias("n_suppressed")), "unit")


@query("WITH {FACTS} SELECT c_nationkey AS unit, " + ", ".join(f"coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 0.0) AS out_{f}" for f in "ANRX") + " FROM facts GROUP BY 1")
def q03_commodity_breakdown(t):
    return R.pivot_sum(t.facts.withColumn("unit", unit()), ["unit"], "l_returnflag", list("ANRX"), "l_quantity", "out_")


@query("WITH {FACTS}, p AS (SELECT c_nationkey AS unit, s_nationkey AS partner, sum(l_quantity) AS v FROM facts GROUP BY 1, 2) SELECT unit, round(sum(v * v) / pow(sum(v), 2), 6) AS hhi FROM p GROUP BY unit")
def q04_partner_hhi(t):
    return R.herfindahl(t.facts.select(unit(), F.col("s_nationkey").alias("partner"), "l_quantity"), ["unit"], "partner", "l_quantity").withColumn("hhi", r6("hhi"))


@query("WITH {FACTS}, p AS (SELECT f.n_regionkey AS unit, CASE WHEN g.n_regionkey < 4 THEN 'm' || g.n_regionkey ELSE CAST(s_nationkey AS VARCHAR) END AS partner, sum(l_quantity) AS v FROM facts f JOIN nation g ON f.s_nationkey = g.n_nationkey GROUP BY 1, 2) SELECT unit, round(sum(v * v) / pow(sum(v), 2), 6) AS hhi FROM p WHERE partner <> 'm' || unit GROUP BY unit")
def q05_market_hhi(t):
    groups = t.nation.where("n_regionkey < 4").select("n_nationkey", F.concat(F.lit("m"), "n_regionkey").alias("market"))
    flows = R.remap(t.facts.select(F.col("n_regionkey").alias("unit"), F.col("s_nationkey").alias("partner"), "l_quantity"), "partner", groups, "n_nationkey", "market")
    return R.herfindahl(flows.where(F.col("partner") != F.concat(F.lit("m"), "unit")), ["unit"], "partner", "l_quantity").withColumn("hhi", r6("hhi"))


@query("WITH {FACTS} SELECT n_regionkey AS market, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS discount_ratio, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS unit_price FROM facts GROUP BY 1")
def q06_ratio_of_sums(t):
    f = t.facts.withColumn("cut", F.col("l_extendedprice") * F.col("l_discount"))
    return f.groupBy(F.col("n_regionkey").alias("market")).agg(r6(R.ratio_of_sums("cut", "l_extendedprice")).alias("discount_ratio"), r6(R.ratio_of_sums("l_extendedprice", "l_quantity"), 4).alias("unit_price"))


@query("SELECT c_nationkey AS unit, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal * (c_custkey % 7) END) / nullif(sum(CASE WHEN c_acctbal >= 0 THEN c_custkey % 7 END), 0), 6) AS balance FROM customer GROUP BY 1")
def q07_weighted_mean(t):
    c = t.customer.withColumn("v", S.non_negative("c_acctbal")).withColumn("w", F.col("c_custkey") % 7)
    return c.groupBy(F.col("c_nationkey").alias("unit")).agg(r6(R.weighted_mean("v", "w")).alias("balance"))


@query("WITH {FACTS}, u AS (SELECT c_nationkey AS unit, n_regionkey AS market, log10(sum(l_quantity)) AS lv, sum(CASE WHEN p_type = 'PROMO' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS share FROM facts GROUP BY 1, 2) SELECT market, round(sum(share * pow(10, lv)) / sum(pow(10, lv)), 6) AS promo_share, round(log10(sum(pow(10, lv))), 6) AS log_volume FROM u GROUP BY 1")
def q08_volume_weighted_share(t):
    u = t.facts.groupBy(unit(), F.col("n_regionkey").alias("market")).agg(F.log10(F.sum("l_quantity")).alias("lv"), (F.sum(F.when(F.col("p_type") == "PROMO", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("share"))
    w = F.coalesce(F.pow(F.lit(10.0), "lv"), F.lit(1.0))
    return u.groupBy("market").agg(r6(R.weighted_mean("share", w)).alias("promo_share"), r6(R.sum_of_logs("lv")).alias("log_volume"))


@query("WITH {YEARLY}, b AS (SELECT *, lag(total, 3) OVER (PARTITION BY unit ORDER BY year) AS back, row_number() OVER (PARTITION BY unit ORDER BY year DESC) AS r FROM yearly) SELECT unit, round((total - back) / 3, 2) AS velocity, round(((total - back) / 3) / nullif(total, 0) * 100, 6) AS velocity_pct FROM b WHERE r = 1")
def q09_velocity3(t):
    v = R.velocity(t.yearly, "unit", "year", "total")
    return v.select("unit", r6("velocity", 2).alias("velocity"), r6(S.ratio("velocity", "total_latest") * 100).alias("velocity_pct"))


@query("WITH {YEARLY}, a AS (SELECT year, sum(total) / sum(n) AS nat FROM yearly GROUP BY 1) SELECT unit, round(avg(total / n / nat), 6) AS mean_norm, round(stddev_samp(total / n / nat), 6) AS sd_norm, count(*) AS n_years FROM yearly JOIN a USING (year) GROUP BY unit")
def q10_panel_summary(t):
    national = t.yearly.groupBy("year").agg(R.ratio_of_sums("total", "n").alias("nat"))
    x = t.yearly.join(F.broadcast(national), "year").withColumn("x", S.ratio(S.ratio("total", "n"), "nat"))
    return x.groupBy("unit").agg(r6(F.avg("x")).alias("mean_norm"), r6(F.stddev_samp("x")).alias("sd_norm"), F.count(F.lit(1)).alias("n_years"))


@query("WITH {YEARLY}, b AS (SELECT *, lag(total) OVER (PARTITION BY unit ORDER BY year) AS prev, row_number() OVER (PARTITION BY unit ORDER BY year DESC) AS r FROM yearly) SELECT unit, year, round(abs(total - prev) / nullif(prev, 0), 6) AS move FROM b WHERE r = 1")
def q11_yoy_move(t):
    w = Window.partitionBy("unit")
    b = t.yearly.withColumn("prev", F.lag("total").over(w.orderBy("year"))).withColumn("r", F.row_number().over(w.orderBy(F.desc("year"))))
    return b.where("r = 1").select("unit", "year", r6(S.ratio(F.abs(F.col("total") - F.col("prev")), "prev")).alias("move"))


@query("WITH {YEARLY}, e AS (SELECT unit, max(CASE WHEN year = 1995 THEN total END) AS a, max(CASE WHEN year = 2000 THEN total END) AS b FROM yearly GROUP BY 1) SELECT unit, round(ln(b / a), 6) AS growth FROM e WHERE a > 0 AND b > 0")
def q12_endpoint_growth(t):
    e = t.yearly.groupBy("unit").agg(F.max(F.when(F.col("year") == 1995, F.col("total"))).alias("a"), F.max(F.when(F.col("year") == 2000, F.col("total"))).alias("b"))
    return e.where("a > 0 AND b > 0").select("unit", r6(F.ln(F.col("b") / F.col("a"))).alias("growth"))


@query(f"WITH {{FACTS}}, {CELLS}, {LQ} SELECT unit, sector AS dominant FROM lqs QUALIFY row_number() OVER (PARTITION BY unit ORDER BY lq DESC, sector) = 1")
def q13_dominant_sector(t):
    return wide_lq(t).select("unit", S.row_argmax([(x, f"lq_{x}") for x in TYPES]).alias("dominant"))


@query("WITH {YEARLY}, b AS (SELECT *, lag(total, 3) OVER w AS bt, lag(n, 3) OVER w AS bn, row_number() OVER (PARTITION BY unit ORDER BY year DESC) AS r FROM yearly WHERE year < 2001 WINDOW w AS (PARTITION BY unit ORDER BY year)) SELECT unit, CASE WHEN total - bt >= 0 AND n - bn <= 0 THEN 'both' WHEN total - bt >= 0 THEN 'growth' WHEN n - bn <= 0 THEN 'fewer' ELSE 'neither' END AS quadrant FROM b WHERE r = 1 AND bt IS NOT NULL AND bn IS NOT NULL")
def q14_quadrants(t):
    """Years up to 2000: the last year of the table is incomplete, and its totals would always fall."""
    y = t.yearly.where("year < 2001")
    v = R.velocity(y, "unit", "year", "total", out="a").join(R.velocity(y, "unit", "year", "n", out="b"), "unit")
    return v.select("unit", S.quadrant("a", "b", ("both", "growth", "fewer", "neither")).alias("quadrant")).where("quadrant is not null")


@query("SELECT CASE WHEN n < 8 THEN 'few' WHEN n < 12 THEN 'some' ELSE 'many' END AS tier, count(*) AS units FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def q15_tiers_fixed(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    u = t.customer.select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return u.groupBy(S.fixed_bin("n", [0, 8, 12, 1 << 40], ["few", "some", "many"]).alias("tier")).agg(F.count(F.lit(1)).alias("units"))


@query("WITH s AS (SELECT c_custkey, c_acctbal AS b, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2), e AS (SELECT quantile_cont(b, 0.25) AS a1, quantile_cont(b, 0.5) AS a2, quantile_cont(b, 0.75) AS a3 FROM s) SELECT CAST(1 + CAST(b > a1 AS INT) + CAST(b > a2 AS INT) + CAST(b > a3 AS INT) AS BIGINT) AS quartile, count(*) AS units, round(avg(n), 6) AS mean_orders FROM s, e GROUP BY 1")
def q16_quartile_means(t):
    s = t.customer.join(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), F.col("c_custkey") == F.col("o_custkey"))
    return O.quantile_bin(s, "c_acctbal", 4, "quartile").groupBy("quartile").agg(F.count(F.lit(1)).alias("units"), r6(F.avg("n")).alias("mean_orders"))


@query("WITH e AS (SELECT quantile_cont(o_totalprice, 0.95) AS p95 FROM orders) SELECT o_orderpriority AS priority, CAST(sum(CAST(o_totalprice > p95 AS INT)) AS BIGINT) AS n_concentrated, CAST(sum(CAST(o_totalprice < 22000 AS INT)) AS BIGINT) AS n_low FROM orders, e GROUP BY 1")
def q17_reliability_flags(t):
    p95 = O.quantiles(t.orders, "o_totalprice", [0.95]).select(F.col("q")[0].alias("p95"))
    o = t.orders.crossJoin(F.broadcast(p95))
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.sum(F.coalesce(F.col("o_totalprice") > F.col("p95"), F.lit(False)).cast("long")).alias("n_concentrated"), F.sum((F.col("o_totalprice") < 22000).cast("long")).alias("n_low"))


EVENTS = ["click", "error", "purchase", "signup", "view"]
ATTR = "a AS (SELECT user_id, event_type, max(CASE WHEN k NOT IN (99, 1) THEN k END) AS k FROM (SELECT user_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1, 2), w AS (SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN k END) AS {e}" for e in EVENTS) + " FROM a GROUP BY 1)"


def attributes(t):
    k = F.get_json_object("props", "$.k").try_cast("long")
    long = t.events.select("user_id", "event_type", S.sentinel(k, 99, 1).alias("k")).groupBy("user_id", "event_type").agg(F.max("k").alias("k"))
    return R.pivot_strict(long, ["user_id"], "event_type", EVENTS, "k")


@query(f"WITH {ATTR} SELECT user_id, {', '.join(EVENTS)}, CASE WHEN view > 50 THEN 'view' WHEN signup > 50 THEN 'signup' WHEN purchase > 50 THEN 'purchase' WHEN error > 50 THEN 'error' WHEN click > 50 THEN 'click' ELSE 'Not classified' END AS kind FROM w")
def q18_typology_pivot(t):
    w = attributes(t)
    return w.withColumn("kind", S.last_true([(e, F.col(e) > 50) for e in EVENTS], "Not classified"))


@query(f"WITH {ATTR} SELECT distress, count(*) AS users FROM (SELECT {' + '.join(f'CAST(coalesce({e} > 80, false) AS BIGINT)' for e in EVENTS)} AS distress FROM w) GROUP BY 1")
def q19_distress_count(t):
    return attributes(t).select(S.row_sum(*[(F.col(e) > 80).cast("int") for e in EVENTS]).cast("long").alias("distress")).groupBy("distress").agg(F.count(F.lit(1)).alias("users"))


@query("SELECT c_mktsegment AS segment, count(*) AS units, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS rate, round(avg(CAST(c_acctbal > 0 AS INT)), 6) AS positive_share FROM customer GROUP BY 1")
def q20_category_rates(t):
    total = t.customer.agg(F.count(F.lit(1)).alias("all"))
    g = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("units"), r6(F.avg((F.col("c_acctbal") > 0).cast("int"))).alias("positive_share"))
    return g.crossJoin(F.broadcast(total)).select("segment", "units", r6(F.col("units") / F.col("all")).alias("rate"), "positive_share")


TIERS = "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END"


def tier(t):
    return t.orders.withColumn("tier", S.fixed_bin("o_totalprice", [0, 100000, 300000, float("inf")], ["low", "mid", "high"]))


@query(f"SELECT {TIERS} AS tier, round(count(*) / (SELECT count(*) FROM orders), 6) AS share_orders, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share_value, round(quantile_cont(o_totalprice, 0.5), 4) AS median_value FROM orders GROUP BY 1")
def q21_tier_totals_share(t):
    totals = t.orders.agg(F.count(F.lit(1)).alias("an"), F.sum("o_totalprice").alias("av"))
    g = tier(t).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    g = g.join(O.quantiles(tier(t), "o_totalprice", [0.5], ["tier"]).select("tier", r6(F.col("q")[0], 4).alias("median_value")), "tier")
    return g.crossJoin(F.broadcast(totals)).select("tier", r6(F.col("n") / F.col("an")).alias("share_orders"), r6(F.col("v") / F.col("av")).alias("share_value"), "median_value")


@query(f"SELECT coalesce(tier, 'corpus') AS tier, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS closed, round(avg(CAST(o_orderpriority LIKE '1%' AS INT)), 6) AS urgent, count(*) AS n FROM (SELECT *, {TIERS} AS tier FROM orders) GROUP BY ROLLUP (tier)")
def q22_tier_composition(t):
    g = tier(t).rollup("tier").agg(r6(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("closed"), r6(F.avg(F.col("o_orderpriority").startswith("1").cast("int"))).alias("urgent"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("tier", F.coalesce("tier", F.lit("corpus")))


@query("SELECT p_type AS sector, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, min(p_retailprice) AS low, max(p_retailprice) AS high, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 4) AS iqr, round(quantile_cont(p_retailprice, 0.99), 4) AS p99 FROM part GROUP BY 1")
def q23_distribution_summary(t):
    p = t.part.withColumnRenamed("p_type", "sector")
    g = p.groupBy("sector").agg(r6(F.avg("p_retailprice"), 4).alias("mean"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    g = g.join(O.quantiles(p, "p_retailprice", [0.25, 0.5, 0.75, 0.99], ["sector"]), "sector")
    return g.select("sector", "mean", r6(F.col("q")[1], 4).alias("median"), "low", "high", r6(F.col("q")[2] - F.col("q")[0], 4).alias("iqr"), r6(F.col("q")[3], 4).alias("p99"))


@query(f"WITH {{FACTS}}, {{YEARLY}}, {CELLS}, {LQ}, b AS (SELECT unit, {WIDE} FROM lqs GROUP BY unit), p AS (SELECT c_nationkey AS unit, s_nationkey AS partner, sum(l_quantity) AS v FROM facts GROUP BY 1, 2), d AS (SELECT unit, log10(greatest(sum(v), 1)) AS log_volume, sum(v * v) / pow(sum(v), 2) AS hhi FROM p GROUP BY 1), c AS (SELECT unit, (total - back) / 3 AS velocity FROM (SELECT *, lag(total, 3) OVER (PARTITION BY unit ORDER BY year) AS back, row_number() OVER (PARTITION BY unit ORDER BY year DESC) AS r FROM yearly) WHERE r = 1) SELECT n_nationkey AS unit, n_name AS name, n_regionkey AS region, {', '.join(f'round(lq_{x}, 6) AS lq_{x}' for x in TYPES)}, round(log_volume, 6) AS log_volume, round(hhi, 6) AS hhi, round(velocity, 2) AS velocity FROM nation LEFT JOIN b ON b.unit = n_nationkey LEFT JOIN d ON d.unit = n_nationkey LEFT JOIN c ON c.unit = n_nationkey")
def q24_star_matrix(t):
    f = flows(t)
    d = f.groupBy("unit").agg(r6(S.floored_log10(F.sum("v"))).alias("log_volume"))
    hhi = R.herfindahl(f, ["unit"], "partner", "v").withColumn("hhi", r6("hhi"))
    c = R.velocity(t.yearly, "unit", "year", "total").select("unit", r6("velocity", 2).alias("velocity"))
    b = wide_lq(t).select("unit", *[r6(f"lq_{x}").alias(f"lq_{x}") for x in TYPES])
    keys = t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return R.star(keys, "unit", [b, d, hhi, c])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q25_anti_join_audit(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT n_nationkey AS unit, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS has_rich_supplier FROM nation")
def q26_semi_flag(t):
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("unit")).distinct().withColumn("x", F.lit(True))
    return t.nation.select(F.col("n_nationkey").alias("unit")).join(rich, "unit", "left").select("unit", F.coalesce("x", F.lit(False)).alias("has_rich_supplier"))


@query("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS spend FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000), c AS (SELECT user_id AS k, avg(value) AS activity FROM events GROUP BY 1) SELECT coalesce(a.k, b.k, c.k) AS k, round(spend, 2) AS spend, balance, round(activity, 6) AS activity FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k")
def q27_outer_targets(t):
    a = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(r6(F.sum("o_totalprice"), 2).alias("spend"))
    b = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    c = t.events.groupBy(F.col("user_id").alias("k")).agg(r6(F.avg("value")).alias("activity"))
    return R.outer_merge("k", [a, b, c])


@query("SELECT c.c_custkey AS home, n AS partners FROM (SELECT c_custkey, substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 7) AS p FROM customer) c JOIN (SELECT substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 1, 7) AS p, count(*) AS n FROM orders GROUP BY 1) o USING (p)")
def q28_prefix_join(t):
    """Partners of each customer by the first seven of nine digits; they are counted by prefix before the join."""
    c = t.customer.select(F.col("c_custkey").alias("home"), F.substring(S.zfill("c_custkey", 9), 1, 7).alias("p"))
    o = t.orders.groupBy(F.substring(S.zfill("o_orderkey", 9), 1, 7).alias("p")).agg(F.count(F.lit(1)).alias("partners"))
    return c.join(o, "p").select("home", "partners")


PLACES = "g AS (SELECT n_nationkey AS unit, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.7 - 170 AS lon FROM nation), u AS (SELECT c_nationkey AS unit, avg(c_acctbal) AS a, CAST(count(*) AS DOUBLE) AS b FROM customer GROUP BY 1), z AS (SELECT g.unit, lat, lon, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM g JOIN u ON g.unit = u.unit), d AS (SELECT x.unit AS i, y.unit AS j, 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))) AS km, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS gap FROM z x JOIN z y ON x.unit < y.unit)"


def pairs(t):
    """Unordered pairs of nations; a theta join, whose size is that of the nation table squared and no larger."""
    g = t.nation.select(F.col("n_nationkey").alias("unit"), (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.7 - 170).alias("lon"))
    u = g.join(t.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("b")), "unit")
    m = u.agg(*[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = u.crossJoin(F.broadcast(m)).select("unit", "lat", "lon", *[((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")).alias(c) for c in "ab"])
    x, y = z.alias("x"), z.alias("y")
    return x.join(y, F.col("x.unit") < F.col("y.unit")).select(F.col("x.unit").alias("i"), F.col("y.unit").alias("j"), S.haversine("x.lat", "x.lon", "y.lat", "y.lon").alias("km"), F.sqrt(F.pow(F.col("x.a") - F.col("y.a"), 2) + F.pow(F.col("x.b") - F.col("y.b"), 2)).alias("gap"))


@query(f"WITH {PLACES} SELECT i, j, round(km, 3) AS km, round(gap, 6) AS gap FROM d")
def q29_pairs_distance(t):
    return pairs(t).select("i", "j", r6("km", 3).alias("km"), r6("gap").alias("gap"))


@query(f"WITH {PLACES}, q AS (SELECT quantile_cont(km, 0.75) AS far FROM d) SELECT i, j, round(gap, 6) AS gap FROM d, q WHERE km >= far ORDER BY round(gap, 6), i, j LIMIT 20")
def q30_gated_topk(t):
    d = pairs(t)
    return d.crossJoin(F.broadcast(d.agg(F.percentile("km", F.lit(0.75)).alias("far")))).where("km >= far").select("i", "j", r6("gap").alias("gap")).orderBy("gap", "i", "j").limit(20)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def q31_best_per_group(t):
    return R.best_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT c_nationkey AS unit, c_mktsegment AS segment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def q32_modal_value(t):
    return R.modal(t.customer.select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("segment")), ["unit"], "segment")


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY CAST('0x' || substr(md5(c_custkey || '-42'), 1, 8) AS BIGINT), c_custkey LIMIT 100")
def q33_keyed_sample(t):
    return R.keyed_sample(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", 100)


@query("WITH {FACTS}, a AS (SELECT n_regionkey AS market, c_nationkey, sum(l_quantity) AS q, sum(l_extendedprice) AS v FROM facts GROUP BY 1, 2) SELECT market, count(*) AS n_units, sum(q) AS quantity, round(sum(v) / sum(q), 4) AS unit_price, round(sum(q * v / q) / sum(q), 4) AS weighted_price FROM a GROUP BY 1")
def q34_market_aggregate(t):
    a = t.facts.groupBy(F.col("n_regionkey").alias("market"), "c_nationkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("v")).withColumn("price", S.ratio("v", "q"))
    return a.groupBy("market").agg(F.count(F.lit(1)).alias("n_units"), F.sum("q").alias("quantity"), r6(R.ratio_of_sums("v", "q"), 4).alias("unit_price"), r6(R.weighted_mean("price", "q"), 4).alias("weighted_price"))


@query("SELECT c_custkey, round(log10(greatest(s, 1)), 6) AS size FROM (SELECT c_custkey, sum(o_totalprice) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) WHERE s IS NOT NULL UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q35_size_proxy(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    return t.customer.select("c_custkey").join(s, "c_custkey", "left").select("c_custkey", r6(S.floored_log10("s")).alias("size"))


@query("SELECT 'a' AS side, o_custkey AS k FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 450000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'b', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 450000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q36_set_operations(t):
    a, b = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).select(F.lit("a").alias("side"), "k").unionByName(a.intersect(b).select(F.lit("b").alias("side"), "k"))


@query(f"WITH {{FACTS}}, {CELLS}, {LQ} SELECT unit, CAST(sum(CASE WHEN n < (SELECT avg(n) FROM cells) THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM lqs GROUP BY 1")
def q79_null_count_row(t):
    wide = q02_lq_wide_suppressed(t)
    return wide.select("unit", (F.lit(len(TYPES)) - S.row_count(*[f"lq_{x}" for x in TYPES])).alias("n_null"))


@query("WITH {YEARLY}, a AS (SELECT year, sum(total) / sum(n) AS nat FROM yearly GROUP BY 1) SELECT year, round(max(nat), 4) AS national, round(avg(total / n), 4) AS mean, round(quantile_cont(total / n, 0.5), 4) AS median FROM yearly JOIN a USING (year) GROUP BY 1")
def q81_year_profile(t):
    y = t.yearly.withColumn("x", S.ratio("total", "n"))
    medians = O.quantiles(y, "x", [0.5], ["year"]).select("year", r6(F.col("q")[0], 4).alias("median"))
    return y.groupBy("year").agg(r6(R.ratio_of_sums("total", "n"), 4).alias("national"), r6(F.avg("x"), 4).alias("mean")).join(medians, "year", "left")


@query("SELECT o_orderpriority AS level, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, count(*) AS n FROM orders GROUP BY 1")
def q77_mean_sem_by_level(t):
    x = F.col("o_totalprice")
    return t.orders.groupBy(F.col("o_orderpriority").alias("level")).agg(r6(F.avg(x), 4).alias("mean"), r6(F.stddev_samp(x) / F.sqrt(F.count(F.lit(1))), 4).alias("sem"), F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY 1), a AS (SELECT k FROM c ORDER BY round(total, 2) DESC, k LIMIT 200), b AS (SELECT k FROM c ORDER BY round(mean, 2) DESC, k LIMIT 200) SELECT k FROM a INTERSECT SELECT k FROM b")
def q78_ranklist_overlap(t):
    c = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(r6(F.sum("o_totalprice"), 2).alias("total"), r6(F.avg("o_totalprice"), 2).alias("mean"))
    return c.orderBy(F.desc("total"), "k").limit(200).select("k").intersect(c.orderBy(F.desc("mean"), "k").limit(200).select("k"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q76_tumbling_window(t):
    return t.events.groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))
