"""Queries on out-of-fold scores of feature blocks, and on what follows from score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import semantics as S
from tessera.operators import regional as R
from tessera.operators import scoring as C
from tessera.operators import statistics as ST
from tessera.plans.evaluation import UNITS, units
from tessera.plans.regions import CELLS, LQ, cells, lq
from tessera.plans.registry import query, r6

TIERS = ["few", "some", "many"]
FOLD = "CAST(CAST('0x' || substr(md5({} || '-42'), 1, 8) AS BIGINT) % 5 AS INT) AS fold"
PANEL = f"{UNITS}, p AS (SELECT *, log10(mean_price) AS y, CASE WHEN n < 8 THEN 'few' WHEN n < 12 THEN 'some' ELSE 'many' END AS tier, {FOLD.format('k')} FROM u)"


def panel(t):
    u = units(t).withColumns({"n": F.col("n").cast("double"), "y": F.log10("mean_price"), "fold": (R.hash_number("k", 42) % 5).cast("int")})
    return u.withColumn("tier", S.fixed_bin("n", [0, 8, 12, float("inf")], TIERS))


def r2_sql(y: str, predicted: str) -> str:
    return f"1 - sum(pow({y} - {predicted}, 2)) / (sum({y} * {y}) - sum({y}) * sum({y}) / count(*))"


def residual_sql(z: str, alpha: float, keys: str = "") -> str:
    """CTEs c (controls by fold), r (residuals of the training rows), d (the block's model, by keys too), o (predictions)."""
    k = f", {keys}" if keys else ""
    on = f"d.f = p.fold{f' AND d.{keys} = p.{keys}' if keys else ''}"
    return f"""c AS (SELECT f, regr_intercept(y, size) AS a, regr_slope(y, size) AS b FROM p, (SELECT DISTINCT fold AS f FROM p) WHERE fold <> f GROUP BY f),
r AS (SELECT f, p.*, y - a - b * size AS e FROM p, c WHERE fold <> f),
d AS (SELECT f{k}, count(*) AS cnt, avg(e) AS me, avg({z}) AS mz, covar_pop(e, {z}) / (var_pop({z}) * (1 + {alpha} / count(*))) AS s, avg(y) AS my, covar_pop(y, {z}) / (var_pop({z}) * (1 + {alpha} / count(*))) AS t FROM r GROUP BY f{k}),
o AS (SELECT p.*, a + b * size AS base, a + b * size + CASE WHEN cnt >= 60 THEN me + s * ({z} - mz) ELSE 0 END AS full_, my + t * ({z} - mz) AS alone FROM p JOIN c ON c.f = p.fold LEFT JOIN d ON {on})"""


def arm_sql(name: str, z: str) -> str:
    return f"SELECT * FROM (WITH {residual_sql(z, 1.0)} SELECT '{name}' AS arm, count(*) AS n, round({r2_sql('y', 'base')}, 6) AS r2_baseline, round({r2_sql('y', 'alone')}, 6) AS r2_alone, round({r2_sql('y', 'full_')} - ({r2_sql('y', 'base')}), 6) AS lift FROM o)"


@query(f"WITH {PANEL} {arm_sql('count', 'n')} UNION ALL {arm_sql('balance', 'bal')}")
def q106_residual_arms(t):
    """What two blocks add to a size control, on its residuals, and what they tell alone."""
    out = C.arms(panel(t), ["size"], {"count": ["n"], "balance": ["bal"]}, "y", "fold", (1.0,))
    return out.withColumns({c: r6(c) for c in ("r2_baseline", "r2_alone", "lift")})


@query(f"WITH {PANEL}, {residual_sql('n', 1.0, 'tier')} SELECT count(*) AS n, round({r2_sql('y', 'base')}, 6) AS r2_baseline, round({r2_sql('y', 'full_')}, 6) AS r2_by_tier FROM o")
def q107_tier_fits(t):
    cells_ = C.cross_products(panel(t), ["size", "n", "y"], ["fold", "tier"])
    n, base = C.r2_of(cells_, "y", C.linear(cells_, ["size"], "y"))
    full = C.r2_of(cells_, "y", C.residual_by_tier(cells_, ["size"], ["n"], "y", (1.0,)))[1]
    return t.spark.createDataFrame([(n, base, full)], "n long, r2_baseline double, r2_by_tier double").withColumns({c: r6(c) for c in ("r2_baseline", "r2_by_tier")})


def two_sql(name: str, y: str, a: str, b: str) -> str:
    """CTEs: sums of the training rows of each fold, and predictions by one and by two columns."""
    return f"""{name}_s AS (SELECT f, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS by_, var_pop({a}) AS aa, var_pop({b}) AS bb FROM p, (SELECT DISTINCT fold AS f FROM p) WHERE fold <> f GROUP BY f),
{name} AS (SELECT p.*, my + ay / aa * ({a} - ma) AS one, my + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * ({a} - ma) + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * ({b} - mb) AS two FROM p JOIN {name}_s ON f = fold)"""


@query(f"WITH {PANEL}, {two_sql('o', 'y', 'size', 'n')} SELECT count(*) AS n, CAST(1 AS BIGINT) AS n_added, round({r2_sql('y', 'one')}, 6) AS r2_reduced, round({r2_sql('y', 'two')}, 6) AS r2_full, round({r2_sql('y', 'two')} - ({r2_sql('y', 'one')}), 6) AS lift FROM o")
def q108_block_lift(t):
    out = C.marginal(panel(t), "k", ["size"], ["n"], "y", "fold", turns=0)
    return out.select("n", "n_added", r6("r2_reduced").alias("r2_reduced"), r6("r2_full").alias("r2_full"), r6("lift").alias("lift"))


@query()
def q109_block_nulls(t):
    """The lift of two blocks over size, with and without one column, against shuffles of their rows; q over both."""
    p = panel(t)
    parts = [C.marginal(p, "k", ["size"], block, "y", "fold", (0.1, 10.0), turns=19, ablate=("n",)).withColumn("block", F.lit(name)) for name, block in (("activity", ["n", "bal"]), ("balance", ["bal"]))]
    both = R.bh(parts[0].unionByName(parts[1]), "p")
    return both.withColumns({c: r6(c) for c in ("r2_reduced", "r2_full", "lift", "lift_ablated", "null_lift_mean", "null_lift_p95")})


MOVES = f"p AS (SELECT c_custkey AS k, c_acctbal AS bal, {FOLD.format('c_nationkey')}, " + ", ".join(f"avg(CASE WHEN year(o_orderdate) IN ({y}) THEN o_totalprice END) / 1000 AS {n}, stddev_samp(CASE WHEN year(o_orderdate) IN ({y}) THEN o_totalprice END) / 1000 / sqrt(count(CASE WHEN year(o_orderdate) IN ({y}) THEN 1 END)) AS {n}_se" for n, y in (("early", "1995, 1996"), ("late", "1998, 1999"))) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 HAVING early IS NOT NULL AND late IS NOT NULL), p2 AS (SELECT *, late - early AS y FROM p)"


@query(f"WITH {MOVES}, {two_sql('o', 'y', 'early', 'bal').replace('FROM p,', 'FROM p2,').replace('FROM p)', 'FROM p2)').replace('FROM p JOIN', 'FROM p2 JOIN').replace('SELECT p.*', 'SELECT p2.*')}, s AS (SELECT count(*) AS n, {r2_sql('y', 'one')} AS r1, {r2_sql('y', 'two')} AS r2, avg(pow(early_se, 2) + pow(late_se, 2)) / var_samp(y) AS noise, stddev_samp(y) AS sd FROM o) SELECT 'lagged' AS model, n, CAST(1 AS BIGINT) AS n_predictors, round(r1, 6) AS r2_change, round(r2 - r1, 6) AS contribution, round(noise, 5) AS noise_share, round(sd, 5) AS change_sd FROM s UNION ALL SELECT 'lagged_balance', n, CAST(2 AS BIGINT), round(r2, 6), NULL, round(noise, 5), round(sd, 5) FROM s")
def q110_temporal_transfer(t):
    """The change of customers' mean order value between two spans of years, from its earlier level and from it and the balance; whole nations a fold."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    at = lambda *years: F.when(F.year("o_orderdate").isin(*years), F.col("o_totalprice"))
    made = []
    for name, years in (("early", (1995, 1996)), ("late", (1998, 1999))):
        made += [(F.avg(at(*years)) / 1000).alias(name), (F.stddev_samp(at(*years)) / 1000 / F.sqrt(F.nullif(F.count(at(*years)), F.lit(0)))).alias(f"{name}_se")]
    p = o.groupBy(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), "c_nationkey").agg(*made).withColumn("fold", (R.hash_number("c_nationkey", 42) % 5).cast("int"))
    out = C.transfer(p, "early", "late", ("early_se", "late_se"), {"lagged": (["early"], "lagged_balance"), "lagged_balance": (["early", "bal"], None)}, "fold")
    return out.withColumns({c: r6(c) for c in ("r2_change", "contribution")}).withColumns({c: r6(c, 5) for c in ("noise_share", "change_sd")})


def effect_sql(x: str) -> str:
    within = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY g) AS {c}" for c in ("y", "size", x))
    return f"SELECT * FROM (WITH w AS (SELECT {within} FROM p), s AS (SELECT sum(y * y) AS yy, sum(size * size) AS cc, sum({x} * {x}) AS xx, sum(y * size) AS yc, sum({x} * size) AS xc, sum({x} * y) AS xy FROM w) SELECT '{x}' AS \"column\", round((xy - xc * yc / cc) / sqrt((xx - xc * xc / cc) * (yy - yc * yc / cc)), 6) AS partial_r, round((xy - xc * yc / cc) / (xx - xc * xc / cc) * (SELECT stddev_samp({x}) FROM p), 6) AS effect_per_sd FROM s)"


@query(f"WITH {PANEL} {effect_sql('n')} UNION ALL {effect_sql('bal')}")
def q111_partial_effects(t):
    """Freed of size and of nations' means."""
    return C.partial_effects(panel(t), ["n", "bal"], "y", ["size"], "g").select("column", r6("partial_r").alias("partial_r"), r6("effect_per_sd").alias("effect_per_sd"))


GAPS = "SELECT *, coalesce(CASE WHEN k % 4 > 0 THEN bal END, (SELECT median(bal) FROM p WHERE k % 4 > 0)) AS gap, CAST(n % 2 AS DOUBLE) AS odd FROM p"


@query(f"WITH {PANEL}, f AS ({GAPS}), d AS (SELECT count(CASE WHEN odd = 1 THEN 1 END) AS n_true, avg(CASE WHEN odd = 1 THEN y END) - avg(CASE WHEN odd = 0 THEN y END) AS diff FROM f) " + " UNION ALL ".join(f"SELECT e.\"column\", {more} AS n_true, {diff} AS raw_difference, partial_r, effect_per_sd FROM ({effect_sql(x).replace('FROM p)', 'FROM f)')}) e, d" for x, more, diff in (("bal", "NULL::BIGINT", "NULL::DOUBLE"), ("gap", "NULL::BIGINT", "NULL::DOUBLE"), ("odd", "d.n_true", "round(d.diff, 6)"))))
def q140_partial_effects_with_gaps(t):
    """A column with nulls changes no other column's result: its nulls are its median, so all columns are measured on the same rows."""
    p = panel(t).withColumns({"gap": F.when(F.col("k") % 4 > 0, F.col("bal")), "odd": (F.col("n") % 2).cast("double")})
    found = C.partial_effects(p, ["bal", "gap", "odd"], "y", ["size"], "g")
    return found.select("column", "n_true", r6("raw_difference").alias("raw_difference"), r6("partial_r").alias("partial_r"), r6("effect_per_sd").alias("effect_per_sd"))


@query(f"WITH {PANEL}, m AS (SELECT tier, avg(y) AS y, avg(size) AS x FROM p GROUP BY 1), b AS (SELECT sum((p.y - m.y) * (p.size - m.x)) / sum(pow(p.size - m.x, 2)) AS b FROM p JOIN m USING (tier)) SELECT m.tier, round(m.y - f.y, 6) AS raw, round(m.y - f.y - b * (m.x - f.x), 6) AS controlled, round((m.y - f.y - b * (m.x - f.x)) / (m.y - f.y), 5) AS share_left FROM m, b, (SELECT * FROM m WHERE tier = 'few') f WHERE m.tier <> 'few'")
def q112_tier_gradient(t):
    out = C.tier_gradient(panel(t), "y", "tier", TIERS, "size")
    return out.select("tier", r6("raw").alias("raw"), r6("controlled").alias("controlled"), r6("share_left", 5).alias("share_left"))


@query()
def q113_row_bootstrap(t):
    """The interval of what orders add to size in two in-sample predictions."""
    p = panel(t)
    fits = p.agg(*[f(F.col("y"), F.col(x)).alias(f"{n}_{x}") for x in ("size", "n") for n, f in (("a", F.regr_intercept), ("b", F.regr_slope))])
    scored = p.crossJoin(F.broadcast(fits)).withColumns({f"p_{x}": F.col(f"a_{x}") + F.col(f"b_{x}") * F.col(x) for x in ("size", "n")})
    return C.row_bootstrap(scored, "k", "y", "p_n", "p_size", rounds=200).withColumns({c: r6(c) for c in ("point", "low", "high")})


SCORES = "scores AS (SELECT c_nationkey AS target, c_mktsegment AS arm, n_regionkey AS owner, avg(c_acctbal) / 1000 AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'size' END AS reference FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"


def scores(t):
    """A score table: a row for each target (nation) and arm (segment), with the owner of the target and the arm's reference."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("arm"), F.col("n_regionkey").alias("owner"))
    s = c.agg((F.avg("c_acctbal") / 1000).alias("v"))
    return s.withColumn("reference", F.when(F.col("arm") == "BUILDING", "").when(F.col("arm") != "MACHINERY", "size"))


@query(f"WITH {SCORES}, w AS (SELECT target FROM scores GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT arm) FROM scores)), m AS (SELECT arm, avg(v) AS point FROM scores WHERE target IN (SELECT target FROM w) GROUP BY 1) SELECT arm, NULL AS against, round(point, 6) AS point FROM m UNION ALL SELECT a.arm, b.arm, round(a.point - b.point, 6) FROM m a JOIN m b ON a.arm < b.arm")
def q114_score_points(t):
    """Each arm's mean and its lead over each other arm, over the targets that all arms have scored; q115 has the intervals."""
    return intervals(t).select("arm", "against", r6("point").alias("point"))


def intervals(t):
    s = scores(t)
    whole = s.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(s.agg(F.count_distinct("arm").alias("_m")))).where("_n = _m").select("target")
    return C.score_intervals(s.join(whole, "target"), "target", "arm", "v", "owner", rounds=200)


@query()
def q115_score_intervals(t):
    return intervals(t).withColumns({c: r6(c) for c in ("point", "low", "high")})


@query(f"WITH {SCORES} SELECT arm AS model, count(*) AS n_targets, round(avg(v), 6) AS mean, count(*) FILTER (v > 4.5) AS n_positive FROM scores WHERE coalesce(reference, '') <> '' GROUP BY 1")
def q116_summary_by_model(t):
    s = scores(t).withColumn("v", F.col("v") - 4.5)
    return C.summary_by_model(s, "arm", "reference", "v").withColumn("mean", r6(F.col("mean") + 4.5))


@query(f"WITH {SCORES} SELECT owner, count(target) AS n_targets, round(avg(v), 6) AS v, round(avg(v * v), 6) AS w FROM scores GROUP BY 1")
def q117_means_by_owner(t):
    out = C.means_by(scores(t).withColumn("w", F.col("v") * F.col("v")), "owner", "target", ["v", "w"])
    return out.withColumns({"v": r6("v"), "w": r6("w")})


@query()
def q118_size_explained(t):
    return C.size_explained(panel(t), ["size"], ["n", "bal"], "fold").withColumns({c: r6(c) for c in ("linear_r2", "curve_r2", "gain")})


def vectors(t):
    """Vectors with a target that their first components tell in part, and a fold."""
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"d{i}" for i in range(width)]
    e = t.embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return e.withColumns({"y": F.col("label") + F.pmod("vec_id", F.lit(7)) / 7.0, "size": F.log10(F.col("vec_id") + 1), "fold": (R.hash_number("vec_id", 42) % 5).cast("int")}), names


@query()
def q119_reduced_in_folds(t):
    """Vectors reduced inside each fold, beside a size control."""
    e, names = vectors(t)
    found = C.cross_products(e, ["size", *names, "y"], ["fold"])
    rows = [(k, *C.r2_of(found, "y", C.reduced(found, ["size"], names, "y", k, (1.0, 100.0)))) for k in (2, 8)]
    return t.spark.createDataFrame(rows, "width int, n long, r2 double").withColumn("r2", r6("r2"))


@query(f"WITH {PANEL} SELECT k, " + ", ".join(f"CAST(tier = '{x}' AS INT)::DOUBLE AS tier_{i}, CASE WHEN tier = '{x}' THEN round(ln(1 + n), 6) ELSE 0 END AS tier_{i}_n" for i, x in enumerate(TIERS)) + " FROM p")
def q120_tier_interactions(t):
    typed = C.typed_block(panel(t), {"n": "count", "size": "flag"})
    out, names = C.tier_interactions(typed, ["n"], "tier", TIERS)
    return out.select("k", *[(r6(c) if c.endswith("_n") else F.col(c)).alias(c) for c in names])


@query("SELECT vec_id, round(CASE WHEN label IN (1, 2) AND vec_id % 3 <> 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings")
def q121_spliced_vectors(t):
    """Rows of two labels take their vectors from another set, which lacks a third of them."""
    other = t.embeddings.where("vec_id % 3 <> 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    out = C.spliced(t.embeddings, other, "vec_id", "label", [1, 2], "embedding")
    return out.select("vec_id", r6(F.col("embedding")[0].cast("double")).alias("first"))


GRID = "grid AS (SELECT n_nationkey AS unit, p_brand AS brand FROM nation, (SELECT DISTINCT p_brand FROM part)), held AS (SELECT c_nationkey AS unit, p_brand AS brand, count(*) AS n FROM facts GROUP BY 1, 2)"


@query(f"WITH {{FACTS}}, {GRID} SELECT unit, count(*) FILTER (n >= 10) AS disclosed, count(*) FILTER (n < 10) AS suppressed, count(*) FILTER (n IS NULL) AS absent FROM grid LEFT JOIN held USING (unit, brand) GROUP BY 1")
def q122_three_states(t):
    """Cells that are shown, hidden for being small, or not there at all, over the whole grid of units and brands."""
    held = t.facts.groupBy(F.col("c_nationkey").alias("unit"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    brands = t.part.select(F.col("p_brand").alias("brand")).distinct()
    grid = t.nation.select(F.col("n_nationkey").alias("unit")).crossJoin(brands)  # units by column names, as many as the result pivots to
    state = S.three_state(F.col("n") < 10, F.when(F.col("n") >= 10, F.col("n")))
    counted = R.complete(grid, held.withColumn("state", state).select("unit", "brand", "state"), ["unit", "brand"], {"state": "absent"})
    return counted.groupBy("unit").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("disclosed", "suppressed", "absent")])


@query("SELECT name AS \"column\", count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS sd, min(v) AS low, max(v) AS high FROM (SELECT 'p_size' AS name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'p_partkey', p_partkey::DOUBLE FROM part) GROUP BY 1")
def q123_column_summary(t):
    return ST.summary(t.part, ["p_size", "p_retailprice", "p_partkey"]).withColumns({"mean": r6("mean", 4), "sd": r6("sd", 4)})


@query(f"WITH {{FACTS}}, {CELLS}, {LQ}, pub AS (SELECT unit, sector, (n / sum(n) OVER (PARTITION BY unit)) / (sum(n) OVER (PARTITION BY sector) / sum(n) OVER ()) AS lqn FROM cells) SELECT sector, count(*) AS units, round(corr(lq, lqn), 5) AS r FROM lqs JOIN pub USING (unit, sector) GROUP BY 1")
def q124_index_check(t):
    """Quotients of quantities against those of line counts, which stand for published ones, by sector."""
    published = R.location_quotient(cells(t).select("unit", "sector", "n"), "unit", "sector", "n", "lqn").select("unit", "sector", "lqn")
    both = lq(t).join(published, ["unit", "sector"])
    return both.groupBy("sector").agg(F.count(F.lit(1)).alias("units"), r6(ST.corr("lq", "lqn"), 5).alias("r"))


@query(f"WITH {{FACTS}}, {CELLS}, {LQ}, z AS (SELECT c.n_regionkey AS zone, p_type AS sector, sum(l_quantity) AS v FROM facts c GROUP BY 1, 2), zq AS (SELECT zone, sector, (v / sum(v) OVER (PARTITION BY zone)) / (sum(v) OVER (PARTITION BY sector) / sum(v) OVER ()) AS fallback FROM z), h AS (SELECT lqs.*, n_regionkey AS zone FROM lqs JOIN nation ON n_nationkey = unit WHERE (unit + length(sector)) % 3 = 0) SELECT round(avg(abs(lq - fallback)), 6) AS mae, round(corr(lq, fallback), 5) AS r, count(*) AS n FROM h JOIN zq USING (zone, sector)")
def q125_imputation_trial(t):
    """A third of the cells is held out and filled by their region's quotient; never a default."""
    zones = t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("zone"))
    by_zone = cells(t).join(zones, "unit").groupBy("zone", "sector").agg(F.sum("v").alias("v"))
    fallback = R.location_quotient(by_zone, "zone", "sector", "v", "fallback").select("zone", "sector", "fallback")
    held = lq(t).where((F.col("unit") + F.length("sector")) % 3 == 0).join(zones, "unit").join(fallback, ["zone", "sector"])
    return held.agg(r6(F.avg(F.abs(F.col("lq") - F.col("fallback")))).alias("mae"), r6(ST.corr("lq", "fallback"), 5).alias("r"), F.count(F.lit(1)).alias("n"))


#: Normal equations of three centred predictors, solved by determinants.
ELASTICITIES = """WITH x AS (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS a, ln(1 - l_discount) AS b, ln(1 + l_tax) AS c FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 1 AND l_tax > -1),
s AS (SELECT count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, var_pop(y) AS yy FROM x),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
w AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS quantity, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS discount, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS tax FROM d)
SELECT n, round(quantity, 6) AS quantity, round(discount, 6) AS discount, round(tax, 6) AS tax, round((quantity * ay + discount * by_ + tax * cy) / yy, 6) AS r2 FROM w"""


@query(ELASTICITIES)
def q126_elasticities(t):
    """The elasticity of an order line's value with respect to its quantity, net of its discount and tax; the unit price is the residual."""
    known = t.lineitem.where("l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 1 AND l_tax > -1")
    x = known.select(F.ln("l_extendedprice").alias("v"), F.ln("l_quantity").alias("quantity"), F.ln(1 - F.col("l_discount")).alias("discount"), F.ln(1 + F.col("l_tax")).alias("tax")).withColumn("all", F.lit(0))
    names = ["quantity", "discount", "tax"]
    found = C.cross_products(x, [*names, "v"], ["all"])
    m, target = found.total(lambda k: True), found.unit("v")
    w = C.ridge(m, C.designs(found, names), target, 0.0)
    rows = [(int(m[0, 0]), *[float(w[found.at[c]]) for c in names], float(C.r2_of(found, "v", {(0,): w})[1]))]
    out = t.spark.createDataFrame(rows, "n long, quantity double, discount double, tax double, r2 double")
    return out.select("n", *[r6(c).alias(c) for c in (*names, "r2")])


@query("WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM c), m AS (SELECT label, d, avg(x) AS m FROM x GROUP BY 1, 2), s AS (SELECT label, vec_id, sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)) AS near FROM x JOIN m USING (label, d) GROUP BY 1, 2) SELECT label, vec_id, n, round(near, 6) AS near, round(mean_near, 6) AS mean_near FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, avg(near) OVER (PARTITION BY label) AS mean_near, row_number() OVER (PARTITION BY label ORDER BY round(near, 9) DESC, vec_id) AS r FROM s) WHERE r <= 5")
def q127_cluster_summary(t):
    """The size and closeness of each label's vectors, and its five members nearest to the mean."""
    e = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    mean = ST.mean_vectors(e, "v", ST.width_of(e, "v"), ["label"], "c").select("label", "c")
    near = e.join(mean, "label").select("label", "vec_id", (S.dot("v", "c") / F.sqrt(S.dot("v", "v")) / F.sqrt(S.dot("c", "c"))).alias("near"))
    about = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("near")).alias("mean_near"))
    best = R.best_per_group(near.withColumn("_s", F.round("near", 9)), ["label"], F.desc("_s"), F.asc("vec_id"), most=5)
    return best.join(about, "label").select("label", "vec_id", "n", r6("near").alias("near"), "mean_near")
