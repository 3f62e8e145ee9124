"""Queries on statistics and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import semantics as S
from tessera.operators import models as M
from tessera.operators import ordered as O
from tessera.operators import regional as R
from tessera.operators import scoring as C
from tessera.operators import statistics as ST
from tessera.plans.registry import query, r6

UNITS = "u AS (SELECT c_custkey AS k, c_nationkey AS g, n_regionkey AS m, c_acctbal AS bal, count(o_orderkey) AS n, sum(o_totalprice) AS spend, avg(o_totalprice) AS mean_price, log10(greatest(sum(o_totalprice), 1)) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"


def units(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spend"), F.avg("o_totalprice").alias("mean_price"))
    c = t.customer.join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("n_regionkey").alias("m"), F.col("c_acctbal").alias("bal"))
    return c.join(o, "k").withColumn("size", S.floored_log10("spend"))


@query(f"WITH {UNITS} SELECT x, round(r, 6) AS r, n FROM (SELECT 'bal' AS x, corr(bal, size) AS r, count(*) AS n FROM u UNION ALL SELECT 'n', corr(n, size), count(*) FROM u UNION ALL SELECT 'mean_price', corr(mean_price, size), count(*) FROM u)")
def q58_size_dependence(t):
    return ST.correlations(units(t), [(c, "size") for c in ("bal", "n", "mean_price")]).select("x", r6("r").alias("r"), "n")


@query(f"WITH {UNITS}, c AS (SELECT corr(n, mean_price) AS xy, corr(n, size) AS xz, corr(mean_price, size) AS yz FROM u) SELECT round(xy, 6) AS r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r_size_controlled, abs((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))) < 0.5 * abs(xy) AS size_confounded FROM c")
def q59_partial_corr(t):
    c = units(t).agg(ST.corr("n", "mean_price").alias("xy"), ST.corr("n", "size").alias("xz"), ST.corr("mean_price", "size").alias("yz"))
    c = c.withColumn("p", ST.partial("xy", "xz", "yz"))
    return c.select(r6("xy").alias("r"), r6("p").alias("r_size_controlled"), (F.abs("p") < 0.5 * F.abs("xy")).alias("size_confounded"))


PS = "p AS (SELECT c_nationkey AS test, (avg(c_acctbal) - 4500) * (avg(c_acctbal) - 4500) / 1000000 AS p FROM customer GROUP BY 1)"


@query(f"WITH {PS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT test, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r")
def q60_bh_fdr(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("test")).agg((F.pow(F.avg("c_acctbal") - 4500, 2) / 1e6).alias("p"))
    return R.bh(p, "p").select("test", r6("p").alias("p"), r6("q").alias("q"))


@query(f"WITH {UNITS}, l AS (SELECT g, n, spend, bal FROM u) SELECT g AS sector, count(*) AS n, round(corr(bal, spend), 6) AS r, round(pow(corr(bal, spend), 2), 6) AS r2 FROM l GROUP BY 1 HAVING count(*) >= 30")
def q65_sector_corr_scan(t):
    return units(t).groupBy(F.col("g").alias("sector")).agg(F.count(F.lit(1)).alias("n"), r6(ST.corr("bal", "spend")).alias("r"), r6(F.pow(ST.corr("bal", "spend"), 2)).alias("r2")).where("n >= 30")


@query(f"WITH {UNITS}, r AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY n) + (count(*) OVER (PARTITION BY m, n) - 1) / 2.0 AS a, rank() OVER (PARTITION BY m ORDER BY bal) + (count(*) OVER (PARTITION BY m, bal) - 1) / 2.0 AS b FROM u) SELECT m, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1")
def q66_spearman(t):
    return ST.spearman(units(t), "n", "bal", ["m"]).withColumn("rho", r6("rho"))


@query("WITH x AS (SELECT o_custkey AS k, sum(o_totalprice) / 1000 AS d, stddev_samp(o_totalprice) / 1000 AS ds, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / 1000 AS a, stddev_samp(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / 1000 AS s FROM orders GROUP BY 1) SELECT k, round(a / nullif(d, 0), 6) AS share, round(sqrt(CASE WHEN s * s - pow(a / nullif(d, 0), 2) * ds * ds >= 0 THEN s * s - pow(a / nullif(d, 0), 2) * ds * ds ELSE s * s + pow(a / nullif(d, 0), 2) * ds * ds END) / nullif(d, 0), 5) AS se FROM x")
def q67_se_propagation(t):
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)
    x = t.orders.groupBy(F.col("o_custkey").alias("k")).agg((F.sum("o_totalprice") / 1000).alias("d"), (F.stddev_samp("o_totalprice") / 1000).alias("ds"), (F.sum(closed) / 1000).alias("a"), (F.stddev_samp(closed) / 1000).alias("s"))
    return x.select("k", r6(S.ratio("a", "d")).alias("share"), r6(S.ratio_error("a", "s", "d", "ds"), 5).alias("se"))


DEC = "e AS (SELECT quantile_cont(spend, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM u), d AS (SELECT u.*, CAST(1 + len(list_filter(q, lambda x: x < spend)) AS BIGINT) AS decile FROM u, e)"


@query(f"WITH {UNITS}, {DEC} SELECT decile, count(*) AS n, round(var_samp(mean_price), 2) AS variance, round(avg(pow(mean_price, 2) / n / 4), 2) AS noise, round(avg(pow(mean_price, 2) / n / 4) / var_samp(mean_price), 6) AS noise_share FROM d GROUP BY 1")
def q68_decile_noise(t):
    u = units(t).withColumn("spend", F.round("spend", 6))  # sums that differ by the order of their addition alone are ties
    d = O.quantile_bin(u, "spend", 10, "decile").withColumn("se2", F.pow("mean_price", F.lit(2.0)) / F.col("n") / 4)
    g = d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.var_samp("mean_price").alias("v"), F.avg("se2").alias("e"))
    return g.select("decile", "n", r6("v", 2).alias("variance"), r6("e", 2).alias("noise"), r6(S.ratio("e", "v")).alias("noise_share"))


@query("WITH g AS (SELECT c_nationkey, count(*) AS m, avg(c_acctbal) AS a, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY 1), t AS (SELECT sum(m) AS n, count(*) AS k, sum(m * m) AS mm, sum(w) AS w, sum(m * pow(a - (SELECT avg(c_acctbal) FROM customer), 2)) AS b FROM g), i AS (SELECT n, k, (n - mm / n) / (k - 1) AS m0, b / (k - 1) AS b, w / (n - k) AS w FROM t), c AS (SELECT *, greatest(0, (b - w) / (b + (m0 - 1) * w)) AS icc FROM i) SELECT round(m0, 6) AS m0, round(icc, 6) AS icc, round(1 + (m0 - 1) * icc, 5) AS design_effect, round(n / (1 + (m0 - 1) * icc), 3) AS n_effective FROM c")
def q69_icc_design_effect(t):
    return ST.cluster_dependence(t.customer, "c_acctbal", "c_nationkey").select(r6("m0").alias("m0"), r6("icc").alias("icc"), r6("design_effect", 5).alias("design_effect"), r6("n_effective", 3).alias("n_effective"))


@query(f"WITH {UNITS} SELECT round(regr_r2(spend, size), 6) AS r2_size, round(regr_r2(spend, n), 6) AS r2_n, round(regr_r2(spend, n) - regr_r2(spend, size), 6) AS lift FROM u")
def q70_r2_lift(t):
    u = units(t)
    fits = u.agg(*[f(F.col("spend"), F.col(x).cast("double")).alias(f"{n}_{x}") for x in ("size", "n") for n, f in (("a", F.regr_intercept), ("b", F.regr_slope))])
    scored = u.crossJoin(F.broadcast(fits)).withColumns({f"p_{x}": F.col(f"a_{x}") + F.col(f"b_{x}") * F.col(x) for x in ("size", "n")})
    return scored.agg(ST.r2("spend", "p_size").alias("s"), ST.r2("spend", "p_n").alias("c")).select(r6("s").alias("r2_size"), r6("c").alias("r2_n"), r6(F.col("c") - F.col("s")).alias("lift"))


@query("WITH d AS (SELECT c_custkey, c_acctbal - 4500 AS d FROM customer WHERE c_acctbal <> 4500), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d) SELECT CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, count(*) AS n FROM r")
def q71_signed_rank(t):
    return ST.signed_ranks(t.customer.withColumn("d", F.col("c_acctbal") - 4500), "d")


#: The normal distribution's tails by a rational approximation, to 1.5e-7.
TAILS = "(0.254829592 * t - 0.284496736 * t * t + 1.421413741 * pow(t, 3) - 1.453152027 * pow(t, 4) + 1.061405429 * pow(t, 5)) * exp(-z * z / 2)"


@query(
    f"WITH d AS (SELECT c_mktsegment AS s, round(c_acctbal / 100) - 45 AS d FROM customer WHERE round(c_acctbal / 100) <> 45), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d), n AS (SELECT count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w FROM r), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))), "
    f"z AS (SELECT n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM n, t), x AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z) SELECT n, w AS w_plus, round(z, 6) AS z, round({TAILS}, 5) AS p FROM x"
)
def q141_signed_rank_test(t):
    """Balances in hundreds against 45: many equal differences, so ties count."""
    d = t.customer.withColumn("d", F.round(F.col("c_acctbal") / 100) - 45)
    return ST.signed_rank_test(d, "d").select("n", "w_plus", r6("z").alias("z"), r6("p", 5).alias("p"))


@query("SELECT CAST(least(10, floor((o_totalprice - 0) / 50000) + 1) AS BIGINT) AS bx, CAST(least(10, floor((month(o_orderdate) - 1) / 1.1) + 1) AS BIGINT) AS by, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1, 2")
def q72_trend_hist2d(t):
    return ST.histogram2d(t.orders.withColumn("month", F.month("o_orderdate").cast("double")), "o_totalprice", "month", 10, (0.0, 500000.0), (1.0, 12.0))


@query(f"WITH {UNITS} SELECT m, round(regr_slope(spend, n), 4) AS slope, round(regr_intercept(spend, n), 4) AS intercept FROM u GROUP BY 1")
def q73_trend_line(t):
    return units(t).groupBy("m").agg(r6(F.regr_slope("spend", F.col("n").cast("double")), 4).alias("slope"), r6(F.regr_intercept("spend", F.col("n").cast("double")), 4).alias("intercept"))


@query("WITH c AS (SELECT label, vec_id % 4 AS l2, count(*) AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY label)), b AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY l2)), i AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM c) SELECT round((i.v - a.v * b.v / (t * (t - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (t * (t - 1) / 2)), 6) AS ari FROM a, b, i")
def q80_ari_contingency(t):
    return ST.adjusted_rand(t.embeddings.select("label", (F.col("vec_id") % 4).alias("l2")), "label", "l2").select(r6("ari").alias("ari"))


@query("WITH y AS (SELECT c_nationkey AS g, avg(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END) AS a, var_samp(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END) / count(CASE WHEN year(o_orderdate) = 1996 THEN 1 END) AS ea, avg(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END) AS b, var_samp(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END) / count(CASE WHEN year(o_orderdate) = 2000 THEN 1 END) AS eb FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT round(avg(ea + eb) / var_samp(b - a), 5) AS noise_share FROM y")
def q82_differenced_noise(t):
    o = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("g")), F.col("o_custkey") == F.col("c_custkey"))
    at = lambda y: F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))
    y = o.groupBy("g").agg(F.avg(at(1996)).alias("a"), (F.var_samp(at(1996)) / F.count(at(1996))).alias("ea"), F.avg(at(2000)).alias("b"), (F.var_samp(at(2000)) / F.count(at(2000))).alias("eb"))
    return y.agg(r6(S.ratio(F.avg(F.col("ea") + F.col("eb")), F.var_samp(F.col("b") - F.col("a"))), 5).alias("noise_share"))


@query("WITH x AS (SELECT l_shipdate, l_quantity AS q, l_extendedprice / l_quantity AS p, l_extendedprice AS v FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) SELECT round(regr_slope(ln(v), ln(q)), 6) AS elasticity, round(regr_r2(ln(v), ln(q)), 6) AS r2 FROM x")
def q83_log_elasticity(t):
    x = t.lineitem.where("l_quantity > 0 AND l_extendedprice > 0").select(F.ln("l_extendedprice").alias("v"), F.ln("l_quantity").alias("q"))
    return x.agg(r6(F.regr_slope("v", "q")).alias("elasticity"), r6(F.regr_r2("v", "q")).alias("r2"))


@query("SELECT flag, n, round(mean, 6) AS mean, round(r, 6) AS r FROM (SELECT o_orderstatus = 'F' AS flag, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1), (SELECT corr(CAST(o_orderstatus = 'F' AS INT), o_totalprice) AS r FROM orders)")
def q84_flag_check(t):
    o = t.orders.withColumn("flag", F.col("o_orderstatus") == "F")
    r = o.agg(r6(ST.corr(F.col("flag").cast("double"), "o_totalprice")).alias("r"))
    return o.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean")).crossJoin(F.broadcast(r))


@query("WITH RECURSIVE s AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM (SELECT c_nationkey AS g, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1)), a AS (SELECT 0 AS i, NULL::INT AS g, 0::BIGINT AS n, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS held UNION ALL SELECT i, g, n, fold, list_transform(held, lambda x, j: CASE WHEN j = fold + 1 THEN x + n ELSE x END) FROM (SELECT s.i, s.g, s.n, CAST(list_position(held, list_min(held)) - 1 AS INT) AS fold, held FROM a JOIN s ON s.i = a.i + 1)) SELECT g, n, fold FROM a WHERE i > 0")
def q85_group_kfold(t):
    return M.group_folds(units(t), "g", 5)


def panel(t):
    u = units(t).withColumns({"n": F.col("n").cast("double"), "fold": M.random_fold("k")})
    return u.withColumn("y", F.log10("mean_price")).withColumn("gap", F.when(F.col("k") % 11 != 0, F.col("bal")))


@query()
def q86_ridge_oof(t):
    """Penalties chosen inside each fold, nulls filled by its training median."""
    arms = {"size": ["size"], "size_bal": ["size", "gap"], "all": ["size", "n", "gap"]}
    return C.out_of_fold(panel(t), arms, "y", "fold", (0.1, 1.0, 10.0, 100.0)).withColumn("r2", r6("r2"))


@query()
def q87_drop_one(t):
    """Blocked folds: whole nations; the contribution of each block is the loss without it."""
    u = panel(t).drop("fold").join(M.group_folds(units(t), "g", 5).select("g", "fold"), "g")
    blocks = {"size": ["size"], "count": ["n"], "balance": ["bal"]}
    full = [c for b in blocks.values() for c in b]
    arms = {"full": full} | {f"without_{k}": [c for c in full if c not in b] for k, b in blocks.items()}
    s = C.out_of_fold(u, arms, "y", "fold")
    top = s.where("model = 'full'").select(F.col("r2").alias("top"))
    return s.crossJoin(F.broadcast(top)).select("model", "n", r6("r2").alias("r2"), r6(F.col("top") - F.col("r2")).alias("contribution"))


@query()
def q88_placebo(t):
    p = panel(t).select("k", "y", "size", "n", "fold")
    out = C.out_of_fold(p, {"real": ["size", "n"]}, "y", "fold")
    for turn in range(3):
        out = out.unionByName(C.out_of_fold(M.shuffled(p, "k", ["n"], turn), {f"placebo_{turn}": ["size", "n"]}, "y", "fold"))
    return out.withColumn("r2", r6("r2"))


@query()
def q89_noise_floor(t):
    noise = M.gaussian(4, "k", 1)
    p = panel(t).withColumns(noise)
    return C.out_of_fold(p, {"size": ["size"], "noise": ["size", *noise]}, "y", "fold").withColumn("r2", r6("r2"))


@query()
def q90_pca_scores(t):
    """Scores of the whole vectors; the table's longest vector gives the number of dimensions."""
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = t.embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"d{i}") for i in range(width)])
    return M.with_components(e, [f"d{i}" for i in range(width)], 2).select("vec_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@query()
def q91_kmeans_markets(t):
    n = t.nation.select(F.col("n_nationkey").alias("unit"), (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.7 - 170).alias("lon"))
    x = n.select("unit", *[c.alias(a) for c, a in zip(S.on_sphere("lat", "lon"), "xyz")])
    return M.kmeans(x, list("xyz"), 5, seeds=3, out="market").select("unit", "market")


@query()
def q92_boosted_arm(t):
    return M.boosted(panel(t), ["size", "n", "gap"], "y", "fold", trees=8).agg(F.count(F.lit(1)).alias("n"), r6(ST.r2("y", "predicted")).alias("r2"))


@query()
def q142_boosted_block(t):
    """What blocks add to size in boosted trees."""
    found = M.boosted_lifts(panel(t), ["size"], {"gap": ["gap"], "activity": ["n"]}, "y", "fold", trees=2, depth=3)
    return found.select("block", "n", *[r6(c).alias(c) for c in ("r2_baseline", "r2_full", "lift_gbm")])


@query()
def q93_permutation_p(t):
    return ST.permutation_p(units(t), "k", "n", "bal", rounds=99).select(r6("r").alias("r"), r6("p").alias("p"))


@query()
def q94_bootstrap_ci(t):
    return ST.bootstrap(units(t), "k", "bal", rounds=200)


@query()
def q95_flexible_baseline(t):
    c = M.curvature(panel(t).select("k", "y", "fold", "size", "n", "bal"), ["size", "n", "bal"])
    curves = [x for x in c.columns if x.startswith("curve_")]
    return C.out_of_fold(c, {"linear": ["size", "n", "bal"], "flexible": ["size", "n", "bal", *curves]}, "y", "fold").withColumn("r2", r6("r2"))


@query()
def q96_training_size(t):
    p = panel(t)
    parts = [C.out_of_fold(R.keyed_sample(p, "k", n), {f"n{n}": ["size", "n"]}, "y", "fold") for n in (60, 200, 600)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("r2", r6("r2"))


@query()
def q97_grain(t):
    """The same model on units and on their nations, re-derived from sums."""
    u = panel(t)
    g = u.groupBy("g").agg(F.log10(S.ratio(F.sum("spend"), F.sum("n"))).alias("y"), R.sum_of_logs("size").alias("size"), F.sum("n").alias("n")).withColumn("fold", M.random_fold("g"))
    return C.out_of_fold(u, {"unit": ["size", "n"]}, "y", "fold").unionByName(C.out_of_fold(g, {"nation": ["size", "n"]}, "y", "fold")).withColumn("r2", r6("r2"))
