"""Queries that score many targets, blocks, samples or pairs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import pairs as P
from tessera.operators import sweeps as W
from tessera.plans.registry import query, r6

#: Customers with features, one of which has nulls, and targets that are null in different rows.
BUYERS = """buyers AS (SELECT c_custkey AS k, c_nationkey AS g, n_regionkey AS m, c_custkey % 5 AS fold, ln(1 + count(o_orderkey)) AS size, c_acctbal AS bal, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS gap, CAST(length(c_mktsegment) AS DOUBLE) AS seg, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS building,
CASE WHEN c_custkey % 3 <> 0 THEN ln(1 + coalesce(sum(o_totalprice), 0)) END AS spend, CASE WHEN c_custkey % 4 <> 1 THEN avg(o_totalprice) END AS price, CASE WHEN c_custkey % 7 > 1 THEN CAST(count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS DOUBLE) END AS urgent
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, n_regionkey, c_acctbal, c_mktsegment)"""
TARGETS = ["spend", "price", "urgent"]
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def buyers(t):
    c = t.customer.join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("first"))
    k = F.col("c_custkey")
    return c.join(o, k == F.col("o_custkey"), "left").select(
        k.alias("k"), F.col("c_nationkey").alias("g"), F.col("n_regionkey").alias("m"), (k % 5).alias("fold"), F.ln(1 + F.coalesce("n", F.lit(0))).alias("size"), F.col("c_acctbal").alias("bal"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("gap"),
        F.length("c_mktsegment").cast("double").alias("seg"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"),
        F.when(k % 3 != 0, F.ln(1 + F.coalesce("total", F.lit(0.0)))).alias("spend"), F.when(k % 4 != 1, F.col("mean")).alias("price"), F.when(k % 7 > 1, F.coalesce("first", F.lit(0)).cast("double")).alias("urgent"),
    )


LONG = "t AS (" + " UNION ALL ".join(f"SELECT k, g, fold, size, bal, gap, seg, building, '{y}' AS target, {y} AS y FROM buyers WHERE {y} IS NOT NULL" for y in TARGETS) + "), f AS (SELECT DISTINCT fold AS without FROM buyers)"
SCOPES = ["bal", "gap", "seg", "building"]


@query(
    f"""WITH {BUYERS}, {LONG}, b AS (SELECT target, without, regr_slope(y, size) AS s, regr_intercept(y, size) AS i, median(gap) AS med FROM t, f WHERE fold <> without GROUP BY 1, 2),
l AS ({" UNION ALL ".join(f"SELECT t.target, '{c}' AS scope, fold, without, y, y - i - s * size AS e, {'coalesce(gap, med)' if c == 'gap' else c} AS x FROM t, f JOIN b USING (without) WHERE t.target = b.target" for c in SCOPES)}),
w AS (SELECT target, scope, without, coalesce(regr_slope(e, x), 0) AS s, CASE WHEN regr_slope(e, x) IS NULL THEN avg(e) ELSE regr_intercept(e, x) END AS i FROM l WHERE fold <> without GROUP BY 1, 2, 3),
r AS (SELECT target, scope, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS low, 1 - sum((e - i - s * x) ** 2) / (var_pop(y) * count(*)) AS high FROM l JOIN w USING (target, scope, without) WHERE fold = without GROUP BY 1, 2)
SELECT target, scope, n, round(low, 6) AS r2_baseline, round(high, 6) AS r2_full, round(high - low, 6) AS lift FROM r"""
)
def q129_scope_sweep(t):
    """Four scopes by three targets with incomplete rows, from one scan; the column with nulls is filled by each fold's training median."""
    found = W.scope_sweep(buyers(t), ["size"], {c: [c] for c in SCOPES}, TARGETS, "fold", marked=False)
    return found.select("target", "scope", "n", *[r6(c).alias(c) for c in ("r2_baseline", "r2_full", "lift")])


@query(
    f"""WITH {BUYERS}, x AS (SELECT g, fold, size AS x, spend AS y FROM buyers WHERE spend IS NOT NULL AND g > 2 OR spend IS NOT NULL AND fold = 0), f AS (SELECT DISTINCT fold AS without FROM x),
d AS (SELECT without, g, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM x, f WHERE fold <> without GROUP BY 1, 2), w AS (SELECT without, sum(n * c) / sum(n * v) AS s FROM d GROUP BY 1),
a AS (SELECT without, g, my - s * mx AS a, n FROM d JOIN w USING (without)), z AS (SELECT without, sum(a * n) / sum(n) AS a0 FROM a GROUP BY 1)
SELECT 'size' AS model, count(*) AS n, count(DISTINCT x.g) AS n_groups, round(1 - sum((y - s * x - coalesce(a, a0)) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM x JOIN w ON fold = w.without JOIN z ON z.without = fold LEFT JOIN a ON a.without = fold AND a.g = x.g"""
)
def q130_group_effects(t):
    """Nations' own levels, absorbed in the sums of products; three nations lie in one fold alone, so it meets them untrained."""
    rows = buyers(t).where("spend IS NOT NULL AND (g > 2 OR fold = 0)")
    return W.group_effects(rows, {"size": ["size"]}, "spend", "fold", "g").withColumn("r2", r6("r2"))


@query()
def q131_drop_one_twins(t):
    """Every block withheld in turn, also where a row's place is known, by blocks of nations; a target's own restatement is left out of the ablated scores."""
    u = buyers(t).drop("fold").join(M.group_folds(t.customer.withColumnRenamed("c_nationkey", "g"), "g", 5).select("g", "fold"), "g")
    placed = u.withColumns({"lat": F.sin(F.col("g").cast("double")), "lon": F.cos(F.col("g").cast("double"))})
    models = W.drop_one_models(["size"], {"A": ["gap"], "B": ["seg", "building"], "C": ["bal"]}, ["lat", "lon"], [("B", "C")], {"proxy": ("C", ["gap"])})
    return W.drop_one(placed, models, TARGETS, "fold", ALPHAS, {"price": ["bal"]}).select("target", "model", "family", "withheld", "n", "n_predictors", *[r6(c).alias(c) for c in ("r2", "r2_ablated", "lift_over_size", "contribution", "contribution_ablated")])


@query()
def q132_size_rounds(t):
    """Lifts on nested samples of three sizes, drawn five times."""
    found = W.size_rounds(buyers(t), "k", ["size"], ["size", "gap", "bal", "seg"], TARGETS, "fold", [0.25, 0.5, 1.0], 5)
    return found.select("target", "share", "round", "n", *[r6(c).alias(c) for c in ("r2_baseline", "r2_full", "lift")])


@query()
def q133_grain_arms(t):
    """All customers, groups of customers, and samples of as many customers as there are groups."""
    fine = buyers(t)
    names = ["size", "gap", "bal", "seg", *TARGETS]
    coarse = fine.groupBy("g", (F.col("k") % 20).alias("part"), "fold").agg(*[F.avg(c).alias(c) for c in names])
    found = W.grain_arms(fine, coarse, "k", ["size"], ["size", "bal", "seg"], TARGETS, "fold", 5)
    return found.select("target", "arm", "n", r6("lift").alias("lift"), r6("sd").alias("sd"))


XS, YS = ["bal", "gap", "seg", "building"], TARGETS
PAIRS = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, regr_count({y}, {x}) AS n, corr({x}, {y}) AS r, CASE WHEN regr_count({x}, size) > 0 THEN corr({x}, size) END AS xz, corr({y}, size) AS yz FROM buyers" for x in XS for y in YS)


@query(f"WITH {BUYERS}, p AS ({PAIRS}) SELECT x, y, n, round(r, 6) AS r, round((r - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_r FROM p")
def q134_pair_sweep(t):
    """Every feature against every target, raw and given size, on each pair's complete rows."""
    return P.pair_sweep(buyers(t), "k", XS, YS, "size").select("x", "y", "n", r6("r").alias("r"), r6("partial_r").alias("partial_r"))


@query()
def q135_pair_tests(t):
    """p of every pair by 199 shuffles inside blocks, q over all pairs at once, and the three strongest features of each target."""
    return P.top_of_each(P.pair_tests(buyers(t), "k", XS, YS, 199)).select("x", "y", "n", r6("r").alias("r"), "p", r6("q").alias("q"), "place")


VENDORS = "v AS (SELECT s_suppkey AS k, [avg(l_quantity), 100 * avg(l_discount), 100 * avg(l_tax)] AS a, [ln(sum(l_extendedprice)), s_acctbal / 10000] AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal)"


def profiles(t):
    """Two vectors of each supplier."""
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.array(F.avg("l_quantity"), 100 * F.avg("l_discount"), 100 * F.avg("l_tax")).alias("a"), F.ln(F.sum("l_extendedprice")).alias("price"))
    return s.join(t.supplier.select(F.col("s_suppkey").alias("k"), "s_acctbal"), "k").select("k", "a", F.array("price", F.col("s_acctbal") / 10000).alias("b"))


@query(f"WITH {VENDORS} SELECT (SELECT count(*) FROM v) AS n_units, count(*) AS n_pairs, round(corr(list_cosine_distance(x.a, y.a), list_distance(x.b, y.b)), 6) AS r FROM v x JOIN v y ON x.k < y.k")
def q136_mantel(t):
    """Whether suppliers that sell alike are alike in size: two distances over all pairs."""
    return P.mantel(profiles(t), "k", "a", "b", rounds=0).select("n_units", "n_pairs", r6("r").alias("r"))


@query()
def q137_mantel_test(t):
    return P.mantel(profiles(t), "k", "a", "b", rounds=99).select("n_units", "n_pairs", r6("r").alias("r"), "p")


SILHOUETTE = """, c AS (SELECT labelling, label, count(*) AS n, sum(x * x + y * y) AS sq, sum(x) AS sx, sum(y) AS sy FROM l GROUP BY 1, 2),
d AS (SELECT l.labelling, l.k, l.label = c.label AS own, c.n, (l.x * l.x + l.y * l.y) * c.n + c.sq - 2 * (l.x * c.sx + l.y * c.sy) AS total FROM l JOIN c ON l.labelling = c.labelling),
s AS (SELECT labelling, k, sum(CASE WHEN own THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN NOT own THEN total / n END) AS b, sum(CASE WHEN own THEN n END) AS n FROM d GROUP BY 1, 2)
SELECT labelling, (SELECT count(*) FROM c WHERE c.labelling = s.labelling) AS k, count(*) AS n, round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s GROUP BY 1"""


@query(f"WITH {BUYERS}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS labelling, {e} AS label, k, size AS x, bal / 1000 AS y FROM buyers" for c, e in (("nation", "g"), ("region", "m"), ("segment", "CAST(seg AS BIGINT)"))) + ")" + SILHOUETTE)
def q138_silhouettes(t):
    """How well nations, regions and segments part the customers by size and balance."""
    u = buyers(t).withColumn("v", F.array("size", F.col("bal") / 1000))
    return P.silhouettes(u, "v", {"nation": "g", "region": "m", "segment": "seg"}).withColumn("silhouette", r6("silhouette"))


@query()
def q139_cluster_counts(t):
    """The silhouettes of 2 to 12 clusters, all labellings in one pass."""
    u = buyers(t).select("k", "size", (F.col("bal") / 1000).alias("b"))
    u = u.withColumn("v", F.array("size", "b"))
    for n in range(2, 13):
        u = M.kmeans(u, ["size", "b"], n, seeds=1, out=f"k{n}")
    return P.silhouettes(u, "v", {n: f"k{n}" for n in range(2, 13)}).select(F.col("labelling").cast("long").alias("clusters"), "k", "n", r6("silhouette").alias("silhouette"))


@query()
def q151_arm_report(t):
    """Arms of features on size and on size with its curve, by region, in random folds and in folds of whole nations, and how well they tell size itself."""
    u = buyers(t).withColumns({"size2": F.col("size") * F.col("size"), "whole": (F.col("g") % 5).cast("int"), "gap_b": F.when(F.col("building") == 1, F.col("gap"))})
    arms = {"balance": ["gap"], "segment": ["seg", "building"], "all": ["gap", "seg", "building"], "all_but_builders": ["seg", "gap_b"]}
    found = W.arm_report(u, TARGETS, arms, {"size": ["size"], "curve": ["size", "size2"]}, {"random": "fold", "nations": "whole"}, "m", (0.1, 10.0), "size")
    return found.select("folds", "target", "baseline", "arm", "tier", "n", *[r6(c).alias(c) for c in ("r2_baseline", "r2_full", "lift")])


@query()
def q152_leave_one_out(t):
    """What the other blocks say about each block's own columns, beyond size."""
    blocks = {"money": ["gap", "price"], "kind": ["seg", "building"], "pace": ["urgent", "spend"]}
    found = W.leave_one_out(buyers(t), blocks, ["size"], {"money": ["gap", "price"], "pace": ["urgent", "spend"]}, "fold", (0.1, 10.0))
    return found.select("block", "target", "n", *[r6(c).alias(c) for c in ("r2_baseline", "r2_full", "lift")])
