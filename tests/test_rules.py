"""Null, tie and edge rules on hand-built rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as D
from tessera.functions import semantics as S
from tessera.functions import text as T
from tessera.operators import models as M
from tessera.operators import ordered as O
from tessera.operators import regional as R
from tessera.operators import scoring as C
from tessera.operators import sections as X
from tessera.operators import statistics as ST
from tessera.sources import html, readers, sinks
from tessera.streaming import windows


def one(spark, expr, schema="x double", row=(None,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_scalar_rules(spark):
    assert one(spark, S.floored_log10("x")) is None
    assert one(spark, S.floored_log10("x"), row=(0.0,)) == 0.0
    assert one(spark, S.ratio("x", F.lit(0)), row=(1.0,)) is None
    assert one(spark, S.ratio("x", F.lit(0), 0.0), row=(1.0,)) == 0.0
    assert one(spark, S.zfill("s", 5), "s string", ("123456",)) == "123456"
    assert one(spark, S.zfill("s", 5), "s string", (" 12",)) == "00012"
    assert one(spark, S.numeric("s"), "s string", ("nan",)) is None
    assert one(spark, S.numeric("s"), "s string", ("1e3",)) == 1000.0
    assert one(spark, S.fixed_bin("x", [0, 100, 200], ["a", "b"]), row=(100.0,)) == "b"
    assert one(spark, S.fixed_bin("x", [0, 100, 200], ["a", "b"]), row=(200.0,)) is None
    assert one(spark, S.row_argmax([("a", F.lit(1)), ("b", F.lit(1)), ("c", F.lit(None))])) == "a"
    assert one(spark, S.row_argmax([("a", F.lit(None)), ("b", F.lit(None))])) is None
    assert one(spark, S.row_sum(F.lit(None), F.lit(None))) == 0.0
    assert one(spark, S.row_mean(F.lit(None), F.lit(2))) == 2.0
    assert one(spark, S.haversine(F.lit(0), F.lit(0), F.lit(0), F.lit(180))) == pytest.approx(math.pi * 6371.0088)
    assert one(spark, S.ratio_error(F.lit(5), F.lit(1), F.lit(10), F.lit(10))) == pytest.approx(math.sqrt(1 + 0.25 * 100) / 10)


def test_text_rules(spark):
    assert one(spark, T.unwiki(F.lit("[[A|b]]  [[c]] [12]x"))) == "b c x"
    assert one(spark, T.slug(F.lit("!!"))) == "untitled"
    assert one(spark, T.title(F.lit("\tCensus \n"))) == "census"
    assert one(spark, T.title_theme(F.lit("Population ranking"))) == "census"
    assert one(spark, T.title_theme(F.lit("2010 census"))) == "census"
    assert one(spark, T.title_theme(F.lit("Lakes"))) == "lists"
    assert one(spark, T.founding_year(F.lit("founded in 1822, and created around 1790."))) == 1790
    assert one(spark, T.founding_year(F.lit("none"))) is None
    assert one(spark, T.without_self(F.lit("Note. Benton County is in Washington, x"), F.lit("Benton County, Washington"))) == "is in , x"
    assert one(spark, F.size(T.chunks(F.lit("")))) == 0
    assert one(spark, F.size(T.chunks(F.lit("a" * 100_000)))) == 64


def test_bins_and_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4)], "x double")
    assert sorted(r["b"] for r in O.quantile_bin(df, "x", 2, "b").collect()) == [1, 1, 1, 2, 2, 2]
    assert sorted(r["r"] for r in O.average_ranks(df, "x", "r").collect()) == [2, 2, 2, 4, 5, 6]


def test_order_statistics_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-12, 12, 3000), np.repeat([0.0, -3.5, 7.25], 400), [1e300, -1e300, 1e-300, 2.0**-31]])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)] + [(0, None), (1, float("nan")), (None, 1.0)], "g int, x double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in O.quantiles(df, "x", shares, ["g"]).collect() if r["g"] is not None}
    for k in range(3):
        assert np.allclose(got[k], np.quantile(x[g == k], shares), rtol=1e-12)
    ranks = sorted((r["x"], r["r"]) for r in O.average_ranks(df.where("g = 1"), "x", "r").collect())
    own = np.sort(x[g == 1])
    want = (np.searchsorted(own, own, "left") + np.searchsorted(own, own, "right") + 1) / 2
    assert ranks == list(zip(own.tolist(), want.tolist()))
    keys = spark.range(5000).withColumn("g", F.col("id") % 2)
    for _ in range(2):
        places = O.numbered(keys, "id", 3, ["g"]).groupBy("g").agg(F.count_distinct("position").alias("n"), F.max("position").alias("m")).collect()
        assert {(r["n"], r["m"]) for r in places} == {(2500, 2499)}


def test_shuffles_keep_every_row(spark):
    df = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"), (F.col("id") % 7).alias("b")).repartition(9)
    moved = M.shuffles(df, "k", ["a"], [1, 2])
    for turn in (1, 2):
        rows = moved.where(F.col("turn") == turn)
        assert rows.agg(F.count_distinct("k"), F.count_distinct("a"), F.count(F.lit(1)), F.sum("a"), F.count_if(F.col("a") == 2 * F.col("k"))).first()[:4] == (50_000, 50_000, 50_000, 49_999 * 50_000)
        assert rows.where("a = 2 * k").count() < 20
    a, b = ({(r["k"], r["a"]) for r in moved.where(f"turn = {t}").limit(10**6).collect()} for t in (1, 2))
    assert len(a & b) < 20


def test_pivot_and_joins(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "k int, c string, v double")
    with pytest.raises(Exception, match="isn't unique at a"):
        R.pivot_strict(df, ["k"], "c", ["a"], "v").collect()
    assert R.pivot_sum(df, ["k"], "c", ["a", "b"], "v").first()[1:] == (5.0, 0.0)
    with pytest.raises(ValueError):
        R.star(df.select("k", "v"), "k", [df.select("k", "v")])
    assert R.herfindahl(df.withColumn("v", F.lit(0.0)), ["k"], "c", "v").first()["hhi"] is None


def test_bh_matches_a_loop(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    got = {r["i"]: r["q"] for r in R.bh(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    order = np.argsort(p)
    best, want = 1.0, {}
    for k in range(len(p), 0, -1):
        best = min(best, p[order[k - 1]] * len(p) / k)
        want[int(order[k - 1])] = best
    assert got == pytest.approx(want)


def test_sections(spark):
    s = spark.createDataFrame([(1, 5, "a", 10), (2, 1, "a", 0), (2, 2, "b", 0)], "u int, o int, t string, n int")
    assert {(r["u"], r["position"]) for r in X.positioned(s, "u", "o").collect()} == {(1, 0.0), (2, 0.0), (2, 1.0)}
    assert {r["u"]: r["gini"] for r in X.gini_of(s, "u", "n").collect()} == {1: 0.0, 2: 0.0}
    assert {r["u"]: r["decay_slope"] for r in X.decay_slope(s, "u", "n").collect()} == {1: 0.0, 2: 0.0}
    assert {r["u"]: r["jaccard"] for r in X.conformity(s, "u", "t").collect()} == {1: 1.0, 2: 0.5}
    assert one(spark, X.gini(F.array(F.lit(1.0), F.lit(3.0)))) == pytest.approx(0.25)


def test_distributions():
    assert D.t_sf(2.0, 10) == pytest.approx(0.036694017, abs=1e-8)
    assert D.t_ppf(0.95, 10) == pytest.approx(1.812461123, abs=1e-7)
    assert D.nct_cdf(D.t_ppf(0.95, 19), 19, 0.0) == pytest.approx(0.95, abs=1e-6)
    assert D.paired_power(0.5, 20) == pytest.approx(0.6951, abs=2e-3)
    assert D.n_for_power(0.5, 0.8) == 27
    assert D.signed_rank_p(0, 5) == pytest.approx(0.0625)


def test_models_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double").withColumn("fold", M.random_fold("k"))
    fold = np.array([r["fold"] for r in df.orderBy("k").collect()])
    out = np.empty(300)
    for f in range(5):
        z = np.hstack([np.ones((300, 1)), x])
        out[fold == f] = z[fold == f] @ np.linalg.lstsq(z[fold != f], y[fold != f], rcond=None)[0]
    want = 1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert C.out_of_fold(df, {"m": ["a", "b", "c"]}, "y", "fold").first()["r2"] == pytest.approx(want, abs=1e-8)
    mean, parts, share = M.principal(df, ["a", "b", "c"], 3)
    assert np.allclose(np.abs(parts @ parts.T), np.eye(3), atol=1e-8) and share.sum() == pytest.approx(1)
    moved = M.shuffled(df, "k", ["a"], 1)
    assert moved.count() == 300 and sorted(r["a"] for r in moved.collect()) == sorted(x[:, 0].tolist())
    assert ST.correlations(df.withColumn("z", F.lit(1.0)), [("a", "z")]).first()["r"] is None


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "gaz.txt").write_text("USPS\tGEOID\tNAME \nAL\t01001\tAutauga County\nPR\t72001\tAdjuntas\nVA\t51510\tAlexandria city\n")
    got = readers.crosswalk(spark, f"file://{tmp_path}/gaz.txt", {"AL": "Alabama", "VA": "Virginia"}).collect()
    assert {tuple(r) for r in got} == {("Autauga County, Alabama", "01001"), ("Alexandria City, Virginia", "51510")}
    (tmp_path / "e.csv").write_text("STATEFIPS,COUNTYFIPS,N1\n1,0,9\n1,1,5\n")
    assert readers.annual_panel(spark, {2019: f"file://{tmp_path}/e.csv"}, {"N1": "n"}).collect() == [("01001", 2019, 5.0)]
    with pytest.raises(ValueError):
        readers.annual_panel(spark, {2019: f"file://{tmp_path}/e.csv"}, {"N2": "n"})
    (tmp_path / "acs.dat").write_text("GEO_ID|B1_E001|B1_M001\n0500000US01001|5|-\n0400000US01|9|1\n")
    assert readers.summary_file(spark, f"file://{tmp_path}/acs.dat", 2022).collect() == [("01001", 5.0, None)]
    (tmp_path / "f.json").write_text('{"series_id":"s","observations":[{"date":"2020-01-01","value":"."},{"date":"2021-01-01","value":"2.5"}]}\n')
    assert readers.observations(spark, f"file://{tmp_path}/f.json").collect() == [("s", 2021, 2.5)]
    df = spark.createDataFrame([("01001", 1.0)], "fips_code string, x double")
    sinks.write_stamped(df, f"file://{tmp_path}/t", "fips_code", "2024-01-01")
    sinks.enrich(spark, f"file://{tmp_path}/t", ["y"], lambda d: d.withColumn("y", F.col("x") + 1))
    sinks.enrich(spark, f"file://{tmp_path}/t", ["y"], lambda d: d.withColumn("y", F.col("x") + 2))
    assert spark.read.parquet(f"file://{tmp_path}/t").select("as_of_date", "y").collect() == [("2024-01-01", 3.0)]
    with pytest.raises(ValueError):
        sinks.dictionary(df, {"x": "number"})
    assert sinks.dictionary(df, {"x": "number", "fips_code": "key"}).count() == 2
    built = []
    for _ in range(2):
        readers.cached(spark, f"file://{tmp_path}/c", lambda: built.append(1) or df)
    assert built == [1]


def test_columns_and_templates(spark):
    from tessera.functions import semantics as S
    from tessera.functions import text as T
    from tessera.operators import regional as R

    assert R.feature_columns(["k", "a", "size", "b"], ["k"], ["size"]) == ["a", "b"]
    blocks = {"A": ["a", "b"], "B": ["c"], "C": ["d"]}
    assert R.other_columns(blocks, ["B"]) == ["a", "b", "d"]
    with pytest.raises(ValueError):
        R.other_columns({"A": ["a"], "B": ["a"]}, [])
    left, right = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int"), spark.createDataFrame([("x", 5)], "k string, b int")
    assert sorted(map(tuple, R.one_to_one(left, right, "k").collect())) == [("x", 1, 5), ("y", 2, None)]
    with pytest.raises(Exception):
        R.one_to_one(left.unionByName(left), right, "k").collect()
    df = spark.createDataFrame([(0.0, 3, "01001"), (1.0, 1, "48301"), (None, 0, None)], "f double, n int, fips string")
    assert tuple(df.agg(S.is_flag(df, "f").alias("f"), S.is_flag(df, "n").alias("n")).first()) == (True, False)
    logs = df.select(S.typed("n", "count").alias("c"), S.typed("f", "flag").alias("f")).collect()
    assert logs[0].c == pytest.approx(1.3862943611) and logs[1].f == 1.0
    series = [r[0] for r in df.select(T.unemployment_series("fips")).collect()]
    assert "01001" in series[0] and "48301" in series[1] and series[2] is None and len(series[0]) == len(series[1])
    assert T.error_column("B19013_E001") != "B19013_E001"


def test_bucket_shares_of_an_empty_unit(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "other", 1), ("b", "x", 0), ("b", "y", 0)], "k string, bucket string, n int")
    got = {r.k: tuple(r)[1:] for r in X.bucket_shares(df, "k", "bucket", "n", ["x", "y", "other"]).select("k", "share_x", "share_y", "share_other").collect()}
    assert got == {"a": (0.75, 0.0, 0.25), "b": (0.0, 0.0, 1.0)}


def test_basket_and_splice(spark):
    from tessera.operators import rollups as U

    scores = [("t1", "full", 0.2, None), ("t2", "full", -0.1, None), ("t3", "full", 0.9, None), ("t1", "full_drop_A", None, 0.04), ("t2", "full_drop_A", None, -0.02), ("t1", "full_drop_B", None, 0.01)]
    df = spark.createDataFrame(scores, "target string, model string, lift_over_size double, contribution_ablated double")
    placebos = spark.createDataFrame([("t1", 0.01), ("t2", 0.03), ("t3", 9.0)], "target string, contribution double")
    got = {(r.statistic, r.model): r.value for r in U.basket_summary(df, placebos, ["t1", "t2", "gone"]).collect()}
    want = {("n_targets", None): 2, ("n_excluded", None): 1, ("mean_lift", "full"): 0.05, ("n_helped", "full"): 1, ("mean_contribution", "full_drop_A"): 0.01, ("n_positive", "full_drop_A"): 1, ("mean_contribution", "full_drop_B"): 0.01, ("n_positive", "full_drop_B"): 1, ("noise_mean", None): 0.02, ("noise_sd", None): 0.02 / 2**0.5, ("noise_highest", None): 0.03}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    a = spark.createDataFrame([("x", "rich", [1.0, 2.0]), ("y", "thin", [3.0, 4.0]), ("z", "thin", [5.0, 6.0])], "k string, tier string, v array<double>")
    b = spark.createDataFrame([("x", [1.0, 2.0001]), ("y", [30.0, 40.0])], "k string, v array<double>")
    assert {r.k: r.v for r in C.spliced(a, b, "k", "tier", ["thin"], "v", 0.001).collect()} == {"x": [1.0, 2.0], "y": [30.0, 40.0], "z": [5.0, 6.0]}
    with pytest.raises(ValueError, match="1 rows"):
        C.spliced(a, b, "k", "tier", ["thin"], "v", 1e-6)


def test_html_sections(spark):
    page = '<section data-mw-section-id="0">Lead<table><tr><td>t<table>u</table></td></tr></table><sup>[1]</sup> text.</section><section data-mw-section-id="1"><h2>Economy</h2>Mills [[a|b]].<section data-mw-section-id="2"><h3>Coal</h3>Dug.</section></section><section data-mw-section-id="3"><h2>See also</h2>x</section>'
    df = spark.createDataFrame([("p", page), ("q", None), ("r", "<h2>All</h2><p>of it<br>here</p><script>no</script>")], "k string, html string")
    got = [tuple(r) for r in html.sections(df, "k", "html").orderBy("k", "section_id").collect()]
    assert got == [("p", 0, "", "Lead text."), ("p", 1, "Economy", "Economy Mills b. Coal Dug."), ("p", 2, "Coal", "Coal Dug."), ("r", 0, "", "All of it here")]


def test_nested_sections_against_a_tree_walk():
    import random

    r = random.Random(5)

    def tree(depth):
        kind = r.choice(["text"] * 4 + ["p", "div", "section", "section", "section", "h2", "h3", "table", "sup", "br"])
        if depth > 5 or kind == "text":
            return r.choice(["coal", "a & b", "  ", "\n", "x < y", "[3]", "[[q|steel]]", "See also"])
        mark = r.choice([None, "0", "-1", "x", *map(str, range(1, 9))]) if kind == "section" else None
        return kind, mark, [] if kind == "br" else [tree(depth + 1) for _ in range(r.randrange(4))]

    def shown(t):
        if isinstance(t, str):
            return t.replace("&", "&amp;").replace("<", "&lt;")
        kind, mark, inner = t
        return f"<br>" if kind == "br" else f"<{kind}" + (f' data-mw-section-id="{mark}"' if mark else "") + ">" + "".join(map(shown, inner)) + f"</{kind}>"  # noqa: F541

    def strings(t, drop):
        """The strings below t; those side by side are one."""
        out, held = [], ""
        for x in t[2]:
            if isinstance(x, str):
                held += x
                continue
            out, held = out + [held] * bool(held), ""
            if not drop or x[0] not in html.DROPPED:
                out += strings(x, drop)
        return out + [held] * bool(held)

    def below(t, kinds):
        for x in t[2]:
            if not isinstance(x, str):
                if x[0] in kinds:
                    yield x
                yield from below(x, kinds)

    met = set()
    for _ in range(400):
        root = ("body", None, [tree(0) for _ in range(r.randrange(6))])
        marked = [s for s in below(root, {"section"}) if s[1] is not None and s[1] != "x"]
        lead = html.clean(strings(next((s for s in marked if s[1] == "0"), root), True))
        want = [(0, "", lead)] if lead else []
        for s in marked:
            heading = next(below(s, html.HEADINGS), None)
            title = " ".join(x if x.strip() else "\n" if "\n" in x else " " for x in strings(heading, False)).strip() if heading else ""
            text = html.clean(strings(s, True))
            if int(s[1]) > 0 and text and title.lower() not in html.SKIPPED_TITLES:
                want.append((int(s[1]), title, text))
        assert html.split("<body>" + "".join(map(shown, root[2])) + "</body>") == want
        met.add(len(want))
    assert len(met) > 5


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")
    q = windows.windowed(stream, "ts", "1 day", ["event_type"], "value", late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    a = {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()}
    b = {(r["start"], r["event_type"], r["n"]) for r in windows.windowed(source, "ts", "1 day", ["event_type"], "value").collect()}
    assert a == b
    assert windows.sessions(source, "ts", "1 hour", ["event_type"]).agg(F.sum("n")).first()[0] == source.count()


def test_quantile_between_equal_values_is_that_value(spark):
    x = 3241461.1200000006
    df = spark.createDataFrame([(1.0,)] * 4 + [(x,)] * 5 + [(2 * x,)] * 2, "x double")
    assert O.quantiles(df, "x", [0.68, 0.72, 0.78]).first()["q"] == [x, x, x]


def test_section_lexicon_with_ascii_edges(spark):
    rows = [(1, 0, "Economy", "émill"), (2, 0, "Economy", "a mill"), (3, 0, "Economy", "xmill"), (4, 0, "Economy", "mills_"), (5, 0, "Economy", "coalé")]
    s = spark.createDataFrame(rows, "u long, o long, title string, text string")
    flags = lambda edges: {r.u: r.sec_n_industry_mentions for r in X.section_lexicon(s.select("u"), s, "u", "o", "title", "text", edges=edges).collect()}
    assert flags(T.ascii_only) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert flags(T.unicode) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_stems_lose_no_match(spark):
    """Every match of a pattern holds one of its stems: each way through a pattern, and texts that hold a stem but no match."""
    patterns = T.INDUSTRY | T.INSTITUTION | T.TRANSPORT | T.OTHER_FLAGS
    assert set(T.STEMS) == set(patterns.values())
    ways = ["manufactures", "factory", "factories", "mill", "mills", "industrial park", "mining", "mine", "mines", "coal", "quarry", "quarries", "oil", "petroleum", "natural gas", "refinery", "refineries", "oilfield", "agriculture", "farming", "farmland", "ranching", "crop", "crops", "livestock", "tourism", "touristic", "resort", "resorts", "ski", "casino", "casinos", "vacation", "timber", "logging", "lumber", "forestry", "sawmills", "shipping", "freight", "distribution center", "distribution centre", "warehouse"]
    ways += ["University", "College", "Air Force Base", "Air Force Station", "Naval Base", "Naval Air", "Naval Shipyard", "Marine Corps Base", "Marine Corps Air", "Army Base", "Army Depot", "Army Garrison", "military base", "military installation", "Fort Xavier Army", "Fort Xa Base", "National Park", "National Forest", "National Monument", "Wildlife Refuge", "Indian Reservation", "Reservation of", "federally recognized", "Navajo Nation", "Hopi Nation", "Tribe of", "River", "Creek", "Interstate", "U.S. Route", "Highway", "Port of", "Harbor", "Harbour", "seaport"]
    ways += ["Metropolitan Statistical Area", "metropolitan area", "Micropolitan", "micropolitan", "named for", "Named after", "named in honor of", "Department of Agriculture", "department of Agriculture", "retirement destination", "persistent poverty", "high-recreation", "farming-dependent", "mining dependent"]
    texts = [*ways, *[f"the {w}, then" for w in ways], *[f"é{w}é" for w in ways], "turmoil", "skin", "determine", "Nations", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {f"plain_{k}": F.coalesce(F.col("t").rlike(T.unicode(p)), F.lit(False)) for k, p in patterns.items()}
    for r in df.select("t", *[c.alias(k) for k, c in (T.flags("t", patterns) | plain).items()]).collect():
        assert all(r[k] == r[f"plain_{k}"] for k in patterns), r
        assert r.t not in ways or any(r[k] for k in patterns), r


def test_own_names_in_other_cases(spark):
    rows = [("Kis\u0131n town. KISIN is old.", "Kisin, State"), ("\u212aisin, sTate and \u017ftate", "Kisin, State"), ("  a \n\n b\tc  d ", "Zed, State"), ("état État", "No, état"), (None, "A, B"), ("States state", "Q, State")]
    df = spark.createDataFrame(rows, "t string, n string")
    got = [r.x for r in df.select(T.without_self("t", F.col("n")).alias("x")).collect()]
    assert got == ["is old.", "and", "a b c d", "", None, "States"]
