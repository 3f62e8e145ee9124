"""One row of each group of near copies, with repeated and missing ids."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.common import ready


def test_one_row_of_each_group(spark):
    a, b, c = ("".join(random.Random(seed).choices("abcdefgh ", k=900)) for seed in (1, 2, 3))
    near = a.upper()  # the same fingerprint
    rows = [(3, a, "first"), (5, near, "copy"), (5, b, "another text"), (7, c, "twice"), (7, c, "twice"), (None, c, "copy"), (None, "x " + "only here " * 40, "no id"), (None, "x " + "only here " * 40, "no id")]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(map(str, corpus_pipeline.drop_near_copies(spark, df, "").select("doc_id", "source").collect()))
    assert kept == sorted(["Row(doc_id=3, source='first')", "Row(doc_id=5, source='another text')", "Row(doc_id=7, source='twice')", "Row(doc_id=None, source='no id')"])
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    own = {t: simhash.fingerprint(t) for t in (a, b, c)}
    assert (found[3, own[a]], found[5, own[a]], found[5, own[b]], found[None, own[c]]) == (3, 3, 5, 7)
    # A link between different fingerprints, and a node whose id is another text's id too.
    fps = spark.createDataFrame([(8,), (9,), (-(1 << 40),), (1 << 50 | 255,)], "fp long")
    assert {r["fp"]: r["root"] for r in simhash.rooted(fps).collect()} == {8: 8, 9: 8, -(1 << 40): -(1 << 40), 1 << 50 | 255: 1 << 50 | 255}


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns that clash with the operators' own."""
    folder = "/root/testdata/sf0.001"
    plain = ready(spark).read.parquet(f"{folder}/documents.parquet").collect()
    extra = [(None, None, None, None, None), (None, "", "en", None, 0), (7, None, None, "s", None), (-1, "one two three", "en", "s", -5), (-2, "the and of " * 60_000, "en", "s", 660_000)]
    rows = [tuple(r) + ("a", 1.5, True, "b", 9) for r in [*plain, *plain[:5], *extra, *extra]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, quality_score double, quality_kept boolean, component_id string, fp long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert (out.columns, out.dtypes) == (df.columns, df.dtypes)
        kept = out.collect()
        assert len(kept) > 0.5 * len(plain) and {tuple(r) for r in kept} <= set(rows)
        if name == "near_copies":
            prints = simhash.near_duplicates(df).select(F.col("fingerprint").alias("fp")).distinct()
            assert len(kept) == simhash.rooted(prints).select("root").distinct().count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, folder)
    assert pieces.where("start = 0").count() == len(rows)
