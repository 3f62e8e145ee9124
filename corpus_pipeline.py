"""From raw documents to packed training sequences: toxic and low-quality documents go, one of each group of near copies stays, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, quality, simhash, toxicity
from tessera.llm.common import ready, staged, table
from tessera.llm.queries import PACK_TOKENS, PAGE_COLUMNS, QUALITY_AT, TOXIC_AT, learnable, path


#: Units whose ids a worker keeps in the last stage, where it still holds what earlier stages left behind.
CACHED_UNITS = 250_000


def own_names(n: int) -> list[str]:
    """Column names that no table has."""
    return [f"_{uuid.uuid4().hex}" for _ in range(n)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below 0.7; the classifier learns from those of them that are labelled.

    Null and empty texts score as texts without any word, very long ones by all their words; repeated rows are judged each,
    alike; rows with a null id stay unless their text is toxic; other columns, whatever their names, stay as they are; an empty table stays empty."""
    model = toxicity.fit(docs, learnable(spark, sf_dir))
    score, toxic = own_names(2)
    return toxicity.with_toxicity(docs, model, TOXIC_AT, out=(score, toxic)).where(f"{toxic} = 0").drop(score, toxic)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is at least 0.5; null texts count as empty and null columns as a value of their own.

    Very long texts are read whole; repeated rows are judged each, alike; rows with a null id are judged like the others; other
    columns stay as they are; an empty table stays empty."""
    model = quality.fit(docs, learnable(spark, sf_dir), PAGE_COLUMNS)
    score, kept = own_names(2)
    return quality.with_quality(docs, model, QUALITY_AT, out=(score, kept)).where(kept).drop(score, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest doc_id; rows without an id give way to those with one.

    Texts without words (null, empty) are copies of each other, and so are repeated rows; very long texts are compared by the
    fingerprint of all their words; other columns stay as they are; an empty table stays empty."""
    return simhash.one_of_each(docs, bits=4, words_in_shingle=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are their end id alone; a very long text spans sequences; repeated rows are packed each; rows with a
    null id are packed with that id; other columns aren't read; an empty table gives no pieces."""
    return packing.pack(docs, path("byte_bpe_50k.json"), end_id=1, capacity=PACK_TOKENS, cached=CACHED_UNITS)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_copies", drop_near_copies), ("packing", pack)]
#: No SQL has the classifiers, the fingerprints or the tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again by the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
