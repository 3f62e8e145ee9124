"""One query for each operator of this package, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, byte_bpe, cascade, licenses, media, packing, quality, secret_scan, simhash, token_counts, token_files, toxicity, vectors
from tessera.llm.common import table

PACK_TOKENS, TOXIC_AT, QUALITY_AT = 2048, 0.7, 0.5
PAGE_COLUMNS = ["lang", "source", "n_chars"]


def doc_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def held_out() -> Column:
    """Rows that classifiers never learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def path(name: str) -> str:
    return public_tokenizers.path(name)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(doc_id(), "text")


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out())


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(texts(spark, sf_dir), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.fit(docs, learnable(spark, sf_dir))
    return toxicity.with_toxicity(docs, model, TOXIC_AT).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(texts(spark, sf_dir), 0.8)
    names = F.array_join(F.array_sort(F.array_distinct("licenses.license")), "; ")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), names.alias("licenses"), F.array_max("licenses.coverage").alias("best_coverage"), F.array_min("licenses.start").alias("first_start"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.write(texts(spark, sf_dir), path("byte_bpe_50k.json"), end_id=2))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir), path("byte_bpe_50k.json"), end_id=1, capacity=PACK_TOKENS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(texts(spark, sf_dir), path("piece_bpe_32k.model"), 4096).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts(spark, sf_dir), bits=4, words_in_shingle=4)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(texts(spark, sf_dir)).drop("text")).drop("media")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(doc_id(), "text", *PAGE_COLUMNS)
    model = quality.fit(docs, learnable(spark, sf_dir), PAGE_COLUMNS)
    return quality.with_quality(docs, model, QUALITY_AT).select("doc_id", held_out().alias("held_out"), "quality_score", "quality_kept")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), least=0.98)


def op11_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.replay(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(texts(spark, sf_dir), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))[0]


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return secret_scan.with_findings(docs, secret_scan.fit(docs)).drop("text")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_licenses, op4_token_files, op5_packing, op6_token_counts, op7_simhash, op8_telephony, op9_quality, op10_vectors, op11_cascade, op12_alignment, op13_secrets)}
#: SQL for the queries that DuckDB can express; none can, so the tests hold them against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {}
