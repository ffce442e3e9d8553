"""The corpus pipeline: raw documents in, a deduplicated, mixed and tokenised corpus out.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` with the documents its
predecessor kept and returns a DataFrame; all but the last return the columns of ``documents``.

Odd rows: null, empty and blank texts have no language and go in the first stage, so later stages
meet them only if called alone; they then treat them as their operators' docstrings say. Very long
texts are worked on whole. Repeated rows are rows like any other until near-duplicate removal, which
goes by id. Ties fall to the smaller id. Columns besides those of ``documents`` are dropped, whatever
their names. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe, language, lines, mixing, simhash, word_bpe
from tokenloom.llm.common import materialize, ready

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.05  # of the language found; texts of any of the learned languages reach 0.2
ORACLE_SQL = None  # fingerprints, hash keys and token ids are not SQL; tests compare by brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or in no learned language; fills in a language that is null."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.fit(docs, F.lit(True)))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line equals but for two edits; every document stays."""
    ready(spark)
    kept = lines.drop_lines(docs.select(*COLUMNS), edits=2, min_chars=20)
    changed = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of linked fingerprints."""
    ready(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), words=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents by source weight, repeated where a source is smaller than its share."""
    ready(spark)
    return mixing.apply_mix(docs.select(*COLUMNS), weights=(5, 2, 1), cap=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the digest of what they decode to."""
    ready(spark)
    path = word_bpe.default_path()
    coded = bpe.round_trip(docs.select(*COLUMNS), path)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
