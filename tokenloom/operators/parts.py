"""Checks on parts of a corpus before they are merged: each gives the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What all parts must agree on, and what a merge adds up.
AGREED_FIELDS = ["version", "kind", "seq_len", "vocab_size", "tokenizer_sha256"]
COUNT_FIELDS = ["train", "val", "skipped"]


def layout_faults(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with a ``reason`` (null when sound), checked by size only, as a merge does.

    ``entries``: ``kind``, ``seq_len``, ``file``, ``mask``; ``files``: ``file``, ``bytes``.
    """
    masks = files.select(F.col("file").alias("mask"), F.col("bytes").alias("mask_bytes"))
    joined = entries.join(files, "file", "left").join(masks, "mask", "left")
    tokens = F.floor(F.col("bytes") / F.lit(2))
    sft = F.col("kind") == "sft"
    reason = (
        F.when(F.col("bytes").isNull(), F.lit("absent"))
        .when(F.col("bytes") % 2 != 0, F.lit("odd_bytes"))
        .when(sft & (tokens % (F.col("seq_len") + 1) != 0), F.lit("ragged_rows"))
        .when(
            sft & (F.col("mask_bytes").isNull() | (F.col("mask_bytes") != tokens)),
            F.lit("bad_mask"),
        )
    )
    return joined.withColumn("reason", reason)


def missing_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    return entries.join(files, "file", "left_anti")


def checksum_faults(entries: DataFrame, hashed: DataFrame) -> DataFrame:
    """Entries whose shard or mask content differs from the recorded hash, or is absent."""
    shard = hashed.select("file", F.col("sha256").alias("actual"))
    mask = hashed.select(F.col("file").alias("mask"), F.col("sha256").alias("mask_actual"))
    joined = entries.join(shard, "file", "left").join(mask, "mask", "left")
    wrong_shard = ~F.col("actual").eqNullSafe(F.col("sha256"))
    wrong_mask = F.col("mask").isNotNull() & ~F.col("mask_actual").eqNullSafe(F.col("mask_sha256"))
    return joined.where(wrong_shard | wrong_mask)


def disagreements(parts: DataFrame, fields: Sequence[str] = AGREED_FIELDS) -> DataFrame:
    """``field``, ``values``: how many different values each field has over all parts, when not 1.

    Pass ``split_names`` as one more field to compare which splits the parts declare.
    """
    described = parts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"), F.col(f).cast("string").alias("value")
                    )
                    for f in fields
                ]
            )
        )
    )
    return (
        described.groupBy("field")
        .agg(
            (
                F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))
            ).cast("bigint").alias("values")
        )
        .where("values > 1")
    )


def duplicate_files(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")


def merged_counts(parts: DataFrame) -> DataFrame:
    """Sum of each count; other counts and absent ones do not matter."""
    return parts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNT_FIELDS]
    )
