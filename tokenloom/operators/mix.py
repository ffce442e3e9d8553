"""Which corpus each microbatch reads, and which block of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.schedule import Schedule, phase, rate
from tokenloom.operators.order import EpochOrder, affine
from tokenloom.operators.running import running_totals
from tokenloom.session import materialize


def update_table(spark: SparkSession, s: Schedule, batch_tokens: int) -> DataFrame:
    """One row per update: tokens before and after it, phase and rate (taken after)."""
    updates = s.total_tokens // batch_tokens
    after = (F.col("id") + 1) * batch_tokens
    return spark.range(updates).select(
        F.col("id").alias("update"),
        (F.col("id") * batch_tokens).alias("tokens_before"),
        after.alias("tokens_after"),
        phase(after, s).alias("phase"),
        rate(after, s).alias("rate"),
    )


def draw(seed: int, key: Column) -> Column:
    """A repeatable number in [0, 1) from SHA-256: the same on every engine and every retry."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def training_slots(
    spark: SparkSession, s: Schedule, seq_len: int, micro_batch: int, accumulation: int, seed: int
) -> DataFrame:
    """One row per microbatch with its ``source`` and its running number within that source.

    The decay corpus is eligible once the tokens *before* the update reach the decay phase; each
    microbatch then draws on its own.
    """
    batch_tokens = seq_len * micro_batch * accumulation
    updates = s.total_tokens // batch_tokens
    slot = F.col("id")
    before = F.floor(slot / F.lit(accumulation)) * batch_tokens
    eligible = before >= F.lit(s.total_tokens * (1 - s.decay_fraction))
    source = F.when(eligible & (draw(seed, slot) < s.decay_mix), F.lit("decay")).otherwise(
        F.lit("main")
    )
    slots = materialize(
        spark.range(updates * accumulation).select(slot.alias("slot"), source.alias("source")),
        "training-slots",
    )
    counted = running_totals(slots, "slot", {"seen": F.lit(1)}, ["source"])
    return counted.select("slot", "source", (F.col("seen") - 1).alias("nth"))


def epochs_read(slots: DataFrame, micro_batch: int, sizes: dict[str, int]) -> dict[str, int]:
    """How many epochs of each source the slots reach into (one row per source comes back)."""
    counts = {r["source"]: r["n"] for r in slots.groupBy("source").agg(F.count("*").alias("n")).collect()}
    return {s: -(-counts.get(s, 0) * micro_batch // n) for s, n in sizes.items()}


def slot_blocks(
    slots: DataFrame, micro_batch: int, orders: dict[str, Sequence[EpochOrder]]
) -> DataFrame:
    """Explode microbatches to blocks: ``slot``, ``row``, ``source``, ``epoch``, ``position``,
    ``block_index``.

    ``orders`` holds one order per epoch and source; their two integers travel as literal arrays.
    """
    cursor = F.col("nth") * micro_batch + F.col("j")
    rows = slots.select(
        "slot", "source", F.explode(F.sequence(F.lit(0), F.lit(micro_batch - 1))).alias("j"), "nth"
    ).select("slot", F.col("j").alias("row"), "source", cursor.alias("cursor"))

    def per_source(make):
        chosen = F.lit(None).cast("bigint")
        for source, epochs in orders.items():
            if epochs:
                chosen = F.when(F.col("source") == source, make(epochs)).otherwise(chosen)
        return chosen

    def size(epochs):
        return F.lit(epochs[0].n).cast("bigint")

    placed = rows.withColumn(
        "epoch", per_source(lambda e: F.floor(F.col("cursor") / size(e)).cast("bigint"))
    ).withColumn("position", per_source(lambda e: F.pmod(F.col("cursor"), size(e))))
    index = per_source(
        lambda e: affine(
            e[0].n,
            F.get(F.lit([o.a for o in e]), F.col("epoch").cast("int")),
            F.col("position"),
            F.get(F.lit([o.b for o in e]), F.col("epoch").cast("int")),
        )
    )
    return placed.select("slot", "row", "source", "epoch", "position", index.alias("block_index"))
