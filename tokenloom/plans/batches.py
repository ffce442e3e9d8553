"""What a trainer reads: inputs and targets in order, with the main and decay corpora mixed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.schedule import Schedule
from tokenloom.operators import blocks, mix
from tokenloom.operators.order import EpochOrder, ReaderState, next_positions
from tokenloom.session import materialize
from tokenloom.sources.corpus import Corpus


def training_batches(
    spark: SparkSession,
    corpora: dict[str, Corpus],
    schedule: Schedule,
    seq_len: int,
    micro_batch: int,
    accumulation: int,
    seed: int = 42,
    drawn: Callable[[int, int, int], EpochOrder] = EpochOrder.drawn,
) -> DataFrame:
    """``slot``, ``row``, ``source``, ``x``, ``y`` for every microbatch of the schedule.

    ``corpora`` holds ``main`` and, if the last phase mixes another corpus in, ``decay``. Each
    source walks its own epochs in its own drawn order. Slots are looked up in the index ranges of
    the shards and sent to them, sorted by block: a shard is opened by one task, only asked blocks
    are read, and tokens have not moved when they leave it. Reading order is up to the writer.
    """
    if "decay" not in corpora:
        schedule = replace(schedule, decay_mix=0.0)
    slots = mix.training_slots(spark, schedule, seq_len, micro_batch, accumulation, seed)
    sizes = {s: c.n for s, c in corpora.items()}
    epochs = mix.epochs_read(slots, micro_batch, sizes)
    orders = {s: [drawn(n, seed, e) for e in range(epochs[s])] for s, n in sizes.items()}
    wanted = materialize(mix.slot_blocks(slots, micro_batch, orders), "slot-blocks")
    joined = None
    for source, corpus in corpora.items():
        rows = corpus.fetch(wanted.where(F.col("source") == source))
        joined = rows if joined is None else joined.unionByName(rows)
    x, plain = blocks.training_pair(F.col("tokens"))
    _, masked = blocks.training_pair(F.col("tokens"), F.col("mask"))
    y = F.when(F.col("mask").isNull(), plain).otherwise(masked)
    return joined.select("slot", "row", "source", "epoch", x.alias("x"), y.alias("y"))


def write_batches(batches: DataFrame, path: str) -> None:
    """Parquet in reading order: files and row groups follow ``slot``, then ``row``."""
    batches.orderBy("slot", "row").write.mode("errorifexists").parquet(path)


def resumed(corpus: Corpus, state: ReaderState, batch: int, drawn=EpochOrder.drawn) -> tuple[DataFrame, ReaderState]:
    """The next ``batch`` blocks of a corpus from a saved state, and the state after them.

    The state must belong to this corpus. Positions are made, not looked for: a batch costs its own
    rows, however long the epoch is, and may go past its end into the next order.
    """
    state.check(state.seed, corpus.fingerprint)
    wanted, after = next_positions(corpus.blocks.sparkSession, corpus.n, state, batch, drawn)
    return corpus.fetch(wanted), after
