"""Block order per epoch, resumable by position."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EpochOrder:
    """Position ``i`` of an epoch shows block ``(a*i + b) mod n``; ``gcd(a, n) = 1``."""

    n: int
    a: int
    b: int

    def __post_init__(self):
        if self.n < 1 or math.gcd(self.a, self.n) != 1:
            raise ValueError("The multiplier must have no factor in common with the block count")

    @staticmethod
    def drawn(n: int, seed: int, epoch: int) -> "EpochOrder":
        """A new order for each epoch, drawn from the seed: two integers, made on the driver."""
        if n < 1:
            raise ValueError("No blocks to order")
        rng = np.random.default_rng(seed + epoch)  # fixed values: the draws that give the order
        a = int(rng.integers(1, max(2, n)))
        while math.gcd(a, n) != 1:
            a = (a + 1) % n or 1
        return EpochOrder(n, a, int(rng.integers(n)))

    def block_at(self, position: Column) -> Column:
        return affine(self.n, F.lit(self.a), position, F.lit(self.b))

    def position_of(self, block: Column) -> Column:
        """The inverse map, so blocks find their own position and no join is needed."""
        back = pow(self.a, -1, self.n)
        return affine(self.n, F.lit(back), block, F.lit(-back * self.b % self.n))


def affine(n: int, factor: Column, x: Column, shift: Column) -> Column:
    """``(factor * x + shift) mod n``: longs while that fits 63 bits, exact decimals beyond."""
    kind = "bigint" if (n + 1) ** 2 < 2**63 else "decimal(38,0)"
    size = F.lit(n).cast(kind)
    return F.pmod(
        F.pmod(factor.cast(kind), size) * x.cast(kind) + F.pmod(shift.cast(kind), size), size
    ).cast("bigint")


def in_epoch_order(blocks: DataFrame, index_col: str, order: EpochOrder) -> DataFrame:
    """Blocks with their ``position``; sort by it only where the output must be read in order."""
    return blocks.withColumn("position", order.position_of(F.col(index_col)))


@dataclass(frozen=True)
class ReaderState:
    """All a reader needs to resume."""

    cursor: int
    seed: int
    fingerprint: str

    def check(self, seed: int, fingerprint: str) -> None:
        if (self.seed, self.fingerprint) != (seed, fingerprint):
            raise ValueError("This position belongs to other data or another seed")


    def save(self, spark: SparkSession, path: str) -> None:
        """Append this state to the table of a reader's states; the furthest one counts."""
        spark.createDataFrame([asdict(self)], STATE).write.mode("append").parquet(path)

    @staticmethod
    def saved(spark: SparkSession, path: str) -> "ReaderState":
        row = spark.read.schema(STATE).parquet(path).orderBy(F.desc("cursor")).first()
        return ReaderState(**row.asDict())


STATE = "cursor long, seed long, fingerprint string"


def next_positions(
    spark: SparkSession,
    n: int,
    state: ReaderState,
    batch: int,
    drawn: Callable[[int, int, int], EpochOrder] = EpochOrder.drawn,
) -> tuple[DataFrame, ReaderState]:
    """``cursor``, ``epoch``, ``position``, ``block_index`` of the next ``batch`` blocks, and the new
    state. The orders of the epochs a batch touches are two integers each."""
    if batch < 1:
        raise ValueError("A batch needs at least one block")
    first, last = state.cursor // n, (state.cursor + batch - 1) // n
    orders = [drawn(n, state.seed, e) for e in range(first, last + 1)]
    nth = (F.col("epoch") - first).cast("int")
    rows = spark.range(state.cursor, state.cursor + batch).select(
        F.col("id").alias("cursor"),
        F.floor(F.col("id") / F.lit(n)).cast("long").alias("epoch"),
        F.pmod(F.col("id"), F.lit(n)).alias("position"),
    )
    index = affine(
        n, F.get(F.lit([o.a for o in orders]), nth), F.col("position"), F.get(F.lit([o.b for o in orders]), nth)
    )
    return rows.withColumn("block_index", index), ReaderState(state.cursor + batch, state.seed, state.fingerprint)


def next_batch(
    blocks: DataFrame, index_col: str, n: int, state: ReaderState, batch: int
) -> tuple[DataFrame, ReaderState]:
    """The next ``batch`` blocks from the cursor, also across an epoch end, and the new state.

    A batch spans few epochs; within each, positions are a range filter on a row-local column.
    """
    pieces, cursor, left = None, state.cursor, batch
    while left > 0:
        epoch, at = divmod(cursor, n)
        take = min(left, n - at)
        order = EpochOrder.drawn(n, state.seed, epoch)
        rows = (
            in_epoch_order(blocks, index_col, order)
            .where((F.col("position") >= at) & (F.col("position") < at + take))
            .withColumn("cursor", F.col("position") + F.lit(epoch * n))
        )
        pieces = rows if pieces is None else pieces.unionByName(rows)
        cursor, left = cursor + take, left - take
    if pieces is None:
        raise ValueError("A batch needs at least one block")
    return pieces, ReaderState(cursor, state.seed, state.fingerprint)


def validation_subset(blocks: DataFrame, index_col: str, n: int, micro_batch: int, eval_batches: int):
    """The fixed validation blocks: seed 0, from the start."""
    return next_batch(blocks, index_col, n, ReaderState(0, 0, ""), micro_batch * eval_batches)[0]
