"""Fixed-length training blocks, cut out of shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.running import running_totals


def usable_blocks(tokens: Column, seq_len: int) -> Column:
    """Blocks in a shard: stride ``seq_len``, one token more for the last target, tail dropped."""
    return F.greatest(F.lit(0), F.floor((tokens - 1) / F.lit(seq_len))).cast("bigint")


def offsets_in_shards(
    rows: DataFrame, ord_col: str, n_tokens: Column, by: Sequence[str] = ("split",)
) -> DataFrame:
    """``rows`` that know their ``shard``, with the ``offset`` at which each begins in it.

    Rows move once, to their shard, as shards are written; blocks cut from them stay there. Hand in
    texts rather than ids: they are a quarter of the size, and ids can be made where they arrive.
    """
    mine = Window.partitionBy(*by, "shard").orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(n_tokens).over(mine), F.lit(0)).cast("bigint"))


def cut_blocks(
    placed: DataFrame, seq_len: int, by: Sequence[str] = ("split",), ids: str = "ids"
) -> DataFrame:
    """Blocks ``by``, ``shard``, ``block``, ``tokens`` of ``seq_len + 1`` ids.

    ``placed`` has one row per document with its ids, ``shard`` and ``offset``. Tokens are never
    exploded: each document sends one slice to every block it touches, and a block gathers at most
    ``seq_len + 1`` tokens, so no group can grow. The last token of a block is the first of the
    next. Tails come out short and are dropped.
    """
    start, size = F.col("offset"), F.size(ids).cast("bigint")
    end = start + size
    first = F.greatest(F.lit(0), F.floor((start - 1) / F.lit(seq_len)))
    last = F.floor((end - 1) / F.lit(seq_len))

    def piece(block: Column) -> Column:
        lo = F.greatest(start, block * seq_len)
        hi = F.least(end, block * seq_len + seq_len + 1)
        return F.struct(
            block.alias("block"),
            lo.alias("at"),
            F.slice(ids, (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("ids"),
        )

    pieces = placed.select(
        *by, "shard", F.inline(F.transform(F.sequence(first, last), piece))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "ids")))
    return (
        pieces.groupBy(*by, "shard", "block")
        .agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("tokens"))
        .where(F.size("tokens") == seq_len + 1)
    )


def block_starts(shards: DataFrame, seq_len: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """Shards with ``blocks`` and the global index range ``[first_block, end_block)`` of each."""
    counted = shards.withColumn("blocks", usable_blocks(F.col("tokens"), seq_len))
    ranged = running_totals(counted, "shard", {"end_block": "blocks"}, by)
    return ranged.withColumn("first_block", F.col("end_block") - F.col("blocks")).drop("_chunk")


def require_blocks(shards: DataFrame, seq_len: int, split: str) -> int:
    """Number of usable blocks of a split; none is an error."""
    n = (
        shards.where(F.col("split") == split)
        .agg(F.sum(usable_blocks(F.col("tokens"), seq_len)))
        .first()[0]
    )
    if not n:
        raise ValueError(f"The {split} split is too short for one block")
    return n


def lookup_blocks(wanted: DataFrame, index_col: str, ranges: DataFrame) -> DataFrame:
    """Shard and local block of each global block index.

    A range join made an equi join: both sides are laid on a grid as wide as the largest shard, so
    a shard meets at most two grid cells and an index exactly one.
    """
    used = ranges.where(F.col("blocks") > 0)
    width = used.agg(F.max("blocks")).first()[0] or 1
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    cells = used.select(
        "shard",
        "first_block",
        "end_block",
        F.explode(F.sequence(cell(F.col("first_block")), cell(F.col("end_block") - 1))).alias("_cell"),
    )
    index = F.col(index_col)
    return (
        wanted.withColumn("_cell", cell(index))
        .join(cells, "_cell")
        .where((index >= F.col("first_block")) & (index < F.col("end_block")))
        .withColumn("block", index - F.col("first_block"))
        .drop("_cell", "first_block", "end_block")
    )


def training_pair(tokens: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """Inputs and next-token targets; a target without supervision becomes -100."""
    size = F.size(tokens) - 1
    x, y = F.slice(tokens, F.lit(1), size), F.slice(tokens, F.lit(2), size)
    if mask is not None:
        y = F.zip_with(
            y, F.slice(mask, F.lit(2), size), lambda t, m: F.when(m == 0, F.lit(-100)).otherwise(t)
        )
    return x, y
