"""Which rows a budget keeps.

Every budget is a sequential rule ("stop after the row that reaches N"). A running
total only grows, so each rule comes down to one cut in the order column. The cuts are scalars: the
kept rows are then a row-local predicate that reaches the scan as a literal filter, and the wide
text rows are never joined, sorted or shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.running import ROWS_PER_CHUNK, first_crossings


NO_LIMIT = 1 << 62  # more than any total, so a budget of None never ends a scan


@dataclass(frozen=True)
class Cut:
    """``stop``: last order value read. ``val_stop``: last one at which a val row is kept."""

    stop: int | None
    val_stop: int | None

    def read(self, ord_col: str) -> Column:
        """Rows seen before the scan ends, kept or not."""
        return F.lit(True) if self.stop is None else F.col(ord_col) <= self.stop

    def keep(self, ord_col: str, split_col: str = "split") -> Column:
        """Rows that are written."""
        kept = self.read(ord_col)
        if self.val_stop is not None:
            kept = kept & ((F.col(split_col) != "val") | (F.col(ord_col) <= self.val_stop))
        return kept


def _of(split: str, amount: str) -> Column:
    return F.when(F.col("split") == split, F.col(amount)).otherwise(F.lit(0)).cast("bigint")


def token_cuts(
    lengths: DataFrame,
    ord_col: str,
    max_tokens: int | None,
    val_tokens: int | None,
    seq_len: int,
    by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per group with ``stop`` and ``val_stop``; ``lengths`` has ``split`` and ``n_tokens``.

    Val rows are kept while the total before them is below ``val_tokens``, so the row that crosses
    is the last. The scan stops at the first row with enough train tokens and at least one val
    block. Past the cap the val total is frozen, so a cap that froze it too low never stops. A
    budget of None has no end: all rows are read, or all val rows are kept.
    """
    max_tokens = NO_LIMIT if max_tokens is None else max_tokens
    val_tokens = NO_LIMIT if val_tokens is None else val_tokens
    if val_tokens < 1:
        raise ValueError("val_tokens must be positive")
    crossed = first_crossings(
        lengths,
        ord_col,
        {
            "train": (_of("train", "n_tokens"), max(1, max_tokens)),
            "cap": (_of("val", "n_tokens"), val_tokens),
            "block": (_of("val", "n_tokens"), seq_len + 1),
        },
        by,
        rows_per_chunk,
    )
    reachable = F.coalesce(F.col("cap_total") >= seq_len + 1, F.lit(True))
    stop = F.when(
        F.col("train_at").isNotNull() & F.col("block_at").isNotNull() & reachable,
        F.greatest("train_at", "block_at"),
    )
    return crossed.select(*by, stop.alias("stop"), F.col("cap_at").alias("val_stop"))


def token_cut(lengths: DataFrame, ord_col: str, **kw) -> Cut:
    """:func:`token_cuts` for a single group, as two driver-side integers."""
    row = token_cuts(lengths, ord_col, **kw).first()
    return Cut(row["stop"], row["val_stop"]) if row else Cut(None, None)


@dataclass(frozen=True)
class Totals:
    """What earlier batches of a stream have kept: all a budget needs to go on."""

    train: int = 0
    val: int = 0
    stopped: bool = False


BEFORE_ALL = -NO_LIMIT - 1


def carried_cut(
    lengths: DataFrame,
    ord_col: str,
    before: Totals,
    max_tokens: int | None,
    val_tokens: int | None,
    seq_len: int,
) -> tuple[Cut, Totals]:
    """The cut of one batch of a budget that began in earlier batches, and the totals after it.

    The rule is that of :func:`token_cuts` over all batches in turn: what earlier ones reached is
    reached, and only what is still open is looked for.
    """
    if before.stopped:
        return Cut(BEFORE_ALL, BEFORE_ALL), before
    goals = {
        "train": ("train", (NO_LIMIT if max_tokens is None else max_tokens) - before.train),
        "cap": ("val", (NO_LIMIT if val_tokens is None else val_tokens) - before.val),
        "block": ("val", seq_len + 1 - before.val),
    }
    open_ = {n: (_of(split, "n_tokens"), left) for n, (split, left) in goals.items() if left > 0}
    found = first_crossings(lengths, ord_col, open_).first() if open_ else None
    found = found.asDict() if found else {}
    at = {n: found.get(f"{n}_at") if n in open_ else BEFORE_ALL for n in goals}
    # A val total that its cap froze below one block never stops the scan.
    if "cap" not in open_:
        frozen = "block" in open_
    else:
        frozen = at["cap"] is not None and before.val + found["cap_total"] < seq_len + 1
    stop = None
    if at["train"] is not None and at["block"] is not None and not frozen:
        stop = max(at["train"], at["block"])
    cut = Cut(stop, at["cap"])
    kept = {
        r["split"]: r["n"]
        for r in lengths.where(cut.keep(ord_col)).groupBy("split").agg(F.sum("n_tokens").alias("n")).collect()
    }
    after = Totals(before.train + kept.get("train", 0), before.val + kept.get("val", 0), stop is not None)
    return cut, after


def apply_cuts(
    rows: DataFrame, cuts: DataFrame, ord_col: str, by: Sequence[str], keep_capped: bool = False
) -> DataFrame:
    """Rows kept under per-group cuts. ``cuts`` has one row per group; groups without a row keep all."""
    joined = rows.join(cuts.select(*by, "stop", "val_stop"), list(by), "left")
    kept = F.col("stop").isNull() | (F.col(ord_col) <= F.col("stop"))
    if not keep_capped:
        kept = kept & (
            (F.col("split") != "val")
            | F.col("val_stop").isNull()
            | (F.col(ord_col) <= F.col("val_stop"))
        )
    return joined.where(kept).drop("stop", "val_stop")


def example_cuts(
    accepted: DataFrame,
    ord_col: str,
    max_examples: int | None,
    by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Stop of a chat pack: enough accepted train conversations and at least one val conversation.
    None takes all conversations."""
    max_examples = NO_LIMIT if max_examples is None else max_examples
    one = accepted.withColumn("_one", F.lit(1))
    crossed = first_crossings(
        one,
        ord_col,
        {"train": (_of("train", "_one"), max(1, max_examples)), "val": (_of("val", "_one"), 1)},
        by,
        rows_per_chunk,
    )
    stop = F.when(
        F.col("train_at").isNotNull() & F.col("val_at").isNotNull(),
        F.greatest("train_at", "val_at"),
    )
    return crossed.select(*by, stop.alias("stop"), F.lit(None).cast("bigint").alias("val_stop"))


def example_cut(accepted: DataFrame, ord_col: str, max_examples: int | None, **kw) -> Cut:
    row = example_cuts(accepted, ord_col, max_examples, **kw).first()
    return Cut(row["stop"], None) if row else Cut(None, None)


def first_rows_cut(ids: DataFrame, ord_col: str, n: int, rows_per_chunk: int = ROWS_PER_CHUNK):
    """Order value of the n-th row, or None when there are fewer. Reads the order column only."""
    row = first_crossings(
        ids.select(ord_col), ord_col, {"rows": (F.lit(1), n)}, rows_per_chunk=rows_per_chunk
    ).first()
    return row["rows_at"] if row else None


def chars_cut(lengths: DataFrame, ord_col: str, max_chars: int, rows_per_chunk: int = ROWS_PER_CHUNK):
    """Last row of a tokenizer sample: the one whose characters reach ``max_chars``."""
    row = first_crossings(
        lengths, ord_col, {"chars": ("n_chars", max(1, max_chars))}, rows_per_chunk=rows_per_chunk
    ).first()
    return row["chars_at"] if row else None
