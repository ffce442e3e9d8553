"""Pack conversations: first prompt wins, check, template, mask, pad, shard, write, list."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.operators import budget
from tokenloom.operators import conversations as convs
from tokenloom.operators.running import running_totals
from tokenloom.operators.shards import CHAT_SHARD_TOKENS, roll_equal_rows
from tokenloom.operators.vocab import Vocabulary, encoder
from tokenloom.session import materialize, scratch
from tokenloom.sources.manifests import write_manifest
from tokenloom.sources.shards import shard_entries


@dataclass(frozen=True)
class ChatPack:
    """Default sizes. A budget is taken only if it is named: None packs everything."""

    seq_len: int = 1024
    max_examples: int | None = None
    max_docs: int | None = None
    shard_tokens: int = CHAT_SHARD_TOKENS
    tag: str | None = None


def encoded_turns(turns: DataFrame, vocabulary: Vocabulary, by=()) -> DataFrame:
    """Message rows with body ``ids``; a null text keeps null ids and fails the blank check later."""
    encode = encoder(turns.sparkSession, vocabulary)
    return turns.select(
        *by, "conv_id", "turn", "role", "text", encode(text.neutralize(F.col("text"))).alias("ids")
    )


def chat_rows(turns: DataFrame, vocabulary: Vocabulary, o: ChatPack, by=()):
    """Placed chat rows (one per kept conversation) and every judged conversation that was read.

    With ``by`` each source is deduplicated and cut on its own, all in the same jobs.
    """
    by = list(by)
    if o.max_docs is not None:
        turns = _first_conversations(turns, o.max_docs, by)
    if o.max_examples is not None:
        turns = _up_to_stops(turns, o, by)
    encoded = materialize(encoded_turns(turns, vocabulary, by), "encoded-turns")
    judged = materialize(
        convs.judged(encoded, o.seq_len, F.size("ids").cast("bigint"), by), "judged"
    )
    accepted = judged.where("reason is null")
    cuts = budget.example_cuts(accepted, "conv_id", o.max_examples, by)
    if by:
        read = budget.apply_cuts(judged, cuts, "conv_id", by, keep_capped=True)
    else:
        row = cuts.first()
        read = judged.where(budget.Cut(row["stop"] if row else None, None).read("conv_id"))
    chosen = materialize(read.where("reason is null").select(*by, "conv_id", "split"), "chosen")
    ranked = running_totals(chosen, "conv_id", {"nth": F.lit(1)}, [*by, "split"]).withColumn(
        "nth", F.col("nth") - 1
    )
    where = roll_equal_rows(ranked, "nth", o.seq_len + 1, o.shard_tokens)
    rows = convs.examples(encoded, chosen, o.seq_len, F.col("ids"), by)
    placed = rows.join(where.select(*by, "conv_id", "split", "shard", "offset"), [*by, "conv_id"])
    return placed, read


def _first_conversations(turns: DataFrame, max_docs: int, by) -> DataFrame:
    ids = materialize(turns.select(*by, "conv_id").distinct(), "conversation-ids")
    if not by:
        last = budget.first_rows_cut(ids, "conv_id", max_docs)
        return turns if last is None else turns.where(F.col("conv_id") <= last)
    from tokenloom.operators.running import first_crossings

    cuts = first_crossings(ids, "conv_id", {"rows": (F.lit(1), max_docs)}, by)
    joined = turns.join(cuts.select(*by, "rows_at"), by, "left")
    return joined.where("rows_at is null or conv_id <= rows_at").drop("rows_at")


def _up_to_stops(turns: DataFrame, o: ChatPack, by) -> DataFrame:
    """The turns up to a conversation at which ``max_examples`` is surely met, known before anything
    is encoded: an id stands for a byte at least, so what fits in bytes fits in ids."""
    sure = materialize(convs.judged(turns, o.seq_len, by=by), "judged-by-bytes").where("reason is null")
    stops = budget.example_cuts(sure, "conv_id", o.max_examples, by).select(*by, F.col("stop").alias("_upto"))
    if not by:
        row = stops.first()
        return turns if row is None or row["_upto"] is None else turns.where(F.col("conv_id") <= row["_upto"])
    joined = turns.join(F.broadcast(stops), by, "left")  # a row for each part, as there are manifests
    return joined.where("_upto is null or conv_id <= _upto").drop("_upto")


def pack_conversations(
    turns: DataFrame,
    vocabulary: Vocabulary,
    tokenizer_sha256: str,
    out: str,
    options: ChatPack = ChatPack(),
    source: dict | None = None,
    may_be_empty: bool = False,
) -> dict:
    """Write chat shards with masks and their manifest below ``out``; gives the manifest. A part of
    few conversations ``may_be_empty`` in a split."""
    with scratch(turns.sparkSession):
        placed, read = chat_rows(turns, vocabulary, options)
        prefix = f"{options.tag}-" if options.tag else ""
        entries = materialize(shard_entries(placed, prefix, out, with_mask=True), "entries")
        name = f"manifest.{options.tag}.json" if options.tag else "manifest.json"
        counts = _counts(read).get((), {})
        return write_manifest(
            f"{out}/{name}", _header(options, vocabulary, tokenizer_sha256, counts, source), entries,
            may_be_empty=may_be_empty,
        )


def pack_sources(
    turns: DataFrame,
    vocabulary: Vocabulary,
    tokenizer_sha256: str,
    out: str,
    options: ChatPack = ChatPack(),
) -> list[dict]:
    """Pack several sources (column ``part``) in one pass, one manifest part each, for a merge."""
    with scratch(turns.sparkSession):
        placed, read = chat_rows(turns, vocabulary, options, by=("part",))
        entries = materialize(
            shard_entries(placed, "", out, with_mask=True, by_part=True), "entries"
        )
        written = []
        for (part,), counts in sorted(_counts(read, ["part"]).items()):
            header = _header(options, vocabulary, tokenizer_sha256, counts, {"part": part})
            mine = entries.where(F.col("part") == part)
            written.append(write_manifest(f"{out}/manifest.{part}.json", header, mine))
        return written


def _counts(read: DataFrame, by=()) -> dict[tuple, dict]:
    """Counts per part: a few rows, one per part and label."""
    label = F.when(F.col("reason").isNull(), F.col("split")).otherwise(F.lit("skipped"))
    out: dict[tuple, dict] = {}
    for r in read.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("n")).collect():
        key = tuple(r[b] for b in by)
        out.setdefault(key, {"train": 0, "val": 0, "skipped": 0})[r["label"]] = r["n"]
    return out


def _header(options, vocabulary, tokenizer_sha256, counts, source) -> dict:
    return {
        "version": 1,
        "kind": "sft",
        "seq_len": options.seq_len,
        "vocab_size": len(vocabulary),
        "tokenizer_sha256": tokenizer_sha256,
        "counts": {"train": 0, "val": 0, "skipped": 0, **counts},
        "source": {**asdict(options), **(source or {})},
    }
