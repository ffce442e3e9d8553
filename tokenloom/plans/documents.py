"""Pack documents: filter, split, encode, cut to budget, shard, write, list."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.operators import budget
from tokenloom.operators.running import first_crossings
from tokenloom.operators.shards import SHARD_TOKENS, assign_shards, roll_shards
from tokenloom.operators.vocab import Vocabulary, encoder
from tokenloom.session import materialize, scratch
from tokenloom.sources.documents import by_key, file_slices, known_by
from tokenloom.sources.manifests import write_manifest
from tokenloom.sources.shards import shard_entries

ORD = "doc_id"


@dataclass(frozen=True)
class DocumentPack:
    """Default sizes. A budget is taken only if it is named: None packs everything.

    ``max_docs`` bounds raw rows read, kept or not, where a caller wants that.
    """

    seq_len: int = 1024
    max_tokens: int | None = None
    val_tokens: int | None = None
    max_docs: int | None = None
    shard_tokens: int = SHARD_TOKENS
    tag: str | None = None


def first_docs(docs: DataFrame, max_docs: int | None) -> Column:
    """The first ``max_docs`` raw rows, or all, as a filter on the order column."""
    if max_docs is None:
        return F.lit(True)
    last = budget.first_rows_cut(docs, ORD, max_docs)
    return F.lit(True) if last is None else F.col(ORD) <= last


def safe_stop(
    docs: DataFrame, vocabulary: Vocabulary, o: DocumentPack, before: budget.Totals = budget.Totals()
) -> int | None:
    """A row at which the budget is surely met, known before anything is encoded.

    An id stands for ``vocabulary.longest`` bytes at most, so bytes bound the token count from
    below. A small budget over a huge corpus then encodes a small part of it. When the val cap
    could freeze the val total below one block, no row is safe.
    """
    if o.max_tokens is None or (o.val_tokens is not None and o.val_tokens < o.seq_len + 1):
        return None
    floor = materialize(least_tokens(docs, vocabulary), "least-tokens")
    return budget.carried_cut(floor, ORD, before, o.max_tokens, o.val_tokens, o.seq_len)[0].stop


def least_tokens(docs: DataFrame, vocabulary: Vocabulary, by=()) -> DataFrame:
    """Kept documents with the fewest tokens their bytes can have, end mark included."""
    t = F.col("text")
    size = text.byte_count(text.neutralize(t))
    least = F.ceil(size / F.lit(vocabulary.longest)).cast("bigint") + 1
    return docs.where(text.is_long_enough(t)).select(
        *by, ORD, text.split_of(t).alias("split"), least.alias("n_tokens")
    )


def encoded_documents(docs: DataFrame, vocabulary: Vocabulary, by=()) -> DataFrame:
    """``by``, ``doc_id``, ``split``, ``n_tokens``, ``tokens`` (end mark included) of kept documents."""
    t = F.col("text")
    encode = encoder(docs.sparkSession, vocabulary)
    rows = docs.where(text.is_long_enough(t)).select(
        *by,
        ORD,
        text.split_of(t).alias("split"),
        text.with_eos(encode(text.neutralize(t))).alias("tokens"),
    )
    return rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def held_documents(docs: DataFrame, vocabulary: Vocabulary, by=()) -> DataFrame:
    """What a pack writes once: :func:`encoded_documents`, or without merges the texts as ``body``.

    Every byte is an id then, so texts are a quarter of the ids; :func:`shard_entries` makes these.
    """
    if vocabulary.merges:
        return encoded_documents(docs, vocabulary, by)
    t = F.col("text")
    rows = docs.where(text.is_long_enough(t)).select(
        *by, ORD, text.split_of(t).alias("split"), text.neutralize(t).alias("body")
    )
    return rows.withColumn("n_tokens", text.byte_count(F.col("body")) + 1)


def kept_documents(docs: DataFrame, vocabulary: Vocabulary, o: DocumentPack):
    """Encoded documents the budget keeps, the number skipped before the stop, and the cut."""
    kept, skipped, cut, _ = carried_documents(docs, vocabulary, o, budget.Totals())
    if "body" in kept.columns:
        kept = kept.withColumn("tokens", text.with_eos(text.byte_ids(F.col("body")))).drop("body")
    return kept, skipped, cut


def carried_documents(docs: DataFrame, vocabulary: Vocabulary, o: DocumentPack, before: budget.Totals):
    """As :func:`kept_documents`, of :func:`held_documents`, but they go on from the totals of earlier
    batches; and the totals after."""
    docs = docs.where(first_docs(docs, o.max_docs))
    stop = safe_stop(docs, vocabulary, o, before)
    if stop is not None:
        docs = docs.where(F.col(ORD) <= stop)
    encoded = materialize(held_documents(docs, vocabulary), "encoded")
    cut, after = budget.carried_cut(encoded, ORD, before, o.max_tokens, o.val_tokens, o.seq_len)
    # Rows read less rows that passed the filter: counts of ids, so no text is scanned again.
    skipped = docs.where(cut.read(ORD)).select(ORD).count() - encoded.where(cut.read(ORD)).count()
    return encoded.where(cut.keep(ORD)), skipped, cut, after


def placed_documents(kept: DataFrame, o: DocumentPack) -> DataFrame:
    """Documents with ``shard`` and their order in it. Texts or tokens have not moved yet."""
    return assign_shards(kept, roll_shards(kept, ORD, o.shard_tokens), ORD)


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary,
    tokenizer_sha256: str,
    out: str,
    options: DocumentPack = DocumentPack(),
    source: dict | None = None,
    before: budget.Totals | None = None,
) -> dict:
    """Write shards and their manifest below ``out``; gives the manifest.

    A batch of a stream goes on from the totals ``before`` it and may leave a split empty; its
    manifest records the totals after it.
    """
    with scratch(docs.sparkSession):
        kept, skipped, _, after = carried_documents(docs, vocabulary, options, before or budget.Totals())
        if before is not None:
            source = {**(source or {}), "totals": asdict(after)}
        prefix = f"{options.tag}-" if options.tag else ""
        entries = materialize(
            shard_entries(placed_documents(kept, options), prefix, out), "entries"
        )
        totals = {
            r["split"]: r["n"]
            for r in entries.groupBy("split").agg(F.sum("tokens").alias("n")).collect()
        }
        name = f"manifest.{options.tag}.json" if options.tag else "manifest.json"
        counts = {"train": totals.get("train", 0), "val": totals.get("val", 0), "skipped": skipped}
        header = _header(options, vocabulary, tokenizer_sha256, counts, source)
        return write_manifest(f"{out}/{name}", header, entries, may_be_empty=before is not None)


def sliced_documents(
    spark: SparkSession, files: DataFrame, slices: int, field: str = "text", ord_col: str = ORD
) -> DataFrame:
    """Documents with ``part`` = ``s00``, ``s01``, ...: the run of sorted files they come from."""
    tagged = file_slices(files, slices).select(
        known_by("path").alias("_key"), F.format_string("s%02d", "slice").alias("part")
    )
    paths = [r["path"] for r in files.select("path").orderBy("path").collect()]
    rows = spark.read.parquet(*paths).select(
        F.col(ord_col).alias(ORD), F.col(field).alias("text"), known_by("_metadata.file_path").alias("_key")
    )
    return by_key(rows, materialize(tagged, "file-parts"))


def part_stops(
    docs: DataFrame, ids: DataFrame, vocabulary: Vocabulary, o: DocumentPack, by: list[str]
) -> DataFrame:
    """``by`` and ``_upto``: the last row a part can need, from row counts and byte lengths alone."""
    upto = ids.select(*by).distinct().withColumn("_upto", F.lit(None).cast("bigint"))
    if o.max_docs is not None:
        last = first_crossings(ids, ORD, {"rows": (F.lit(1), o.max_docs)}, by)
        upto = upto.drop("_upto").join(last.select(*by, F.col("rows_at").alias("_upto")), by, "left")
    if o.max_tokens is not None and (o.val_tokens is None or o.val_tokens > o.seq_len):
        floor = materialize(least_tokens(docs, vocabulary, by), "least-tokens")
        cuts = budget.token_cuts(
            floor, ORD, max_tokens=o.max_tokens, val_tokens=o.val_tokens, seq_len=o.seq_len, by=by
        )
        # The stop must lie in the rows that are read at all; a later one changes nothing.
        upto = upto.join(cuts.select(*by, "stop"), by, "left").select(
            *by, F.least("_upto", "stop").alias("_upto")
        )
    return materialize(upto, "part-stops")


def pack_parts(
    docs: DataFrame,
    vocabulary: Vocabulary,
    tokenizer_sha256: str,
    out: str,
    options: DocumentPack = DocumentPack(),
) -> list[dict]:
    """Pack parts (column ``part``) side by side in the same jobs, one manifest each, for a merge.

    Every part has the whole of ``val_tokens`` and its share of ``max_tokens``. A part that holds
    most of the rows spreads over chunks like any other rows.
    """
    by = ["part"]
    with scratch(docs.sparkSession):
        ids = materialize(docs.select(*by, ORD), "document-ids")
        n_parts = ids.select(*by).distinct().count()
        share = options.max_tokens
        share = None if share is None else max(1, share // max(1, n_parts))
        stops = part_stops(docs, ids, vocabulary, replace(options, max_tokens=share), by)
        docs, read = (
            rows.join(F.broadcast(stops), by, "left")
            .where(F.col("_upto").isNull() | (F.col(ORD) <= F.col("_upto")))
            .drop("_upto")
            for rows in (docs, ids)
        )  # a row for each part, as there are manifests
        encoded = materialize(held_documents(docs, vocabulary, by), "encoded")
        narrow = encoded.select(*by, ORD, "split", "n_tokens")
        cuts = materialize(
            budget.token_cuts(
                narrow,
                ORD,
                max_tokens=share,
                val_tokens=options.val_tokens,
                seq_len=options.seq_len,
                by=by,
            ),
            "cuts",
        )
        seen = budget.apply_cuts(read, cuts, ORD, by, keep_capped=True).groupBy(*by).count()
        passed = budget.apply_cuts(narrow, cuts, ORD, by, keep_capped=True).groupBy(*by).count()
        kept = budget.apply_cuts(narrow, cuts, ORD, by)
        keys = (*by, "split")
        where = roll_shards(kept, ORD, options.shard_tokens, keys)
        wide = budget.apply_cuts(encoded.drop("n_tokens"), cuts, ORD, by)
        placed = assign_shards(wide, where, ORD, keys)
        entries = materialize(shard_entries(placed, "", out, by_part=True), "entries")
        rows = {r["part"]: r["count"] for r in seen.collect()}
        good = {r["part"]: r["count"] for r in passed.collect()}
        totals: dict[str, dict] = {}
        for r in entries.groupBy(*by, "split").agg(F.sum("tokens").alias("n")).collect():
            totals.setdefault(r["part"], {"train": 0, "val": 0})[r["split"]] = r["n"]
        written = []
        for part in sorted(rows):
            counts = {**totals.get(part, {"train": 0, "val": 0}), "skipped": rows[part] - good.get(part, 0)}
            header = _header(options, vocabulary, tokenizer_sha256, counts, {"part": part})
            mine = entries.where(F.col("part") == part)
            written.append(write_manifest(f"{out}/manifest.{part}.json", header, mine))
        return written


def _header(options, vocabulary, tokenizer_sha256, counts, source) -> dict:
    return {
        "version": 1,
        "kind": "pretrain",
        "seq_len": options.seq_len,
        "vocab_size": len(vocabulary),
        "tokenizer_sha256": tokenizer_sha256,
        "counts": counts,
        "source": {**asdict(options), **(source or {})},
    }
