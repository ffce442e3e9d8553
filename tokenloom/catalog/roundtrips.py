"""Named queries that write a corpus to the shared folder and read it back, and streamed intake."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.chats import joined, turns
from tokenloom.catalog.documents import documents
from tokenloom.catalog.registry import query
from tokenloom.functions.schedule import Schedule
from tokenloom.operators.blocks import training_pair
from tokenloom.operators.order import EpochOrder, ReaderState
from tokenloom.operators.running import running_totals
from tokenloom.operators.vocab import Vocabulary
from tokenloom.plans import batches
from tokenloom.plans.chats import ChatPack, chat_rows, pack_conversations
from tokenloom.plans.documents import DocumentPack, pack_documents
from tokenloom.session import durable_dir, materialize
from tokenloom.sources import corpus, manifests, tokenizer_file
from tokenloom.sources import documents as intake_files
from tokenloom.streaming import intake

_NAME = "split || '-' || lpad(shard::VARCHAR, 5, '0') || '.bin'"
_ROLLED = f"WITH RECURSIVE {q.DOCS}, {q.rolled('doc', 'split', q.SHARD_LIMIT)}"
_FLAT = f"""{_ROLLED}, flat AS (
  SELECT split, shard, flatten(list(list_concat({q.byte_ids(q.neutral('text'))}, [1])
         ORDER BY doc_id)) AS ids FROM placed GROUP BY split, shard)"""
_FILES = f"""{_FLAT} SELECT PREFIX{_NAME} AS file, len(ids)::BIGINT AS tokens,
  sha256(unhex(array_to_string(list_transform(ids,
    lambda i: printf('%02X%02X', i % 256, i // 256)), ''))) AS sha256 FROM flat"""
_OPTIONS = DocumentPack(seq_len=q.SEQ_LEN, shard_tokens=q.SHARD_LIMIT)


def new_folder(spark, name: str) -> str:
    return f"{durable_dir(spark)}/tokenloom/{name}-{uuid.uuid4().hex}"


def packed(spark, sf_dir, rows="true"):
    """A corpus of all documents in byte tokens, and its tokenizer, in new folders."""
    folder, tokenizer = new_folder(spark, "corpus"), new_folder(spark, "tokenizer")
    learned = Vocabulary.of_bytes()
    digest = tokenizer_file.save(learned, tokenizer)
    pack_documents(documents(spark, sf_dir, "lang").where(rows), learned, digest, folder, _OPTIONS)
    return folder, tokenizer


@query(
    f"""{_FLAT} SELECT split, shard, block, sha256({q.joined(
        f'ids[block * {q.SEQ_LEN} + 1 : block * {q.SEQ_LEN} + {q.SEQ_LEN + 1}]')}) AS tokens
    FROM (SELECT *, unnest(range(greatest(0, (len(ids) - 1) // {q.SEQ_LEN}))) AS block FROM flat)"""
)
def shard_round_trip(spark, sf_dir):
    """All blocks of a packed corpus, read back from its shards after their hashes are checked."""
    folder, _ = packed(spark, sf_dir)
    opened = [corpus.open_corpus(spark, folder, s, q.SEQ_LEN).blocks for s in ("train", "val")]
    return opened[0].unionByName(opened[1]).select(
        "split", "shard", "block", F.sha2(joined(F.col("tokens")), 256).alias("tokens")
    )


@query(_FILES.replace("PREFIX", ""))
def bundle_round_trip(spark, sf_dir):
    """What a published and checked bundle lists."""
    folder, tokenizer = packed(spark, sf_dir)
    bundle = corpus.publish(spark, folder, tokenizer, new_folder(spark, "bundles"), "all-documents")
    entries = corpus.manifest_entries(spark, f"{corpus.verify_bundle(spark, bundle)}/data")
    return entries.select("file", "tokens", "sha256")


RAW_FILES, RAW_SLICES = 5, 3  # JSON-lines files of a split, and the jobs that share them


@query(
    f"""WITH raw AS (
      SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split,
        doc_id // 10 % {RAW_FILES} AS file FROM documents),
    sliced AS (SELECT *, (((file + 1) * {RAW_SLICES} - 1) // {RAW_FILES})::INT AS slice FROM raw)
    SELECT split, slice, row_number() OVER (PARTITION BY split, slice ORDER BY file, doc_id) AS nth,
      sha256(text) AS sha256 FROM sliced"""
)
def raw_lines_order(spark, sf_dir):
    """Documents as JSON lines in a folder for each split, found by the folder's name, dealt to jobs
    by file, and read back in the order of files and lines."""
    root = new_folder(spark, "raw")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    is_val = F.col("doc_id") % 10 == 0
    file = F.expr(f"cast(doc_id div 10 % {RAW_FILES} as int)")
    for split, mine in (("train", ~is_val), ("val", is_val)):
        lines = docs.where(mine).repartitionById(RAW_FILES, file).sortWithinPartitions("doc_id")
        lines.select("text").write.json(f"{root}/x_{split}")
    files = intake_files.list_files(spark, root, "*.json")
    read = []
    for split in ("train", "val"):
        mine = files.where(F.col("dir") == intake_files.resolve_directory(files, split))
        for i in range(RAW_SLICES):
            paths = intake_files.select_files(mine, i, RAW_SLICES)
            rows = intake_files.read_ordered(spark, paths, "text", "place", "json")
            read.append(
                rows.select(F.lit(split).alias("split"), F.lit(i).alias("slice"), "place", F.sha2("text", 256).alias("sha256"))
            )
    hashed = materialize(reduce(DataFrame.unionByName, read), "raw-lines")
    placed = running_totals(hashed, "place", {"nth": F.lit(1)}, ["split", "slice"])
    return placed.select("split", "slice", "nth", "sha256")


def _table(sf_dir):
    """A stream reads folders or patterns; the table may be one file, and then a pattern names it."""
    return f"{sf_dir}/documents.parque[t]"


def _source(spark, sf_dir, *columns):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return spark.readStream.schema(schema).parquet(_table(sf_dir)).select(*columns)


@query(f"WITH {q.DOCS} SELECT doc_id, split FROM doc")
def stream_split(spark, sf_dir):
    """Streamed documents that pass the length filter, with their split."""
    out = new_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = intake.stream_documents(spark, _table(sf_dir), schema)
    intake.write_parts(rows.select("doc_id", "split"), out, f"{out}-log").awaitTermination()
    return spark.read.parquet(out).select("doc_id", "split")


ARRIVALS = 6  # files come in so many turns, each a micro-batch
_ARRIVAL = f"(doc_id * {ARRIVALS}) // (SELECT max(doc_id) + 1 FROM documents)"


def _arriving(spark, sf_dir, start) -> None:
    """Documents come in by order, a share at a time; ``start(folder)`` runs the stream on what is new."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    most = docs.agg(F.max("doc_id")).first()[0]
    folder = new_folder(spark, "arrivals")
    for i in range(ARRIVALS):
        turn = F.expr(f"(doc_id * {ARRIVALS}) div {most + 1}")
        docs.where(turn == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(docs.schema).parquet(folder)).awaitTermination()


@query(
    """SELECT doc_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1"""
)
def stream_first_wins(spark, sf_dir):
    """First document of each source and language over all micro-batches."""
    out = new_folder(spark, "stream")

    def start(rows):
        keyed = rows.select("doc_id", F.concat_ws(" ", "source", "lang").alias("prompt"))
        return intake.first_prompts(keyed, out, f"{out}-log", "doc_id")

    _arriving(spark, sf_dir, start)
    return spark.read.parquet(out).select("doc_id")


_STREAM_TOKENS, _STREAM_VAL = 1_200_000, 14_000
_STREAM_BUDGET = q.BUDGET.replace(f">= {q.MAX_TOKENS}", f">= {_STREAM_TOKENS}").replace(
    f"< {q.VAL_TOKENS}", f"< {_STREAM_VAL}"
)


@query(
    f"""WITH RECURSIVE {_STREAM_BUDGET}, parts AS (
      SELECT *, printf('b%06d-', {_ARRIVAL}) || split AS place FROM budget),
    {q.rolled('parts', 'place', q.SHARD_LIMIT)}, flat AS (
      SELECT place, shard, flatten(list(list_concat({q.byte_ids(q.neutral('text'))}, [1]) ORDER BY doc_id)) AS ids
      FROM placed GROUP BY place, shard)
    SELECT place || '-' || lpad(shard::VARCHAR, 5, '0') || '.bin' AS file, len(ids)::BIGINT AS tokens,
      sha256(unhex(array_to_string(list_transform(ids, lambda i: printf('%02X%02X', i % 256, i // 256)), ''))) AS sha256
    FROM flat"""
)
def stream_budget_parts(spark, sf_dir):
    """One token budget over all micro-batches: its parts, merged, hold what one cut would keep."""
    out = new_folder(spark, "parts")
    options = replace(_OPTIONS, max_tokens=_STREAM_TOKENS, val_tokens=_STREAM_VAL)

    def start(rows):
        rows = rows.select("doc_id", "text")
        return intake.pack_stream(rows, Vocabulary.of_bytes(), "bytes", out, f"{out}-log", options)

    _arriving(spark, sf_dir, start)
    manifests.merge_parts(spark, out)
    return corpus.manifest_entries(spark, out).select("file", "tokens", "sha256")


@query(_FILES.replace("PREFIX", "'b000000-' || "))
def stream_parts(spark, sf_dir):
    """Streamed documents packed to one part per micro-batch, and the parts merged."""
    out = new_folder(spark, "parts")
    rows = _source(spark, sf_dir, "doc_id", "text")
    intake.pack_stream(rows, Vocabulary.of_bytes(), "bytes", out, f"{out}-log", _OPTIONS).awaitTermination()
    manifests.merge_parts(spark, out)
    return corpus.manifest_entries(spark, out).select("file", "tokens", "sha256")


_PART_HEADS = q.HEADS.replace("PARTITION BY ", "PARTITION BY conv_id % 3, ")
_WIDTH = q.CHAT_SEQ_LEN + 1
_ROWS = -(-q.CHAT_SHARD_LIMIT // _WIDTH)


@query(
    f"""WITH {_PART_HEADS}, ranked AS (
      SELECT conv_id, split, 'p' || conv_id % 3 AS part,
             row_number() OVER (PARTITION BY conv_id % 3, split ORDER BY conv_id) - 1 AS nth
      FROM judged WHERE reason IS NULL)
    SELECT part, conv_id, split, (nth // {_ROWS})::BIGINT AS shard,
           (nth % {_ROWS} * {_WIDTH})::BIGINT AS "offset" FROM ranked"""
)
def chat_source_mix(spark, sf_dir):
    """Three chat sources, each deduplicated and placed in shards of its own, in the same jobs."""
    part = F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"))
    rows = turns(spark, sf_dir).withColumn("part", part)
    options = ChatPack(seq_len=q.CHAT_SEQ_LEN, shard_tokens=q.CHAT_SHARD_LIMIT)
    placed, _ = chat_rows(rows, Vocabulary.of_bytes(), options, by=("part",))
    return placed.select("part", "conv_id", "split", "shard", "offset")


# --- what a trainer reads ------------------------------------------------------------------------

_FACTOR, _SHIFT = 1_000_003, 12_345  # orders written out, so that SQL can follow them
_MICRO, _ACCUM, _DECAY_LANG = 2, 4, "en"
_BATCH_TOKENS = _MICRO * _ACCUM * q.SEQ_LEN


def _order(n, seed, epoch):
    factor = _FACTOR % n or 1
    while math.gcd(factor, n) != 1:
        factor += 1
    return EpochOrder(n, factor, (_SHIFT + epoch) % n)


# The first factor from the stated one on that has no divisor in common with the block count.
_FACTORS = f"""(SELECT min(f) FROM range({_FACTOR}, {_FACTOR} + 1000) r(f) WHERE gcd(f % n, n) = 1)"""


def _corpus(name: str, rows: str) -> str:
    """Blocks ``block_index, tokens`` of the train shards over some documents."""
    rolled = q.rolled(f"{name}_doc", "split", q.SHARD_LIMIT)
    for table in ("ranked", "ends", "roll", "placed"):
        rolled = re.sub(rf"\b{table}\b", f"{name}_{table}", rolled)
    return f"""{name}_doc AS (SELECT * FROM doc WHERE split = 'train' AND {rows}), {rolled},
{name}_flat AS (
  SELECT shard, flatten(list(list_concat({q.byte_ids(q.neutral('text'))}, [1]) ORDER BY doc_id)) AS ids
  FROM {name}_placed GROUP BY shard),
{name}_cut AS (
  SELECT shard, unnest(range(greatest(0, (len(ids) - 1) // {q.SEQ_LEN}))) AS block, ids FROM {name}_flat),
{name}_blocks AS (
  SELECT row_number() OVER (ORDER BY shard, block) - 1 AS block_index, count(*) OVER () AS n,
         sha256({q.joined(f'ids[block * {q.SEQ_LEN} + 1 : block * {q.SEQ_LEN} + {q.SEQ_LEN}]')}) AS x,
         sha256({q.joined(f'ids[block * {q.SEQ_LEN} + 2 : block * {q.SEQ_LEN} + {q.SEQ_LEN + 1}]')}) AS y
  FROM {name}_cut)"""


def _hashed(rows, *columns):
    x, y = (F.sha2(joined(F.col(c)), 256).alias(c) for c in ("x", "y"))
    return rows.select(*columns, x, y)


@query(
    f"""WITH RECURSIVE {q.DOCS}, {_corpus("main", "true")}, {_corpus("decay", f"lang = '{_DECAY_LANG}'")},
    pool AS (SELECT 'main' AS source, * FROM main_blocks UNION ALL SELECT 'decay', * FROM decay_blocks),
    sizes AS (SELECT source, n, {_FACTORS} AS f FROM (SELECT DISTINCT source, n FROM pool)),
    t AS (SELECT sum(n_tokens)::BIGINT AS total FROM doc WHERE split = 'train'),
    slots AS (SELECT unnest(range(total // {_BATCH_TOKENS} * {_ACCUM})) AS slot, total FROM t),
    chosen AS (
      SELECT slot, CASE WHEN slot // {_ACCUM} * {_BATCH_TOKENS} >= total * 0.75::DOUBLE
             AND ('0x' || substr(sha256('{q.SEED}:' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5
             THEN 'decay' ELSE 'main' END AS source FROM slots),
    nth AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM chosen),
    asked AS (SELECT slot, source, j::INT AS "row", nth * {_MICRO} + j AS cur FROM nth, range({_MICRO}) r(j))
    SELECT slot, "row", a.source, (cur // s.n)::BIGINT AS epoch, x, y
    FROM asked a JOIN sizes s ON a.source = s.source
    JOIN pool p ON p.source = a.source AND p.block_index = (f * (cur % s.n) + {_SHIFT} + cur // s.n) % s.n"""
)
def training_batches(spark, sf_dir):
    """Microbatches of two corpora, each with the inputs and targets of its real block."""
    main, _ = packed(spark, sf_dir)
    decay, _ = packed(spark, sf_dir, f"lang = '{_DECAY_LANG}'")
    corpora = {n: corpus.open_corpus(spark, f, "train", q.SEQ_LEN) for n, f in (("main", main), ("decay", decay))}
    total = corpus.manifest_entries(spark, main).where("split = 'train'").agg(F.sum("tokens")).first()[0]
    schedule = Schedule(total_tokens=total, decay_fraction=0.25, decay_mix=0.5)
    rows = batches.training_batches(
        spark, corpora, schedule, q.SEQ_LEN, _MICRO, _ACCUM, q.SEED, drawn=_order
    )
    return _hashed(rows, "slot", "row", "source", "epoch")


_BATCH = 7


@query(
    f"""WITH RECURSIVE {q.DOCS}, {_corpus("main", "true")},
    size AS (SELECT n, {_FACTORS} AS f FROM (SELECT DISTINCT n FROM main_blocks)),
    asked AS (
      SELECT unnest(range(n - {_BATCH} - 3, n - {_BATCH} - 3 + 3 * {_BATCH})) AS cursor, n, f FROM size)
    SELECT cursor, ((cursor - (s.n - {_BATCH} - 3)) // {_BATCH})::INT AS turn, (cursor // s.n)::BIGINT AS epoch, x, y
    FROM asked s JOIN main_blocks b ON b.block_index = (f * (cursor % s.n) + {_SHIFT} + cursor // s.n) % s.n"""
)
def resume_epochs(spark, sf_dir):
    """Three batches from a saved cursor shortly before the end of an epoch, each resumed anew."""
    folder, _ = packed(spark, sf_dir)
    opened, states = corpus.open_corpus(spark, folder, "train", q.SEQ_LEN), new_folder(spark, "states")
    ReaderState(opened.n - _BATCH - 3, q.SEED, opened.fingerprint).save(spark, states)
    out = None
    for turn in range(3):
        state = ReaderState.saved(spark, states)
        rows, after = batches.resumed(opened, state, _BATCH, drawn=_order)
        after.save(spark, states)
        x, y = training_pair(F.col("tokens"))
        rows = rows.select("cursor", F.lit(turn).alias("turn"), "epoch", x.alias("x"), y.alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return _hashed(out, "cursor", "turn", "epoch")


@query(
    f"""WITH {q.EXAMPLES}, ranked AS (
      SELECT conv_id, split, row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS nth
      FROM judged WHERE reason IS NULL)
    SELECT split, (nth // {_ROWS})::BIGINT AS shard, (nth % {_ROWS})::BIGINT AS block,
           sha256({q.joined('ids')}) AS ids, sha256({q.joined('mask')}) AS mask
    FROM ranked JOIN padded USING (conv_id)"""
)
def chat_round_trip(spark, sf_dir):
    """Chat rows and their masks, packed to shards and read back side by side by block index."""
    folder, tokenizer = new_folder(spark, "chats"), new_folder(spark, "tokenizer")
    learned = Vocabulary.of_bytes()
    digest = tokenizer_file.save(learned, tokenizer)
    options = ChatPack(seq_len=q.CHAT_SEQ_LEN, shard_tokens=q.CHAT_SHARD_LIMIT)
    pack_conversations(turns(spark, sf_dir), learned, digest, folder, options, may_be_empty=True)
    filled = corpus.manifest_entries(spark, folder).select("split").distinct().orderBy("split").collect()
    out = None
    for (split,) in filled:
        opened = corpus.open_corpus(spark, folder, split, q.CHAT_SEQ_LEN, tokenizer=tokenizer)
        asked = opened.shards.select(
            "split", "shard", F.explode(F.sequence("first_block", F.col("end_block") - 1)).alias("block_index"), "first_block"
        ).select("split", F.col("shard").alias("of"), "block_index", (F.col("block_index") - F.col("first_block")).alias("at"))
        rows = opened.fetch(asked)
        out = rows if out is None else out.unionByName(rows)
    ids, mask = (F.sha2(joined(F.col(c)), 256) for c in ("tokens", "mask"))
    return out.select("split", F.col("of").alias("shard"), F.col("at").alias("block"), ids.alias("ids"), mask.alias("mask"))
