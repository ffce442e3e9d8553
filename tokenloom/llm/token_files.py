"""Operator 13: token ids written to compressed binary files, and read back.

Texts are range-sorted by id, split into words by columns (:mod:`tokenloom.llm.byte_words`), and encoded
with the public library's tokenizer, which sees every distinct word of a task once. A task writes one
file of segments; a segment holds whole documents and stands for itself, so a reader takes segments
in any order:

    header   magic, version, id bound, ids per block, documents, blocks, ids, table bytes, CRC-32
    table    document ids and token counts, deflated
    blocks   per block the number of 16-bit words and the CRC-32 of its ids (32 bits, little-endian)
    words    of all blocks, one after the other

Blocks are coded by :mod:`tokenloom.llm.rangecoder`, each on its own and with a model of its own. Every sum is checked on reading.
Files get their final name when they are complete, and the list of segments (``entries``, a table)
is written last; a lost task writes the same file again.

Defined results: a null or empty text has the end id only; white space is text. Special strings inside
a text count as the library's default does, as their special id. Rows with one id follow each other by the hash of
their text; rows without an id come first. An empty table gives no files, and an empty result. Texts are never
cut; a segment grows to hold a very long one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import byte_words, rangecoder
from tokenloom.llm.common import release
from tokenloom.operators.running import running_totals
from tokenloom.operators.wordcodes import WordCodes, flattened, some_rows
from tokenloom.sources import files

MAGIC, VERSION = b"TLID", 2
HEADER = struct.Struct("<4sHxxIIIIQI")
SEGMENT_IDS = 1 << 23  # a segment is closed once it holds as many
BLOCK_IDS = 1 << 22  # a larger segment has several blocks
TEXT_PER_TASK = 16 << 20  # bytes
TEXT_TOGETHER = 16 << 20  # bytes whose words are numbered at once
NEW_TOGETHER = 1 << 8  # new words that the library is given as one text
OUT_IDS = 1 << 20  # of a batch that a reader hands on, or one document
ENTRIES = "part int, seq int, file string, begin long, size long, docs long, n_ids long"


# --- segments -----------------------------------------------------------------------------------


def segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bound: int) -> bytes:
    """One segment of whole documents; ``ids`` has those of all documents, end to end."""
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    words = rangecoder.encode(blocks, bound)
    sums = [zlib.crc32(b.astype("<u4")) for b in blocks]
    known = np.array([i is not None for i in doc_ids], np.uint8)
    named = np.array([i or 0 for i in doc_ids], "<i8")
    table = zlib.compress(known.tobytes() + named.tobytes() + sizes.astype("<i8").tobytes())
    facts = np.array([[len(w) for w in words], sums], "<u4").tobytes() if blocks else b""
    head = HEADER.pack(MAGIC, VERSION, bound, BLOCK_IDS, len(doc_ids), len(blocks), len(ids), len(table))
    front = head + table + facts
    return front + struct.pack("<I", zlib.crc32(front)) + b"".join(w.tobytes() for w in words)


def parse(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, sizes and token ids of a segment; an error where any sum differs."""
    magic, version, bound, block, docs, n_blocks, n_ids, deflated = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("Not a token segment of this version")
    at = HEADER.size + deflated
    end = at + 8 * n_blocks
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("A token segment's header or table is damaged")
    table = zlib.decompress(data[HEADER.size : at])
    known = np.frombuffer(table, np.uint8, docs)
    named, sizes = np.frombuffer(table, "<i8", 2 * docs, docs).reshape(2, docs)
    lengths, sums = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(2, n_blocks).astype(np.int64)
    ends = np.cumsum(lengths)
    words = np.frombuffer(data, "<u2", int(lengths.sum()), end + 4)
    counts = [min(block, n_ids - i * block) for i in range(n_blocks)]
    given = [words[e - n : e] for e, n in zip(ends, lengths)]
    out = [np.zeros(0, np.int32), *rangecoder.decode(given, counts, bound)]
    for ids, crc in zip(out[1:], sums):
        if zlib.crc32(np.ascontiguousarray(ids).astype("<u4")) != crc:
            raise ValueError("A block of token ids is damaged")
    return [int(i) if k else None for i, k in zip(named, known)], sizes, np.concatenate(out)


# --- words and tokens ---------------------------------------------------------------------------


@lru_cache(maxsize=4)
def settings(path: str) -> tuple[list[str], int]:
    """Special strings of a byte-level vocabulary file, and a bound on its ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, added = spec["pre_tokenizer"], spec["added_tokens"]
    plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    if not plain or spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: a vocabulary file of another kind")
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in added)]
    return [t["content"] for t in added], max(ids) + 1


@lru_cache(maxsize=1)
def classes() -> byte_words.Classes:
    """A worker's classes of characters."""
    return byte_words.Classes()


def _split(batches: Iterator[pa.RecordBatch], specials: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of ids and texts as smaller ones of ids and words."""
    for batch in batches:
        for rows in byte_words.pieces(batch.column(1)):
            ids, texts = (c.slice(rows.start, rows.stop - rows.start) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([ids, byte_words.split(texts, specials, classes())], ["doc_id", "words"])


@lru_cache(maxsize=4)
def word_codes(path: str) -> WordCodes:
    """A worker's dictionary of words; new ones are encoded by the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def spell(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if mark is None or not added.isdisjoint(new):
            return flattened([e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)])
        # One text of many words: what lies between special strings is encoded by itself.
        texts = [mark.join(new[i : i + NEW_TOGETHER]) + mark for i in range(0, len(new), NEW_TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == added_ids[mark])
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    # A mark that cannot arise across its ends with what stands beside it, and that no other one holds.
    added_ids = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    added = set(added_ids)
    mark = next((m for m in added if len(added) == 1 and not any(m.endswith(m[:k]) for k in range(1, len(m)))), None)
    return WordCodes(spell)


# --- files --------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, row_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, in order of ``row_id``."""
    spark = docs.sparkSession
    specials, bound = settings(vocabulary)
    if not 0 <= end_id or max(bound, end_id + 1) > rangecoder.MOST_IDS:
        raise ValueError(f"ids must be below {rangecoder.MOST_IDS}")
    bound = max(bound, end_id + 1)
    folder = files.uri(path)
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, size // TEXT_PER_TASK + 1)
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    laid = keyed.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    whole = laid.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, entries, out, begin = f"part-{part:06d}.ids", [], None, 0
        fs, base = pafs.FileSystem.from_uri(folder)
        draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        for doc_ids, sizes, ids in _segments(_split(batches, specials), vocabulary, end_id):
            data = segment(doc_ids, sizes, ids, bound)
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(draft)
            out.write(data)
            entries.append((part, len(entries), name, begin, len(data), len(doc_ids), len(ids)))
            begin += len(data)
            release()
        if out is not None:
            out.close()
            fs.move(draft, f"{base}/{name}")
            kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 4
            columns = [pa.array(c, k) for c, k in zip(zip(*entries), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "file", "begin", "size", "docs", "n_ids"])

    whole.mapInArrow(store, ENTRIES).write.mode("errorifexists").parquet(f"{path}/entries")


def _segments(
    batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int
) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents gathered until they have ``SEGMENT_IDS`` ids."""
    codes = word_codes(vocabulary)
    named, sizes, ids, n = [], [], [], 0
    for docs, lists in _together(batches):
        found, bounds = codes.texts(lists)
        size = np.diff(bounds) + 1
        whole = np.full(len(found) + len(size), end_id, np.int32)
        end = np.zeros(len(whole), bool)
        end[np.cumsum(size) - 1] = True
        whole[~end] = found
        named += docs
        sizes.append(size)
        ids.append(whole)
        n += len(whole)
        if n >= SEGMENT_IDS:
            yield named, np.concatenate(sizes), np.concatenate(ids)
            named, sizes, ids, n = [], [], [], 0
    if named:
        yield named, np.concatenate(sizes), np.concatenate(ids)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Batches gathered until they have ``TEXT_TOGETHER`` bytes, or words for a segment: the more
    words are numbered at once, the fewer are looked up."""
    docs, lists, size, words = [], [], 0, 0
    for batch in batches:
        at = 0
        for piece in some_rows(batch.column(1)):
            docs += batch.column(0).slice(at, len(piece)).to_pylist()
            lists.append(piece)
            at += len(piece)
            found = piece.flatten()
            words += len(found)
            size += pc.sum(pc.binary_length(found)).as_py() or 0
            if size >= TEXT_TOGETHER or words >= SEGMENT_IDS:
                yield docs, pa.concat_arrays(lists)
                docs, lists, size, words = [], [], 0, 0
    if docs:
        yield docs, pa.concat_arrays(lists)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document: where its ids begin among those of all,
    how many they are, and the ids as little-endian unsigned 32-bit integers."""
    folder = files.uri(path)
    entries = spark.read.schema(ENTRIES).parquet(f"{path}/entries")
    entries = entries.withColumn("ord", F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq"))
    placed = running_totals(entries, "ord", {"upto": "n_ids"})
    tasks = placed.select("file", "begin", "size", (F.col("upto") - F.col("n_ids")).alias("start"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, begin, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{base}/{name}") as source:
                    source.seek(begin)
                    named, sizes, ids = parse(source.read(size))
                yield from _documents(named, sizes, ids, start)
                release()

    cores = spark.sparkContext.defaultParallelism
    dealt = tasks.repartition(max(1, min(tasks.count(), 4 * cores)))  # rows are small, what they name is large
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def _documents(named: list[int | None], sizes: np.ndarray, ids: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(named):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + OUT_IDS, "right")) - 1)
        raw = ids[bounds[at] : bounds[end]].astype("<u4")
        offsets = (4 * (bounds[at : end + 1] - bounds[at])).astype(np.int32)
        binary = pa.BinaryArray.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        columns = [
            pa.array(named[at:end], pa.int64()),
            pa.array(start + bounds[at:end]),
            pa.array(sizes[at:end].astype(np.int64)),
            binary,
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
        at = end
