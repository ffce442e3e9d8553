"""Binary token shards: 16-bit little-endian ids, one byte of loss mask per id for chat data."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.session import ship_package
from tokenloom.sources import files
from tokenloom.sources.documents import list_files

VALUES_AT_ONCE = 1 << 20  # tokens of the blocks that leave a task in one batch

ENTRY_SCHEMA = (
    "split string, shard bigint, file string, tokens bigint, sha256 string, "
    "mask string, mask_sha256 string"
)


def _flat(column: pa.ChunkedArray, order: pa.Array, dtype: str) -> bytes:
    values = pc.list_flatten(column.take(order))
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.to_numpy(zero_copy_only=False).astype(dtype).tobytes()


def _coded(column: pa.ChunkedArray, order: pa.Array) -> bytes:
    """Ids of the byte tokenizer of each text, with the end mark after each, as ``_flat`` gives them."""
    table = np.array(text.byte_symbol_ids(), "<u2")
    parts = []
    for texts in column.take(order).chunks:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        parts.append(np.insert(table[data], offsets[1:] - offsets[0], text.EOS).tobytes())
    return b"".join(parts)


def _put(root: str, name: str, content: bytes) -> None:
    """Write under a private name, then rename: a retried or duplicate task leaves no half file."""
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(content)
    fs.move(draft, f"{base}/{name}")


def shard_entries(
    placed: DataFrame,
    prefix: str = "",
    out: str | None = None,
    with_mask: bool = False,
    by_part: bool = False,
) -> DataFrame:
    """One manifest entry per shard; with ``out``, also writes the shard files there.

    ``placed`` has ``split``, ``shard``, ``offset``, ``tokens`` (and ``mask``), or in place of tokens
    ``body``, texts of the byte tokenizer that become ids here. A task holds one shard, which the
    shard limit bounds. ``out`` is a URI that every executor can reach. With ``by_part`` a column
    ``part`` keeps parts apart and names their files.
    """
    ship_package(placed.sparkSession)
    if out is not None:
        out = files.uri(out)
    keys = [*(["part"] if by_part else []), "split", "shard"]
    raw = "tokens" not in placed.columns

    def entry(key, table):
        named = dict(zip(keys, (k.as_py() for k in key)))
        order = pc.sort_indices(table["offset"])
        content = _coded(table["body"], order) if raw else _flat(table["tokens"], order, "<u2")
        part = f"{named['part']}-" if by_part else ""
        stem = f"{prefix}{part}{named['split']}-{named['shard']:05d}"
        row = {
            **named,
            "file": f"{stem}.bin",
            "tokens": len(content) // 2,
            "sha256": hashlib.sha256(content).hexdigest(),
            "mask": None,
            "mask_sha256": None,
        }
        if out is not None:
            _put(out, row["file"], content)
        if with_mask:
            mask = _flat(table["mask"], order, "u1")
            row["mask"] = f"{stem}.mask"
            row["mask_sha256"] = hashlib.sha256(mask).hexdigest()
            if out is not None:
                _put(out, row["mask"], mask)
        return pa.Table.from_pylist([row], schema=pa.schema([*named_fields, *_ARROW_ENTRY]))

    named_fields = [(k, pa.int64() if k == "shard" else pa.string()) for k in keys]
    schema = ("part string, " if by_part else "") + ENTRY_SCHEMA
    columns = [*keys, "offset", "body" if raw else "tokens", *(["mask"] if with_mask else [])]
    return placed.select(*columns).groupBy(*keys).applyInArrow(entry, schema)


_ARROW_ENTRY = list(
    pa.schema([
        ("file", pa.string()),
        ("tokens", pa.int64()),
        ("sha256", pa.string()),
        ("mask", pa.string()),
        ("mask_sha256", pa.string()),
    ])
)


def shard_files(spark: SparkSession, root: str) -> DataFrame:
    """``file``, ``bytes`` of shards and masks; names and sizes only."""
    return list_files(spark, root, "*.{bin,mask}").select("file", "bytes")


def listed_files(entries: DataFrame) -> DataFrame:
    """``file``: every shard and mask the entries name."""
    masks = entries.where("mask is not null").select(F.col("mask").alias("file"))
    return entries.select("file").unionByName(masks)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Listing rows over as many tasks as there are rows, four for each core at most.

    The rows are small and what they name is large, so the count is stated: by bytes Spark would
    put them all into one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(rows.count(), 4 * cores)), key)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of ints."""
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.astype(np.int32).reshape(-1)))


def shard_hashes(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """``file``, ``sha256`` of the shards and masks that ``entries`` lists; no other file is read.

    A listed file that is absent has no row.
    """
    ship_package(spark)
    root = files.uri(root)

    def hashed(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            names, digests = [], []
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    continue
                digest = hashlib.sha256()
                with fs.open_input_stream(f"{base}/{name}") as source:
                    while piece := source.read(1 << 22):
                        digest.update(piece)
                names.append(name)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["file", "sha256"])

    return dealt(listed_files(entries), "file").mapInArrow(hashed, "file string, sha256 string")


def read_blocks(root: str, entries: DataFrame, seq_len: int, kind: str = "pretrain") -> DataFrame:
    """``split``, ``shard``, ``block``, ``tokens``, ``mask``, ``block_index`` from binary shards.

    ``entries`` has ``first_block``, the index of a shard's first block in its split. Only the entries travel: tasks share them out and open the files they name, so no shard content
    is shuffled, and blocks leave a task in small batches.
    """
    ship_package(entries.sparkSession)
    root = files.uri(root)
    width = seq_len + 1
    stride = width if kind == "sft" else seq_len

    most = max(1, VALUES_AT_ONCE // width)

    def blocks(batches):
        fs, base = pafs.FileSystem.from_uri(root)

        def load(name: str, dtype: str) -> np.ndarray:
            with fs.open_input_stream(f"{base}/{name}") as source:
                return np.frombuffer(source.read(), dtype=dtype)

        for batch in batches:
            for row in batch.to_pylist():
                flat = load(row["file"], "<u2")
                n = len(flat) // width if kind == "sft" else max(0, (len(flat) - 1) // seq_len)
                marks = load(row["mask"], "u1") if kind == "sft" else None
                for first in range(0, n, most):
                    index = np.arange(first, min(n, first + most))
                    at = index[:, None] * stride + np.arange(width)
                    mask = pa.nulls(len(index), pa.list_(pa.int32())) if marks is None else _lists(marks[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["split"]] * len(index), pa.string()),
                            pa.array(np.full(len(index), row["shard"], np.int64)),
                            pa.array(index),
                            _lists(flat[at]),
                            mask,
                            pa.array(index + row["first_block"]),
                        ],
                        ["split", "shard", "block", "tokens", "mask", "block_index"],
                    )

    schema = (
        "split string, shard bigint, block bigint, tokens array<int>, mask array<int>, block_index bigint"
    )
    columns = ["split", "shard", "file", "mask", "first_block"]
    return dealt(entries.select(*columns), "file").mapInArrow(blocks, schema)


def read_wanted(root: str, wanted: DataFrame, seq_len: int, kind: str = "pretrain") -> DataFrame:
    """``wanted`` (``file``, ``mask``, ``block`` and what else a request carries) with ``tokens`` and
    ``mask`` of the block.

    Requests are small and are sorted by file and block, so a task opens each shard of its own once
    and reads the asked ranges in order, ids and mask of a range side by side; sizes must agree. A
    block that is asked for twice in a row is read once. The number of tasks is stated, as in
    :func:`dealt`, and blocks leave a task in small batches, however many requests come at once.
    """
    ship_package(wanted.sparkSession)
    root = files.uri(root)
    width = seq_len + 1
    stride = width if kind == "sft" else seq_len
    carried = [f for f in wanted.schema.fields if f.name not in ("file", "mask", "block")]
    most = max(1, VALUES_AT_ONCE // width)

    def small(batches):
        return (b.slice(at, most) for b in batches for at in range(0, len(b), most))

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        name, ids, marks, last, row = None, None, None, None, None

        def opened(file, size):
            source = fs.open_input_file(f"{base}/{file}")
            if source.size() % size:
                raise ValueError(f"{file} ends within a token")
            return source

        def part(source, block, dtype):
            size = np.dtype(dtype).itemsize
            source.seek(block * stride * size)
            found = np.frombuffer(source.read(width * size), dtype)
            if len(found) != width:
                raise ValueError(f"{name} has no whole block {block}")
            return found

        for batch in small(batches):
            tokens = np.empty((len(batch), width), "<u2")
            masks = np.empty((len(batch), width), "u1") if kind == "sft" else None
            for i, (file, mask, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "mask", "block")))):
                if file != name:
                    name, last = file, None
                    ids, marks = opened(file, 2), opened(mask, 1) if kind == "sft" else None
                    if marks is not None and 2 * marks.size() != ids.size():
                        raise ValueError(f"{file} and its mask differ in length")
                if block != last:
                    row = part(ids, block, "<u2"), None if marks is None else part(marks, block, "u1")
                    last = block
                tokens[i] = row[0]
                if marks is not None:
                    masks[i] = row[1]
            columns = [batch.column(f.name) for f in carried]
            columns += [_lists(tokens), pa.nulls(len(batch), pa.list_(pa.int32())) if masks is None else _lists(masks)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in carried), "tokens", "mask"])

    tasks = 4 * wanted.sparkSession.sparkContext.defaultParallelism
    names = [f.name for f in carried]
    asked = wanted.select(*names, "file", "mask", "block").repartition(tasks, "file").sortWithinPartitions("file", "block")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return asked.mapInArrow(read, f"{schema}, tokens array<int>, mask array<int>")
