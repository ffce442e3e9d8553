"""Operator 3: SimHash near-dedup by multi-index hashing.

A fingerprint bit is set if more than half of a text's shingle hashes have it. Fingerprints are cut
into segments, few enough that two within the limit differ by at most one bit in some segment. Every
distinct fingerprint is entered in a table under each of its segments; a search enumerates the small
Hamming ball around each segment, looks the values up and verifies the complete distance. Repeated
fingerprints are one row with the smallest id, so copies are never paired.

Defined results: null and empty texts and texts of white space have no shingle and the fingerprint
zero, which links like any other. Texts with fewer words than a shingle have one, the whole. Rows
that repeat an id are fingerprinted each for itself. A null id is never a component's name; a
component without any id has the name null. An empty table gives an empty one. Other columns pass
through ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import (
    join_checked,
    materialize,
)
from tokenloom.llm.components import components

BITS = 64
PIECE = 50_000  # shingles of one text held at once


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned fingerprint of one whole text. ``bytes.lower`` and ``bytes.split`` touch A-Z and the
    six ASCII white-space characters only."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        shingles = [b" ".join(tokens[i : i + words]) for i in range(at, min(n, at + PIECE))]
        hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id, fp`` with the 64 bits as a long."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        raw = column.cast(pa.binary()).to_pylist()
        return pa.array(np.array([fingerprint(t, words) for t in raw], np.uint64).view(np.int64))

    return docs.select(F.col(row_id), of(F.col(text)).alias("fp"))


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: pairs of the fingerprints in ``distinct.fp`` at most ``max_bits`` apart, each once."""
    segments = max_bits // 2 + 1
    edges = [BITS * i // segments for i in range(segments + 1)]

    def keys(ball: bool) -> DataFrame:
        rows = []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            width = hi - lo
            part = F.shiftrightunsigned("fp", lo)
            part = part.bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else part
            flips = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(width))] if ball else [0]
            rows += [F.struct(F.lit(i).alias("segment"), part.bitwiseXOR(F.lit(f).cast("long")).alias("value")) for f in flips]
        out = distinct.select("fp", F.explode(F.array(*rows)).alias("k"))
        if segments > 1 and BITS // segments < 48:  # segment number and value in one word
            key = F.shiftleft(F.col("k.segment").cast("long"), 48).bitwiseOR(F.col("k.value"))
            return out.select("fp", key.alias("key"))
        return out.select("fp", F.col("k").alias("key"))

    table = keys(ball=False).withColumnRenamed("fp", "b")
    probe = keys(ball=True).withColumnRenamed("fp", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probe.join(table, (probe["key"] == table["key"]) & (F.col("a") < F.col("b")) & near).select(
        "a", "b"
    ).distinct()


def groups(docs: DataFrame, words: int = 3, max_bits: int = 2, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id, fp, component_id``: the smallest id reachable over links, the row's own included."""
    marked = materialize(fingerprints(docs, words, text, row_id), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(row_id).alias("first")), "distinct-fingerprints")
    names = distinct.select("fp", F.col("first").alias("id"))
    pairs = links(distinct, max_bits)
    edges = pairs.join(names.toDF("a", "ia"), "a").join(names.toDF("b", "ib"), "b")
    edges = edges.select(F.col("ia").alias("a"), F.col("ib").alias("b")).where("a is not null and b is not null")
    reach = components(edges).toDF("first", "component")
    named = distinct.join(reach, "first", "left").select(
        "fp", F.coalesce("component", "first").alias("component_id")
    )
    return join_checked(marked, materialize(named, "fingerprint-groups"), "fp").select(
        row_id, "fp", "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 2, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id.

    A document whose id repeats stays, with all its rows, if one of its texts has no smaller id in
    its group; so no group is left without a document. Rows without an id stay.
    """
    found = groups(docs.select(row_id, text), words, max_bits, text, row_id)
    first = F.bool_or(F.col(row_id) == F.col("component_id")).alias("first")
    gone = found.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("_gone")).agg(first)
    gone = materialize(gone.where(~F.col("first")).select("_gone"), "texts-to-drop")
    return join_checked(docs.withColumn("_gone", F.col(row_id)), gone, "_gone", "left_anti").drop("_gone")
