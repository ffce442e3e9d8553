"""Operator 7: substring dedup by prefix-partitioned suffix trees.

A passage repeats if a window of ``window`` words does. The suffixes of all texts, read to window
depth, are split into groups by a prefix, and a group is a subtree that one key holds; its nodes at
window depth or below that have several suffixes under them are the repeats.

Only suffixes at anchors get a group of their own: of the ``ANCHOR``-word prefixes inside a window
the one with the least hash. Windows that share words share the anchor, so a subtree is entered by
all its repeats, with about an eighth of the suffixes. Neighbouring windows with one anchor form a
span, a prefix of variable length (the window and as many words more as the anchor serves); equal
spans are one node. What is left are spans of one anchor that differ at an end, that is where repeats
begin and end: only these are read again and split into their windows. Prefixes with a single suffix
are leaves and go first. A group is only ever a minimum and a count, combined before each shuffle,
so a passage that a third of the texts share costs one row per task.

Paths in the trees are compared by hashes: two of 64 bits, from different parts of the window.

Defined results: null text has no words; texts shorter than the window lose nothing; order is by id,
then place. Rows that repeat an id are one document and get its result, so they should have one
text; rows without an id come first in order and lose nothing. A text of any length is read whole.
An empty table gives an empty one. Only the id and the text are read, whatever other columns say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import (
    BYTE_VALUE,
    U,
    chunks,
    flat,
    join_checked,
    join_words,
    materialize,
    mix,
    signed,
    span_hashes,
    words,
)

ANCHOR = 6  # words


@dataclass
class Spans:
    """Spans of the texts of one batch. ``row`` is the text, ``start`` its first word there."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray  # windows
    anchor: np.ndarray
    path: np.ndarray  # hash of the whole span
    word_hash: np.ndarray  # of all words, end to end
    first: np.ndarray  # index of each text's first word


def spans(data: np.ndarray, offsets: np.ndarray, window: int) -> Spans:
    starts, ends, first = words(data, offsets)
    word = span_hashes(BYTE_VALUE[data], starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    n = len(word) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none.view(U), none.view(U), word, first)
    k = min(ANCHOR, window)
    gram = np.zeros(len(word) - k + 1, U)
    for i in range(k):
        gram = gram * U(0xD6E8FEB86659FD93) + word[i : i + len(gram)]
    gram = mix(gram)
    least, place = gram, np.arange(len(gram))
    reach, size = window - k + 1, 1

    def lower(shift, n):
        left, right = least[:n], least[shift : shift + n]
        other = right < left
        return np.where(other, right, left), np.where(other, place[shift : shift + n], place[:n])

    while 2 * size <= reach:
        least, place = lower(size, len(least) - size)
        size *= 2
    if size < reach:
        least, place = lower(reach - size, n)
    inside = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    place = place[inside]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none.view(U), none.view(U), word, first)
    head = np.flatnonzero(
        np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)])
    )
    begin = inside[head]
    count = np.diff(np.append(head, len(inside)))
    path = span_hashes(mix(word + U(1)), begin, begin + count + window - 1)
    return Spans(row[begin], begin - first[row[begin]], count, gram[place[head]], path, word, first)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors of more than one span."""

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                anchor, n = np.unique(spans(*flat(part.column("text")), window).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(np.minimum(n, 2))], ["anchor", "n"]
                )

    counted = docs.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("anchor")


def _spans(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, path, doc, start, count, again``: all spans; ``again`` if the text had it before."""

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s = spans(*flat(part.column("text")), window)
                ids = part.column("doc").take(pa.array(s.row))
                same = mix(s.path + mix(s.anchor) + s.row.astype(U) * U(0x9E3779B97F4A7C15))
                again = np.ones(len(same), bool)
                again[np.unique(same, return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(s.anchor)),
                        pa.array(signed(s.path)),
                        ids,
                        pa.array(s.start.astype(np.int32)),
                        pa.array(s.count.astype(np.int32)),
                        pa.array(again),
                    ],
                    ["anchor", "path", "doc", "start", "count", "again"],
                )

    return docs.mapInArrow(cut, "anchor long, path long, doc long, start int, count int, again boolean")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``anchor, node, doc, start``: the windows of the ``wanted`` spans (``doc, starts``)."""

    def split(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s = spans(*flat(part.column("text")), window)
                starts = part.column("starts")
                ask_row = np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy(zero_copy_only=False))
                ask = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.isin(s.row << 32 | s.start, ask_row << 32 | ask)
                row, start, count = s.row[hit], s.start[hit], s.count[hit]
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                row, start = np.repeat(row, count), np.repeat(start, count) + nth
                at = s.first[row] + start
                node = span_hashes(mix(s.word_hash + U(2)), at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.repeat(s.anchor[hit], count))),
                        pa.array(signed(node)),
                        part.column("doc").take(pa.array(row)),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["anchor", "node", "doc", "start"],
                )

    asked = join_checked(docs, wanted, "doc")
    return asked.mapInArrow(split, "anchor long, node long, doc long, start int")


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """``doc, start, end``: runs of words covered by windows that occurred before, merged, in order
    per text. ``docs`` has ``doc, text``."""
    shared = materialize(_anchors(docs, window), "shared-anchors")
    held = materialize(join_checked(_spans(docs, window), shared, "anchor"), "spans")
    fresh = held.where("not again")
    at = F.struct("doc", "start")
    nodes = fresh.groupBy("anchor", "path").agg(
        F.min(at).alias("first"), F.count("*").alias("n")
    )
    nodes = materialize(nodes.select("anchor", "path", "first.doc", "first.start", "n"), "span-nodes")
    several = nodes.where("n > 1").select("anchor", "path", F.struct("doc", "start").alias("first"))
    whole = join_checked(fresh, several, ["anchor", "path"]).where(F.struct("doc", "start") != F.col("first"))
    whole = whole.select("doc", "start", "count").union(held.where("again").select("doc", "start", "count"))

    split = nodes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    split = nodes.join(split, "anchor").groupBy("doc").agg(F.collect_set("start").alias("starts"))
    split = materialize(split, "split-spans")
    below = materialize(_windows(docs, split, window), "windows")
    first = below.groupBy("anchor", "node").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    single = below.join(first, ["anchor", "node"]).where(F.struct("doc", "start") != F.col("first"))
    single = single.select("doc", "start", F.lit(1).alias("count"))

    runs = whole.union(single).select("doc", "start", (F.col("start") + F.col("count") + window - 1).alias("end"))
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("fresh", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(order))
    return marked.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def dedup(docs: DataFrame, window: int = 20, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id, n_words, n_removed, kept``: texts without the words that repeat, the rest joined by
    one space."""
    named = docs.select(F.col(row_id).cast("long").alias("doc"), F.col(text).alias("text"))
    runs = repeats(named, window).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")
    )
    runs = materialize(runs.select("doc", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends")), "runs")

    def strip(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                starts, ends, first = words(data, offsets)
                n_words = np.diff(first)
                lists = part.column("starts")
                row = np.repeat(
                    np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                )
                edge = np.zeros(len(starts) + 1, np.int64)
                for column, step in (("starts", 1), ("ends", -1)):
                    place = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    # A row that repeats an id with a shorter text has no such words.
                    place = first[row] + np.minimum(place, n_words[row])
                    np.add.at(edge, place, step)
                keep = np.cumsum(edge)[:-1] == 0
                kept_row = np.repeat(np.arange(len(n_words)), n_words)[keep]
                n_kept = np.bincount(kept_row, minlength=len(n_words))
                kept = join_words(data, starts[keep], ends[keep], n_kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n_words), pa.array(n_words - n_kept), kept],
                    ["doc", "n_words", "n_removed", "kept"],
                )

    both = join_checked(named, runs, "doc", "left")
    out = both.mapInArrow(strip, "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", row_id)
