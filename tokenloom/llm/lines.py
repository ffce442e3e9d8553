"""Operator 8: line dedup by a segment-partition edit join.

A line goes if a line before it, in order of id and place, is equal to it but for at most ``edits``
inserted, deleted or replaced characters. Lines are cut into ``edits + 1`` segments, so two such
lines share at least one whole. Segments are set by bands of lengths: the first and last ``p``
characters and those in between, of a size the band fixes. A line is entered under its segments, and
looked up under its substrings at every place an untouched segment can have moved to, in its own
band and in a neighbouring one that its length may reach. What shares a key is verified with a banded
bit-parallel edit distance (Hyyrö's form of Myers's bit-vectors), many pairs at a time.

Equal lines are one line: its first place stands for it, and copies are neither entered again by a
task nor paired. Pairs are of distinct lines only, and of those whose characters can be ``edits``
apart: every row carries a line's character counts by class, and two counts that differ by more
than two for each edit part a pair in the join itself. Lines under a key meet the first of them
before any others, and only those that this leaves open meet the rest: near lines by the thousand
make a pair each, not all pairs.

Defined results: lines end at a line feed and are compared without white space at either end; lines
of fewer than ``min_chars`` characters always stay, so blank ones do; null text has no lines and
stays null; the empty text has one, which stays. Rows that repeat an id are one document and get its
result; rows without an id come first and lose nothing. Lines of any length are compared whole. An
empty table gives an empty one. Other columns pass through ``drop_lines``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import (
    BYTE_VALUE,
    SPACE,
    SpanHash,
    U,
    chunks,
    flat,
    join_checked,
    materialize,
    mix,
    signed,
    span_hashes,
)

BAND = 16  # lengths with the same segments
OTHER_VALUE = mix(BYTE_VALUE)
# One in the digit of a character's class, at its first byte; bytes that follow it count for nothing.
CLASS_ONE = np.array([0 if b & 0xC0 == 0x80 else 1 << 4 * (b & 15) for b in range(256)], U)
SEEN_LINES = 200_000  # lines a task remembers, so as not to enter copies again


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """Row, place in the row, start and end of every line, without white space at its ends."""
    ends = np.flatnonzero(data == 0x0A)
    row = np.searchsorted(offsets, ends, "right") - 1
    rows = np.concatenate([row, np.arange(len(offsets) - 1)])
    ends = np.concatenate([ends, offsets[1:]])
    order = np.lexsort((ends, rows))
    rows, ends = rows[order], ends[order]
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    place = np.arange(len(rows)) - first[rows]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    starts = np.where(place == 0, offsets[rows], starts)
    ink = np.flatnonzero(~SPACE[data])
    lo = np.searchsorted(ink, starts)
    hi = np.searchsorted(ink, ends)
    some = hi > lo
    begin, end = starts.copy(), starts.copy()
    begin[some] = ink[lo[some]]
    end[some] = ink[hi[some] - 1] + 1
    return rows, place, begin, end


def _lines(data, offsets, min_chars):
    """Lines that take part: row, place, start, end, characters, hash; what hashes their parts; and
    for each byte the number of characters before it."""
    row, place, start, end = line_spans(data, offsets)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[end] - lead[start]
    use = chars >= min_chars
    row, place, start, end, chars = row[use], place[use], start[use], end[use], chars[use]
    hashes = SpanHash(BYTE_VALUE[data])
    return row, place, start, end, chars, hashes(start, end), hashes, lead


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h, g, doc, line`` of every line that takes part; ``h, g`` are its hashes."""

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                row, place, start, end, _, h, _, _ = _lines(data, offsets, min_chars)
                g = span_hashes(OTHER_VALUE[data], start, end)
                ids = part.column("doc").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), pa.array(signed(g)), ids, pa.array(place.astype(np.int32))],
                    ["h", "g", "doc", "line"],
                )

    return docs.mapInArrow(cut, "h long, g long, doc long, line int")


def _keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``key, h, bag, own, doc``: lines under their segments and under what segments can have become,
    once for a while of each task's lines, by the first document met. ``own`` marks a line's segments
    where they lie, in its own band."""

    def enter(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                row, _, start, end, chars, h, hashes, lead = _lines(data, offsets, min_chars)
                bag = np.concatenate([np.zeros(1, U), np.cumsum(CLASS_ONE[data])])
                bag = bag[end] - bag[start]
                if len(seen) > SEEN_LINES:
                    seen.clear()
                _, once = np.unique(h, return_index=True)
                once = once[[x not in seen for x in h[once].tolist()]]
                seen.update(h[once].tolist())
                start, end, chars, h, bag = start[once], end[once], chars[once], h[once], bag[once]
                doc = part.column("doc").take(pa.array(row[once]))
                at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
                at = np.append(at, len(data))
                char0 = lead[start]
                made_keys, made_from, made_own = [], [], []
                own = chars // BAND
                for step in (-1, 0, 1):  # the bands that a line within the limit may lie in
                    band = own + step
                    lo, hi = band * BAND, band * BAND + BAND - 1
                    near = (chars - edits <= hi) & (chars + edits >= np.maximum(lo, min_chars)) & (hi >= min_chars)
                    size = np.maximum(lo, min_chars)  # least length of a line in the band
                    for segment, shift, begin, length in _segments(size, chars, edits):
                        ok = near & (begin >= 0) & (begin + length <= chars)
                        s = at[char0[ok] + begin[ok]]
                        e = at[char0[ok] + begin[ok] + length[ok]]
                        key = hashes(s, e) + band[ok].astype(U) * U(64) + U(segment)
                        made_keys.append(mix(key))
                        made_from.append(np.flatnonzero(ok))
                        made_own.append(np.full(len(key), step == 0 and shift == 0))
                line = np.concatenate(made_from)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(signed(x)) for x in (np.concatenate(made_keys), h[line], bag[line])),
                        pa.array(np.concatenate(made_own)),
                        doc.take(pa.array(line)),
                    ],
                    ["key", "h", "bag", "own", "doc"],
                )

    return docs.mapInArrow(enter, "key long, h long, bag long, own boolean, doc long")


def _bags_near(a: str, b: str, edits: int):
    """Whether two lines' character counts can be ``edits`` apart.

    Bags are numbers with a digit to base 16 for each class, so their difference has the differences
    of the counts as digits, between -8 and 7 for lines that are near.
    """
    low, bias = F.lit((1 << 32) - 1), F.lit(0x88888888)  # by halves, for sums must not overflow

    def half(name, top):
        return F.shiftrightunsigned(name, 32) if top else F.col(name).bitwiseAND(low)

    first = half(a, False) - half(b, False) + bias
    second = half(a, True) - half(b, True) + bias + F.shiftright(first, 32)
    total = F.lit(0)
    for part in (first, second):
        for c in range(8):
            total = total + F.abs(F.shiftright(part, 4 * c).bitwiseAND(F.lit(15)) - 8)
    return total <= 2 * edits


def _segments(size: np.ndarray, chars: np.ndarray, edits: int):
    """Segments of lines whose band begins at ``size``, at each shift: number, shift, begin, length.

    All but the last count from the line's start, the last from its end. The last needs no shift, and
    neither does the first, as no edit lies outside them.
    """
    n = edits + 1
    p = size // n
    for i in range(n):
        length = p if i < n - 1 else size - p * (n - 1)
        if i == n - 1:
            yield i, 0, chars - length, length
        else:
            for shift in range(-edits, edits + 1) if i else (0,):
                yield i, shift, p * i + shift, length


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether ``a[i]`` and ``b[i]`` are at most ``edits`` apart, by banded bit-vectors."""
    result = np.zeros(len(a), bool)
    left, right, index = [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            result[i] = True
        elif abs(len(x) - len(y)) <= edits:
            x, y = _trim(x, y)
            left.append(x if len(x) >= len(y) else y)
            right.append(y if len(x) >= len(y) else x)
            index.append(i)
    order = sorted(range(len(index)), key=lambda i: len(left[i]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end == at or (end - at + 1) * len(left[order[end]]) <= 1 << 20):
            end += 1
        some = order[at:end]
        near = _banded([left[i] for i in some], [right[i] for i in some], edits)
        result[[index[i] for i in some]] = near
        at = end
    return result


def _trim(x: str, y: str) -> tuple[str, str]:
    """Without the common start and end."""

    def common(p: str, q: str) -> int:
        lo, hi = 0, min(len(p), len(q))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if p[lo:mid] == q[lo:mid] else (lo, mid - 1)
        return lo

    n = common(x, y)
    x, y = x[n:], y[n:]
    n = common(x[::-1], y[::-1])
    return x[: len(x) - n], y[: len(y) - n]


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "replace"), np.int32)
    return out


def _banded(a: list[str], b: list[str], k: int) -> np.ndarray:
    """``a[i]`` at least as long as ``b[i]``, by ``k`` at most. Column j of the matrix holds rows
    j-k to j+k as bits; along the lowest of them the score can only grow."""
    m, n = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    width = 2 * k + 1
    pattern = np.full((len(a), int(m.max()) + 2 * k + 2), -1, np.int32)
    pattern[:, k : k + int(m.max())] = _codes(a, int(m.max()), -1)
    text = _codes(b, max(1, int(n.max())), -2)
    mask, low = U((1 << width) - 1), U(1 << (width - 1))
    plus = np.full(len(a), ((2 << k) - 1) << k, U)  # rows 1 to k+1 of column 0 rise by one
    minus = np.zeros(len(a), U)
    score = np.minimum(m, k)
    for j in range(1, int(n.max()) + 1):
        live = j <= n
        equal = np.zeros(len(a), U)
        for i in range(width):
            equal |= (pattern[:, j - 1 + i] == text[:, j - 1]).astype(U) << U(i)
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        up = minus | (~(zero | plus) & mask)
        down = zero & plus
        inside = j + k <= m  # the band's last row is a row of the matrix
        bit = np.clip(width - 1 - (j + k - m), 0, width - 1).astype(U)
        level = ((up >> bit) & U(1)).astype(np.int64) - ((down >> bit) & U(1)).astype(np.int64)
        grow = np.where(inside, (zero & low) == 0, level)
        score = np.where(live, score + grow, score)
        half = zero >> U(1)
        plus = np.where(live, down | (~(half | up) & mask), plus)
        minus = np.where(live, half & up, minus)
    return np.where(n == 0, m, score) <= k


def _texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """``h, line_text`` of the ``wanted`` places (``doc, places``)."""

    def read(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = flat(part.column("text"))
                row, place, start, end, _, h, _, _ = _lines(data, offsets, min_chars)
                lists = part.column("places")
                ask_row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                ask = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero(np.isin(row << 32 | place, ask_row << 32 | ask))
                raw = data.tobytes()
                lines = [raw[s:e].decode() for s, e in zip(start[hit].tolist(), end[hit].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[hit])), pa.array(lines, pa.string())], ["h", "line_text"]
                )

    return join_checked(docs, wanted, "doc").mapInArrow(read, "h long, line_text string")


def _near(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The ``pairs`` (``a, b``, by ``h``) whose lines are at most ``edits`` apart. Written."""
    pairs = materialize(pairs.distinct(), "line-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    asked = distinct.join(asked, "h").groupBy("doc").agg(F.collect_set("line").alias("places"))
    texts = materialize(_texts(docs, materialize(asked, "line-places"), min_chars), "line-texts")
    texts = texts.dropDuplicates(["h"])
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def verify(batches):
        for batch in batches:
            near = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield batch.select([0, 1]).filter(pa.array(near))

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "line-pairs")


def _later(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h`` of the lines of ``pairs`` that have a near one before them. Written."""
    places = distinct.select("h", F.struct("doc", "line").alias("at"))
    one, two = places.toDF("a", "at_a"), places.toDF("b", "at_b")
    placed = pairs.join(one, "a").join(two, "b")
    later = placed.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("h"))
    return materialize(later.distinct(), "later-lines")


def _shared(keys: DataFrame) -> DataFrame:
    """``key, a, bag_a, h, bag, own, doc``: the lines under each key that has two at least, one of them
    under a segment of its own, each once, beside the key's first line ``a``.

    Most keys have one line and are gone after one aggregate of plain numbers; rows that tasks entered
    twice become one among the few that are left, which is all the later joins read.
    """
    # Both sides of the join are this one exchange, as long as both ask for all its columns.
    keyed = keys.repartition("key")
    at = F.coalesce("doc", F.lit(-(1 << 63)))
    first = [F.min_by(c, at).alias(n) for c, n in (("h", "a"), ("bag", "bag_a"))]
    facts = [F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("some")]
    met = keyed.groupBy("key").agg(*first, *facts).where("low < high and some").select("key", "a", "bag_a")
    each = keyed.join(met, "key").groupBy("key", "a", "bag_a", "h", "bag")
    return each.agg(F.max("own").alias("own"), F.min("doc").alias("doc"))


def near_lines(docs: DataFrame, distinct: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``h`` of the distinct lines that an earlier one is at most ``edits`` apart from.
    ``distinct`` is a written table of ``h, doc, line`` with each line's first place.

    One earlier line is enough, so lines under a key are first compared with the first of them
    alone: a row per line and key, however many lines are near one another. Only lines that this
    does not settle are then compared with all under their keys. Which line of a key counts as the
    first decides how much work is left, never what goes.

    Of two near lines either has a segment of its own, in its own band, that the other is looked up
    under. So a pair is made where the key is a segment of its line with the smaller hash: not under
    every shift and band that both are looked up under.
    """
    shared = materialize(_shared(_keys(docs, edits, min_chars)), "shared-keys")
    star = (F.col("a") != F.col("h")) & _bags_near("bag_a", "bag", edits)
    stars = shared.where(star).select("a", F.col("h").alias("b"))
    settled = _later(_near(docs, distinct, stars, edits, min_chars), distinct)
    judged = join_checked(shared.select("key", "h", "bag", "own"), settled.withColumn("out", F.lit(True)), "h", "left")
    judged = materialize(judged, "judged-keys")
    side = lambda n: [F.col("h").alias(n), F.col("bag").alias(f"bag_{n}"), F.col("own").alias(f"own_{n}")]
    open_ = judged.where("out is null").select("key", *side("b"))
    other = judged.select("key", F.coalesce("out", F.lit(False)).alias("out"), *side("a"))
    # The second time that two open lines meet is left out.
    once = (F.col("own_a") & (F.col("a") < F.col("b"))) | (F.col("own_b") & (F.col("b") < F.col("a")) & F.col("out"))
    pairs = other.join(open_, "key").where(once & _bags_near("bag_a", "bag_b", edits))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _later(_near(docs, distinct, pairs, edits, min_chars), distinct)
    return settled.union(more).distinct()


def repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``doc, line``: places of the lines that go. ``docs`` has ``doc, text``."""
    held = materialize(_occurrences(docs, min_chars), "lines")
    at = F.struct("doc", "line")
    distinct = held.groupBy("h", "g").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    distinct = materialize(distinct.select("h", "g", "first.doc", "first.line", "n"), "distinct-lines")
    near = near_lines(docs, distinct.select("h", "doc", "line"), edits, min_chars)
    judged = distinct.join(near.withColumn("gone", F.lit(True)), "h", "left")
    first = F.struct("doc", "line")
    gone = F.coalesce("gone", F.lit(False))
    judged = judged.where(gone | (F.col("n") > 1)).select("h", "g", first.alias("first"), gone.alias("gone"))
    judged = materialize(judged, "judged-lines")
    out = join_checked(held, judged, ["h", "g"])
    return out.where(F.col("gone") | (first != F.col("first"))).select("doc", "line")


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts less the lines whose numbers are listed, in one pass over each."""
    out = []
    for text, lines in zip(texts.to_pylist(), gone.to_pylist()):
        if text is None or not lines:
            out.append(text)
            continue
        parts = text.split("\n")
        for i in lines:
            parts[i] = None
        out.append("\n".join(p for p in parts if p is not None))
    return pa.array(out, pa.string())


def drop_lines(
    docs: DataFrame, edits: int = 2, min_chars: int = 20, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``text`` less the lines that go, and ``_n_lines, _n_removed``."""
    named = docs.select(F.col(row_id).cast("long").alias("doc"), F.col(text).alias("text"))
    gone = repeated_lines(named, edits, min_chars).groupBy("doc").agg(F.collect_set("line").alias("_lines"))
    gone = materialize(gone.withColumnRenamed("doc", "_doc"), "lines-to-drop")
    both = docs.withColumn("_doc", F.col(row_id).cast("long"))
    both = join_checked(both, gone, "_doc", "left").drop("_doc")
    ends = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    kept = F.arrow_udf(_without, "string")
    return (
        both.withColumn("_n_lines", F.coalesce(ends + 1, F.lit(0)).cast("long"))
        .withColumn("_n_removed", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
        .withColumn(text, kept(F.col(text), F.col("_lines")))
        .drop("_lines")
    )
