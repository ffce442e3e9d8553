"""Operator 5: BPE encoding and decoding by a pair occurrence index.

A task takes the distinct words it has not met yet, lays their symbols end to end and maps every
mergeable pair to all its places there. Active ranks are applied in ascending order: all places of
the lowest rank merge at once, and the lists of the pairs that vanish or appear are updated. New
pairs of a lower rank are taken next. Words repeat, so a task keeps the ids of the words it has met,
up to ``CACHE_WORDS``; then it starts over.

Defined results: null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each for itself; texts are never cut; ids unknown to the vocabulary decode to nothing, as in
the public library; null ids decode to null. An empty table gives an empty one. Input columns stay
unless they bear the name of a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import word_bpe
from tokenloom.llm.common import release

CACHE_WORDS = 150_000
DECODE_IDS = 1 << 15  # ids whose tokens are put together at once
AHEAD_BYTES = 1 << 22  # text whose new words are merged together
SLICE_BYTES = 1 << 20  # of a batch of longer texts


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _sorted_once(values: np.ndarray) -> np.ndarray:
    """Each value once, in ascending order; ``values`` are sorted in place."""
    values.sort()
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


class PairIndex:
    """Symbols of many words, linked within each word, with the places of every mergeable pair."""

    def __init__(self, rule: word_bpe.Rules, symbols: np.ndarray, starts: np.ndarray):
        n = len(symbols)
        self.rule, self.symbol = rule, symbols.astype(np.int32)
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        first = starts[starts < n]
        self.before[first] = -1
        self.after[np.append(first[1:], n)[: len(first)] - 1] = -1
        self.alive = np.ones(n, bool)
        self.rank = np.full(n, -1, np.int32)  # of the pair that begins at a place
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._note(np.flatnonzero(self.after >= 0).astype(np.int32))

    def _note(self, at: np.ndarray) -> None:
        """Work out the pairs that begin ``at`` these places and enter them in the index."""
        left, right = self.symbol[at], self.symbol[self.after[at]]
        ranks = self.rule.ranks(left, right)
        self.rank[at] = ranks
        some = ranks >= 0
        at, ranks = at[some], ranks[some]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = _runs(ranks)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rank = int(ranks[lo])
            if rank not in self.places:
                self.places[rank] = []
                heappush(self.active, rank)
            self.places[rank].append(at[lo:hi])

    def _first_of_runs(self, at: np.ndarray) -> np.ndarray:
        """Of places that overlap (a pair of equal symbols in a run), every second, from the left."""
        keep, taken = [], -1
        follow = self.after[at]
        for i, j in zip(at.tolist(), follow.tolist()):
            if i != taken:
                keep.append(i)
                taken = j
        return np.array(keep, np.int32)

    def merge(self) -> None:
        while self.active:
            rank = heappop(self.active)
            lists = self.places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[self.rank[at] == rank]  # a place that is gone has no rank
            if not len(at):
                continue
            if len(lists) > 1:
                at = _sorted_once(at)
            rest = at[:0]
            if self.symbol[at[0]] == self.symbol[self.after[at[0]]]:
                at = self._first_of_runs(at)
            if self.rule.careful[rank]:  # the leftmost place of each word; the others come again
                word = np.searchsorted(self.word_starts, at, "right")
                lead = np.concatenate([[True], word[1:] != word[:-1]])
                at, rest = at[lead], at[~lead]
            gone = self.after[at]
            self.symbol[at] = self.rule.made[rank]
            self.alive[gone] = False
            self.rank[gone] = -1
            after = self.after[gone]
            self.after[at] = after
            linked = after >= 0
            self.before[after[linked]] = at[linked]
            self.rank[at[~linked]] = -1
            before = self.before[at]
            # A neighbour on the left that has merged away in this very step points to its own left.
            changed = np.concatenate([at[linked], before[before >= 0]])
            self._note(_sorted_once(changed[self.alive[changed]]))
            if len(rest):
                rest = rest[self.alive[rest] & (self.rank[rest] == rank)]
                if rank not in self.places and len(rest):
                    self.places[rank] = []
                    heappush(self.active, rank)
                if len(rest):
                    self.places[rank].append(rest)

    word_starts = np.zeros(0, np.int64)


def encode_words(words: list[str], rule: word_bpe.Rules) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, end to end, and how many each has."""
    special = {"\0" + s: i for s, i in rule.special.items()}
    data = [b"\0" if w in special else w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(data), np.uint8)
    symbols = rule.inner[raw]
    ends = starts + sizes - 1
    symbols[ends] = rule.final[raw[ends]]
    index = PairIndex(rule, symbols, starts)
    index.word_starts = starts
    index.merge()
    for i, w in enumerate(words):
        if w in special:
            index.symbol[starts[i]] = special[w]
    counts = np.add.reduceat(index.alive, starts, dtype=np.int64) if len(words) else sizes
    return index.symbol[index.alive].astype(np.int32), counts


class Encoder:
    """Ids of all words a Python worker has met, as one array with a slice for each word."""

    def __init__(self, path: str):
        self.rule = word_bpe.rules(path)
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def learn(self) -> None:
        """Spell the words that have a number and no ids yet."""
        new = list(islice(self.number, len(self.count), None))
        if not new:
            return
        ids, count = encode_words(new, self.rule)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])

    def numbered(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the words of each text: they are kept, not words, of which a batch has very many."""
        number = self.number.__getitem__
        found = (self.rule.words(text) if text else () for text in texts)
        return [np.fromiter(map(number, words), np.int32, len(words)) for words in found]

    def spelled(self, numbered: list[np.ndarray]) -> pa.Array:
        """Ids of texts whose words are learned."""
        n_words = np.fromiter(map(len, numbered), np.int64, len(numbered))
        word = np.concatenate(numbered) if numbered else np.zeros(0, np.int32)
        count = self.count[word]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.start[word] - (ends - count), count)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.ids[take]))

    def make_room(self) -> None:
        if len(self.number) > CACHE_WORDS:
            self.forget()

    def encode(self, texts: list[str | None]) -> pa.Array:
        self.make_room()
        numbered = self.numbered(texts)
        self.learn()
        return self.spelled(numbered)


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _spelled(batches, path)

    return docs.withColumn(ids, encoded(F.col(text)))


def round_trip(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the token ids of each text and what they decode to, by one Python worker a task."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in _spelled(batches, path):
            yield pa.StructArray.from_arrays([column, decode_ids(column, path)], ["ids", "decoded"])

    coded = docs.withColumn("_coded", both(F.col(text)))
    return coded.withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")


def _spelled(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    """Ids of columns of texts; of some columns read ahead the words are numbered, so that the new
    ones merge together."""
    own, ahead, size = encoder(path), [], 0

    def spell():
        own.learn()
        while ahead:
            yield own.spelled(ahead.pop(0))
        own.make_room()
        release()

    for column in batches:
        if column.nbytes > AHEAD_BYTES:  # a batch of long texts is spelled in slices
            yield from spell()
            size = 0
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
            cuts = _runs(group).tolist()
            parts = (column.slice(lo, hi - lo).to_pylist() for lo, hi in zip(cuts, cuts[1:]))
            yield pa.concat_arrays([own.encode(part) for part in parts])
            release()
            continue
        ahead.append(own.numbered(column.to_pylist()))
        size += column.nbytes
        if size >= AHEAD_BYTES:
            yield from spell()
            size = 0
    yield from spell()
    own.forget()
    release()


def decode_ids(column: pa.Array, path: str) -> pa.Array:
    """Tokens joined by one space, which is what the library gives for a file without a decoder."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cuts = _runs(np.cumsum(sizes, dtype=np.int64) // DECODE_IDS).tolist() if len(column) else [0, 0]
    parts = [_decoded(column.slice(lo, hi - lo), path) for lo, hi in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts)


def _decoded(column: pa.Array, path: str) -> pa.Array:
    if path not in _decoders:
        tokens = np.array([t.encode() for t in word_bpe.rules(path).tokens], object)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        _decoders[path] = np.frombuffer(b" ".join([*tokens, b""]), np.uint8), sizes
    data, sizes = _decoders[path]
    starts = np.cumsum(sizes + 1) - sizes - 1
    rows = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), rows)
    known = (ids >= 0) & (ids < len(sizes))
    known[known] = sizes[ids[known]] > 0
    ids, row = ids[known].astype(np.int64), row[known]
    size = sizes[ids] + 1  # with the space behind it
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(starts[ids] - (ends - size), size)
    out = data[take]
    per_row = np.bincount(row, minlength=len(rows))
    bytes_to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_row)])]
    keep = np.ones(total, bool)
    keep[bytes_to[1:][per_row > 0] - 1] = False  # no space behind the last token
    bounds = bytes_to - np.concatenate([[0], np.cumsum(per_row > 0)])
    made = pa.LargeStringArray.from_buffers(
        len(rows), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep])
    )
    made = made.cast(pa.string())
    return pc.if_else(column.is_valid(), made, None) if column.null_count else made


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text that its token ids spell."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return decode_ids(column, path)

    return tokens.withColumn(text, decoded(F.col(ids)))
