"""Encoding by a columnar dictionary of words.

Texts are split into words in the JVM and reach a task as Arrow lists. Words of a batch are numbered
by Arrow, so Python sees each distinct one once; what the worker has not met before is encoded, and
the ids of all words lie end to end in one flat array. The ids of a text are then a gather from that
array: no Python object is made per row, per word or per id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

MOST_WORDS = 1 << 20  # a dictionary that has met more starts anew
MOST_IDS = 1 << 24
WORDS_AT_ONCE = 1 << 18  # of a batch; a single longer text is taken whole
WORDS_GATHERED = 1 << 16  # what their ids take stays in a core's own memory
WORDS_NUMBERED = 1 << 21  # looked up together, each distinct one once


class WordCodes:
    """Ids of the words met so far. ``spell`` gives the ids of a list of words, end to end, and how
    many each word has. Beyond ``most_words`` or ``most_ids`` the dictionary starts anew."""

    def __init__(
        self,
        spell: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        most_words: int = MOST_WORDS,
        most_ids: int = MOST_IDS,
    ):
        self.spell = spell
        self.most_words, self.most_ids = most_words, most_ids
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)  # where a row's ids begin; one more closes the last row
        self.ids = np.zeros(0, np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word; words must differ from each other."""
        if len(self.row) > self.most_words or len(self.ids) > self.most_ids:
            self._clear()
        found = list(map(self.row.get, words))
        missing = [i for i, row in enumerate(found) if row is None]
        if missing:
            new = [words[i] for i in missing]
            fresh, sizes = self.spell(new)
            first = len(self.start) - 1
            for row, i in enumerate(missing, first):
                found[i] = row
            self.row.update(zip(new, range(first, first + len(new))))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, fresh.astype(np.int32, copy=False)])
        return np.array(found, np.int64)

    def gather(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of words, end to end, and how many each word has."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        numbered = words.dictionary_encode()
        return self._gather(self.rows(_strings(numbered.dictionary)), numbered)

    def _gather(self, known: np.ndarray, numbered: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        rows = known[numbered.indices.to_numpy(zero_copy_only=False)]
        begin = self.start[rows]
        size = self.start[rows + 1] - begin
        upto = np.cumsum(size)
        return self.ids[np.arange(upto[-1]) + np.repeat(begin - upto + size, size)], size

    def texts(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of word lists, end to end, and where each list's ids begin (one more entry
        closes the last). A null list has none."""
        words = lists.flatten()
        counts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        parts, upto = [np.zeros(0, np.int32)], np.zeros(len(words) + 1, np.int64)
        for first in range(0, len(words), WORDS_NUMBERED):
            many = words.slice(first, WORDS_NUMBERED)
            slices = [many.slice(begin, WORDS_GATHERED) for begin in range(0, len(many), WORDS_GATHERED)]
            numbered, begin = pa.chunked_array(slices).dictionary_encode(), first
            known = self.rows(_strings(numbered.chunk(0).dictionary))
            for some in numbered.chunks:
                ids, size = self._gather(known, some)
                parts.append(ids)
                np.cumsum(size, out=upto[begin + 1 : begin + 1 + len(size)])
                upto[begin + 1 : begin + 1 + len(size)] += upto[begin]
                begin += len(size)
        return np.concatenate(parts), upto[counts.astype(np.int64)]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


def flattened(spelled: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ids, end to end, and their lengths."""
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return np.fromiter((i for ids in spelled for i in ids), np.int32, int(sizes.sum())), sizes


def some_rows(lists: pa.Array, most: int = 4 * WORDS_AT_ONCE) -> Iterator[pa.Array]:
    """Slices of a column of lists with about ``most`` elements, or one row."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes), 0
    while at < len(lists):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
        yield lists.slice(at, end - at)
        at = end


def encoded(codes: WordCodes, lists: pa.Array, most: int = WORDS_AT_ONCE) -> Iterator[pa.Array]:
    """The column of id lists for a column of word lists, in pieces; null stays null.

    Pieces leave one by one, so a task holds the ids of one of them, however large its batches are.
    """
    for piece in some_rows(lists, most):
        ids, bounds = codes.texts(piece)
        null = piece.is_null()
        yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=null if piece.null_count else None)


class TokenBytes:
    """Bytes of every id, end to end: decoding is a gather of byte ranges."""

    def __init__(self, symbols: Sequence[bytes]):
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in symbols])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(symbols), np.uint8)

    def texts(self, lists: pa.Array) -> pa.Array:
        """A column of id lists as a column of bytes; ids without bytes, or unknown ones, add none."""
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.start) - 1)
        ids = np.where(known, ids, 0)
        begin = self.start[ids]
        size = np.where(known, self.start[ids + 1] - begin, 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bounds = upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        valid = None
        if lists.null_count:
            bits = np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
            valid = pa.py_buffer(bits)
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lists), [valid, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        )
        return made.cast(pa.binary())


def decoded(table: TokenBytes, lists: pa.Array) -> Iterator[pa.Array]:
    return map(table.texts, some_rows(lists, WORDS_AT_ONCE))
