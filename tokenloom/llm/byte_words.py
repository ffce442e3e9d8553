"""Words of byte-level tokenizing, cut from columns of whole texts by NumPy.

The public library's word pattern looks at little: classes of neighbouring characters (letter,
number, white space, other), spaces, text ends and seven contractions after an apostrophe. All words
of many texts are therefore found by comparing a column of classes with itself, shifted by one; they
are slices of the column's own bytes. Which class a character has is asked of the library, once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE, EDGE, UNKNOWN = range(6)
TEXT_AT_ONCE = 1 << 19  # bytes, or one text


class Classes:
    """Class of every character met so far."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self._words = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.known = np.full(0x110000, UNKNOWN, np.uint8)
        self.of(np.arange(128))
        self._ascii = self.known[:256].tobytes()

    def _ask(self, char: str) -> int:
        for sample, found in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._words(sample + char)) == 1:
                return found
        return SPACE

    def of_ascii(self, data: np.ndarray) -> np.ndarray:
        return np.frombuffer(data.tobytes().translate(self._ascii), np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.known.take(points)
        new = np.unique(points[out == UNKNOWN])
        if len(new):
            self.known[new] = [self._ask(chr(p)) for p in new]
            out = self.known.take(points)
        return out


def _points(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 characters."""
    points = data.take(begin).astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    at, lead = begin[wide], points[wide]
    tail = [data.take(at + k, mode="clip").astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | tail[0]
    three = (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    points[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return points


def _marks(texts: pa.Array, begin: np.ndarray, specials: list[str]) -> np.ndarray:
    """Where special strings begin and end, in bytes of the column: rows of two."""
    if not specials:
        return np.zeros((0, 2), np.int64)
    some = pa.array(np.zeros(len(texts), bool))
    for s in specials:
        some = pc.or_(some, pc.match_substring(texts, s))
    pattern = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(specials, key=len, reverse=True)))
    found = []
    for i in np.flatnonzero(some.to_numpy(zero_copy_only=False)):
        found += [(begin[i] + m.start(), begin[i] + m.end()) for m in pattern.finditer(texts[int(i)].as_py().encode())]
    return np.array(found, np.int64).reshape(-1, 2)


def _cuts(data: np.ndarray, marks: np.ndarray) -> list[int]:
    """Places in a long text, some ``TEXT_AT_ONCE`` bytes apart, between an ASCII letter or digit and a
    space or line end, outside of special strings: words begin there, whatever else stands around."""
    cuts, at = [0], TEXT_AT_ONCE
    while at < len(data):
        end = min(len(data), at + TEXT_AT_ONCE)
        gap, left = data[at:end], data[at - 1 : end - 1]
        plain = (left - np.uint8(48) < 10) | ((left | np.uint8(32)) - np.uint8(97) < 26)
        found = np.flatnonzero(((gap == 32) | (gap == 10)) & plain) + at
        if len(marks) and len(found):
            mark = marks[np.maximum(np.searchsorted(marks[:, 0], found) - 1, 0)]
            found = found[(found <= mark[:, 0]) | (found >= mark[:, 1])]
        if len(found):
            cuts.append(int(found[0]))
            end = cuts[-1] + TEXT_AT_ONCE
        at = end
    return cuts


def split(texts: pa.Array, specials: list[str], classes: Classes) -> pa.Array:
    """The words of each text, as :func:`_split` finds them; a single long text is taken in parts."""
    if len(texts) != 1 or (pc.binary_length(texts)[0].as_py() or 0) <= TEXT_AT_ONCE:
        return _split(texts, specials, classes)
    begin, end = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + 2]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end]
    cuts = np.array([*_cuts(data, _marks(texts, np.zeros(1, np.int64), specials)), len(data)], np.int32)
    parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    words = pa.concat_arrays([_split(parts.slice(i, 1), specials, classes).flatten() for i in range(len(parts))])
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)


def _split(texts: pa.Array, specials: list[str], classes: Classes) -> pa.Array:
    """The words of each text; special strings are cut out first and are words of their own. A null
    text has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return pa.array([[]] * len(texts), pa.list_(pa.string()))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = (bounds - bounds[0]).astype(np.int64)
    marks = _marks(texts, bounds, specials)
    # Characters, and the places of texts and special strings among them.
    if data.max() < 128:
        byte, points, edges, inner = None, data, bounds, marks
        kind = classes.of_ascii(data)
    else:
        byte = np.flatnonzero(data & 0xC0 != 0x80)
        points = _points(data, byte)
        kind = classes.of(points)
        edges, inner = np.searchsorted(byte, bounds), np.searchsorted(byte, marks)
    n = len(points)
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[edges[edges < n]] = EDGE
    before[inner[inner < n]] = EDGE
    begins = kind != before
    # The last white space before a word is a word of its own; a plain space belongs to what follows.
    after = np.flatnonzero((before == SPACE) & begins)
    begins[after - 1] = True
    begins[after] = points[after - 1] != 32
    _contractions(points, before, begins)
    for first, last in inner:
        begins[first + 1 : last] = False
        begins[first] = True
        begins[last : last + 1] = True
    start = np.flatnonzero(begins)
    upto = np.searchsorted(start, edges)
    if byte is not None:
        start = byte[start]
    offsets = np.append(start, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words)


def _contractions(points: np.ndarray, before: np.ndarray, begins: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll, where a word begins with the apostrophe, are words."""
    n = len(points)
    at = np.flatnonzero(points[: n - 1] == ord("'"))
    at = at[begins[at]]  # not after other marks or a space, which take it along

    def char(k: int) -> np.ndarray:
        """The k-th character after, 0 beyond the text."""
        place = np.minimum(at + k, n - 1)
        return np.where((at + k < n) & (before[place] != EDGE), points[place], 0)

    one, two = char(1), char(2)
    two[one == 0] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    hit = short | long
    begins[at[hit] + 1] = False
    end = at[hit] + np.where(short[hit], 2, 3)
    begins[end[end < n]] = True


def pieces(texts: pa.Array) -> Iterator[slice]:
    """Rows with about ``TEXT_AT_ONCE`` bytes, or one."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + TEXT_AT_ONCE, "right")))
        yield slice(at, end)
        at = end
