"""A range coder for token ids, in blocks that bring their own model.

A block stands for itself. Its model is learned from all its ids and written ahead of them, under a
CRC-32. The ids are cut into lanes, which are rows of the same NumPy operations, one id of each lane
per step.

The model predicts an id from the two ids before it (order 2), the one before it (order 1) and the
counts of the block (order 0). Orders 1 and 2 hold, per context (hashed for order 2), the id that
follows most often and how sure that is; the higher order that knows its context names the candidate.
The chance that the candidate is right mixes what the three orders say of it (shares measured in the
block, in the logistic domain, with weights fitted to the block). After a no, order-0 counts spell
the id. Both are one step of the coder: a yes has the lower part of the range, and the ids share the
upper one by their counts.

Writer and reader compute on integers only; floats help to choose what the model holds, which is then
written as integers, and in a division that is exact. The coder keeps a 48-bit range and gives 16-bit
words; carries run through the finished words at the end.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

LANES = 4096  # of a block at most
SHORT_LANE = 256  # ids of a lane at least, where a block has more
UNIT, BITS = 1 << 12, 12  # of probabilities
SURE = 7  # highest class of how sure a guess is
MOST_SLOTS = 18  # bits of the hash of an order-2 context
GAIN = 24  # bits that a context must save, to be written
PIECE = 1 << 15  # ids that a model looks at together
FIRST = 1 << 32  # a range below gives out a word
WORD, MASK = 16, (1 << 32) - 1
MOST_IDS = 1 << 16
HEAD = struct.Struct("<IIHBBI")  # ids, ids a lane, known ids less 1, bits of counts and slots, bytes of the model

SQUASH = np.array([max(1, min(UNIT - 1, round(UNIT / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int64)
STRETCH = np.array([round(256 * math.log((p + 0.5) / (UNIT - p - 0.5))) for p in range(UNIT)], np.int64)


HIT = 1 << 11  # number of cells
CELLS = np.arange(HIT)
SAYS = np.stack([CELLS >> 7, CELLS >> 3 & 15, CELLS & 7])  # of the orders, in each cell


def _slot(last: np.ndarray, prior: np.ndarray, slots: int) -> np.ndarray:
    return (last * 0x9E3779B1 + prior * 0x85EBCA6B >> 32 - slots) & (1 << slots) - 1


class Model:
    """What a block says of its ids, which are named by their rank among those used."""

    def __init__(self, known: np.ndarray, often: np.ndarray, guess: tuple, sure: tuple):
        self.known, self.often, self.guess, self.sure = known, often, guess, sure  # the last two of orders 1 and 2
        self.slots = len(sure[1]).bit_length() - 1
        # Per context one number: the guess and how sure it is. Classes of counts in their place in a cell.
        self._first, self._second = (g << 3 | s for g, s in zip(guess, sure))
        self._often = often << 7

    def complete(self, freq: np.ndarray, shares: np.ndarray, weight: np.ndarray) -> None:
        """Counts, which add up to a power of two, and shares and weights of the three orders."""
        self.freq, self.shares, self.weight = freq, shares, weight
        self.bits = int(freq.sum()).bit_length() - 1
        self.below = np.cumsum(freq) - freq
        self.chance = _mixed(shares, weight)

    def candidate(self, last: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate, and a cell of what is said of it: by order 0 how often it occurs (4 bits), by
        order 1 whether it agrees and how sure it is (1 and 3 bits), by order 2 how sure it is (3 bits)."""
        first, second = self._first.take(last), self._second.take(slot)
        secure = second & 7
        candidate = np.where(secure > 0, second, first) >> 3
        cell = self._often.take(candidate)
        cell |= (first & 7) << 3
        cell |= secure
        cell += (first >> 3 == candidate) * 64
        return candidate, cell

    def dump(self) -> bytes:
        met = self.guess[1][self.sure[1] > 0]
        parts = [(np.diff(self.known, prepend=0), "<u2"), (self.often, "u1"), (self.guess[0], "<u2"), (self.sure[0], "u1"), (self.sure[1], "u1")]
        parts += [(met, "<u2"), (self.freq, "<u4"), (self.shares, "<u2"), (self.weight, "<i4")]
        return b"".join(a.astype(t).tobytes() for a, t in parts)

    @classmethod
    def load(cls, data: bytes, n: int, slots: int) -> Model:
        at = 0

        def part(kind: str, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, size, at).astype(np.int64)
            at += size * np.dtype(kind).itemsize
            return out

        known, often, first = part("<u2", n), part("u1", n), part("<u2", n)
        sure = part("u1", n), part("u1", 1 << slots)
        second = np.zeros(1 << slots, np.int64)
        second[sure[1] > 0] = part("<u2", int(np.count_nonzero(sure[1])))
        model = cls(np.cumsum(known), often, (first, second), sure)
        model.complete(part("<u4", n), part("<u2", 48).reshape(3, 16), part("<i4", 3))
        return model


def _mixed(shares: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Chance of every cell: three orders' shares, mixed in the logistic domain."""
    heard = STRETCH[shares[np.arange(3)[:, None], SAYS]]
    return SQUASH.take(((heard * weight[:, None]).sum(0) >> 16) + 2048, mode="clip")


def _fitted(total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of hits by what each order says, and the weights that fit the cells best."""
    shares = np.zeros((3, 16), np.int64)
    for k in range(3):
        n, right = (np.bincount(SAYS[k], x, 16) for x in (total, hits))
        shares[k] = np.clip(UNIT * (right + 0.4) / (n + 0.8), 1, UNIT - 1)
    met = np.flatnonzero(total)
    heard = STRETCH[shares[np.arange(3)[:, None], SAYS[:, met]]] / 256
    weight = np.full(3, 0.4)
    for _ in range(12):  # Newton's method, held near where it starts
        chance = 1 / (1 + np.exp(-np.clip(weight @ heard, -8, 8)))
        slope = heard @ (hits[met] - total[met] * chance) - (weight - 0.4)
        bend = (heard * (total[met] * chance * (1 - chance))) @ heard.T + np.eye(3)
        weight = np.clip(weight + np.linalg.solve(bend, slope), -4, 4)
    return shares, np.round(weight * 65536).astype(np.int64)


def _likeliest(pairs: np.ndarray, bits: int, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context the rank that follows most often (the smallest of several), how often it does, and
    how often the context occurs. ``pairs`` holds context and rank, and gets sorted."""
    pairs.sort()
    begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    count = np.diff(begin, append=len(pairs))
    pair = pairs[begin].astype(np.int64)
    of = pair >> bits
    group = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    most = np.maximum.reduceat(count, group)
    guess, hits, total = (np.zeros(contexts, np.int64) for _ in range(3))
    best = np.flatnonzero(count == np.repeat(most, np.diff(group, append=len(of))))[::-1]
    guess[of[best]] = pair[best] & (1 << bits) - 1  # the first of equals is written last
    hits[of[group]] = most
    total[of[group]] = np.add.reduceat(count, group)
    return guess, hits, total


def _sure(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Class of the odds, 1 to ``SURE``; 0 where nothing is known."""
    odds = np.log2((hits + 0.5) / (total - hits + 0.5))
    return np.where(total > 0, np.clip((odds + 6.5) / 1.5, 1, SURE), 0).astype(np.int64)


def _cost(hits: np.ndarray, total: np.ndarray, rate: np.ndarray, spelled: float) -> np.ndarray:
    """Bits of the ids of each context, if its guess is said to be right at this rate."""
    rate = np.clip(rate, 0.001, 0.999)
    return -hits * np.log2(rate) - (total - hits) * (np.log2(1 - rate) - spelled)


def _before(rank: np.ndarray, length: int) -> np.ndarray:
    """The rank before each; 0 before a lane begins."""
    last = np.empty_like(rank)
    last[1:] = rank[:-1]
    last[::length] = 0
    return last


def _pieces(n: int, size: int = PIECE) -> list[slice]:
    return [slice(i, min(n, i + size)) for i in range(0, n, size)]


def learn(rank: np.ndarray, known: np.ndarray, length: int) -> tuple[Model, np.ndarray]:
    """The model of a block; the cell of each of its ids, plus ``HIT`` where the candidate is right."""
    n, wide = len(known), max(1, (len(known) - 1).bit_length())
    bits = min(18, max(12, wide + 4))
    slots = max(4, min(MOST_SLOTS, 32 - wide, len(rank).bit_length() - 3))
    last = _before(rank, length)
    prior = _before(last, length)
    pairs, slot = np.empty(len(rank), np.uint32), np.empty(len(rank), np.uint32)
    for s in _pieces(len(rank)):
        at = last[s].astype(np.int64)
        pairs[s] = at << wide | rank[s]
        slot[s] = _slot(at, prior[s].astype(np.int64), slots)
    del prior
    count = np.bincount(rank, minlength=n)
    spelled = float(count @ -np.log2(count / len(rank))) / len(rank)  # bits of an id by order 0
    # Contexts speak where they save more than they take to write.
    guess, hits, total = _likeliest(pairs, wide, n)
    told = total * spelled - _cost(hits, total, (hits + 0.5) / (total + 1), spelled) > GAIN
    sure = np.where(told, _sure(hits, total), 0)
    guess[~told] = 0
    rate = np.where(told, hits / np.maximum(total, 1), 0)
    np.left_shift(slot, wide, out=pairs)
    pairs |= rank
    second, right, met = _likeliest(pairs, wide, 1 << slots)
    del pairs
    plain, said = np.zeros(1 << slots), np.zeros(1 << slots)
    for s in _pieces(len(rank), 8 * PIECE):
        at, of = last[s].astype(np.int64), slot[s].astype(np.int64)
        plain += np.bincount(of, guess.take(at) == rank[s], 1 << slots)
        said += np.bincount(of, rate.take(at), 1 << slots)
    told = _cost(plain, met, said / np.maximum(met, 1), spelled) - _cost(right, met, (right + 0.5) / (met + 1), spelled) > GAIN
    secure = np.where(told, _sure(right, met), 0)
    second[~told] = 0
    often = np.minimum(np.frexp(count * (1 << 16) // len(rank))[1], 15).astype(np.int64)
    model = Model(known, often, (guess, second), (sure, secure))
    cell, missed, cells = np.empty(len(rank), np.uint16), np.zeros(n, np.int64), np.zeros(2 * HIT, np.int64)
    for s in _pieces(len(rank)):
        candidate, of = model.candidate(last[s].astype(np.int64), slot[s].astype(np.int64))
        hit = candidate == rank[s]
        of += hit * HIT
        cells += np.bincount(of, minlength=2 * HIT)
        missed += np.bincount(rank[s][~hit], minlength=n)
        cell[s] = of
    freq = 1 + missed * ((1 << bits) - n) // max(1, int(missed.sum()))
    freq[missed.argmax()] += (1 << bits) - freq.sum()
    model.complete(freq, *_fitted(cells[:HIT] + cells[HIT:], cells[HIT:]))
    return model, cell


class Writer:
    """Words of every lane. A step narrows the ranges of the first lanes.

    A reader's ranges are the same, so it takes a word whenever a lane gives one out, three words
    further on. Words are written in that order, and all lanes read one stream."""

    def __init__(self, lanes: int, length: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 1 << 48, np.int64)
        self.used = np.zeros(lanes, np.int64)
        self.words = np.zeros((length // 2 + 16, lanes), np.uint32)
        self.order: list[np.ndarray] = []  # which word of which lane was given out

    def step(self, begin: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Narrow to shares of ``2**bits``."""
        low, span = self.low[: len(begin)], self.range[: len(begin)]
        unit = span >> bits
        low += unit * begin
        np.multiply(unit, width, out=span)
        small = np.flatnonzero(span < FIRST)
        while len(small):
            place = self.used[small]
            if place.max() >= len(self.words):
                self.words = np.pad(self.words, ((0, len(self.words) // 2), (0, 0)))
            some = low[small]
            self.words[place, small] = some >> 32
            self.order.append(((place + 3) * self.words.shape[1] + small).astype(np.int32))
            self.used[small] = place + 1
            low[small] = (some & MASK) << WORD
            wider = span[small] << WORD
            span[small] = wider
            small = small[wider < FIRST]

    def finish(self) -> np.ndarray:
        """The words of all lanes, carries added."""
        self.words = np.pad(self.words, ((0, 3), (0, 0)))
        lanes = np.arange(len(self.low))
        for _ in range(3):
            self.words[self.used, lanes] = self.low >> 32
            self.used += 1
            self.low = (self.low & MASK) << WORD
        carry = np.zeros(len(self.low), np.uint32)
        for row in self.words[: self.used.max()][::-1]:
            row += carry
            carry = row >> 16
        words = self.words.astype("<u2").ravel()
        return np.concatenate([words[: 3 * len(lanes)], *(words.take(some) for some in self.order)])


def _lanes(values: np.ndarray, lanes: int, length: int) -> np.ndarray:
    """One row per step; the last lane may be short."""
    return np.ascontiguousarray(np.pad(values, (0, lanes * length - len(values))).reshape(lanes, length).T)


def _block(ids: np.ndarray, bound: int) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, "<u2")
    known = np.flatnonzero(np.bincount(ids, minlength=bound))
    named = np.zeros(bound, np.uint16)
    named[known] = np.arange(len(known))
    rank = named.take(ids)
    length = max(min(SHORT_LANE, len(ids)), -(-len(ids) // LANES))
    model, cell = learn(rank, known, length)
    lanes = -(-len(ids) // length)
    full = length - (lanes * length - len(ids))  # steps that the last lane has
    coder = Writer(lanes, length)
    # What a cell's yes and no have of the range; ids share the latter.
    lower = np.concatenate([np.zeros(HIT, np.int64), model.chance << model.bits])
    share = np.concatenate([model.chance << model.bits, UNIT - model.chance])
    below, freq = np.append(model.below, 0), np.append(model.freq, 1)
    for i, (r, c) in enumerate(zip(_lanes(rank, lanes, length), _lanes(cell ^ HIT, lanes, length))):
        active = lanes if i < full else lanes - 1
        said = c[:active].astype(np.int64)
        at = np.where(said < HIT, len(known), r[:active])
        part = share.take(said)
        coder.step(lower.take(said) + part * below.take(at), part * freq.take(at), BITS + model.bits)
    words = coder.finish()
    facts = zlib.compress(model.dump())
    facts += b"\0" * (len(facts) & 1)
    head = HEAD.pack(len(ids), length, len(known) - 1, model.bits, model.slots, len(facts))
    front = head + facts
    return np.concatenate([np.frombuffer(front + struct.pack("<I", zlib.crc32(front)), "<u2"), words])


def _unblock(words: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    data = words.tobytes()
    if len(data) < HEAD.size:
        raise ValueError("A block of token ids is damaged")
    given, length, known, bits, slots, size = HEAD.unpack_from(data)
    end = HEAD.size + size
    if given != n or len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("A block of token ids is damaged")
    facts = zlib.decompressobj().decompress(data[HEAD.size : end])
    lanes = -(-n // length)
    model = Model.load(facts, known + 1, slots)
    at = end // 2 + 2 + 3 * lanes
    if at > len(words):
        raise ValueError("A block of token ids is damaged")
    first = words[at - 3 * lanes : at].reshape(3, lanes).astype(np.int64)
    code = first[0] << 32 | first[1] << 16 | first[2]
    span = np.full(lanes, 1 << 48, np.int64)
    spell = np.repeat(np.arange(len(model.freq), dtype=np.uint16), model.freq)  # the rank that holds each share
    last, prior = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros((length, lanes), np.uint16)
    short = lanes * length - n
    for i in range(length):
        if i == length - short:
            lanes -= 1
            code, span, last, prior = (x[:lanes] for x in (code, span, last, prior))
        candidate, cell = model.candidate(last, _slot(last, prior, slots))
        chance = model.chance.take(cell)
        unit = span >> BITS + bits
        edge = (unit * chance) << bits
        left = code - edge
        hit = left < 0
        unit *= UNIT - chance
        # Both are below 2**49, so that the quotient of the floats has the same whole part.
        share = (left / unit).astype(np.int64)
        rank = np.where(hit, candidate, spell.take(share, mode="clip"))
        code = np.where(hit, code, left - unit * model.below.take(rank))
        span = np.where(hit, edge, unit * model.freq.take(rank))
        small = np.flatnonzero(span < FIRST)
        while len(small):
            if at + len(small) > len(words):
                raise ValueError("A block of token ids is damaged")
            code[small] = code[small] << WORD | words[at : at + len(small)]
            at += len(small)
            wider = span[small] << WORD
            span[small] = wider
            small = small[wider < FIRST]
        out[i, :lanes] = rank
        last, prior = rank, last
    return model.known.astype(np.int32).take(out.T.ravel()[:n])


def encode(blocks: list[np.ndarray], ids: int) -> list[np.ndarray]:
    """Words of each block; ids are below ``ids``."""
    return [_block(block, ids) for block in blocks]


def decode(words: list[np.ndarray], sizes: list[int], ids: int) -> list[np.ndarray]:
    """The blocks again, from their words and sizes."""
    return [_unblock(given, n) for given, n in zip(words, sizes)]
