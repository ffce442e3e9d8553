"""Byte-pair vocabulary: counting, learning, encoding.

Learning works on the table of distinct words, with each symbol as one character, in id order. A
merge is then the built-in ``replace`` (left to right, non-overlapping: exactly the merge rule), and
the string order of a pair is its (left id, right id) order, which breaks ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Container, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import text
from tokenloom.operators.wordcodes import TokenBytes, WordCodes, decoded, encoded
from tokenloom.session import materialize, ship_package

MAX_VOCAB = 65536  # ids are 16 bits wide in shards
MIN_COUNT = 2
# Symbol characters start past quotes, commas and control characters, and skip the surrogates.
SYMBOL_BASE = 0x100
SURROGATES, SURROGATE_COUNT = 0xD800, 0x800
FIRST_BYTE = len(text.SPECIALS)
FIRST_MERGE = FIRST_BYTE + 256

VOCAB_SCHEMA = "token string, id int"
MERGE_SCHEMA = "rank int, left int, right int, new_id int"


@dataclass(frozen=True)
class Vocabulary:
    """``symbols[id]``: bytes of each id (empty for reserved ids); ``merges``: (left, right, new)."""

    symbols: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...] = field(default=())

    def __post_init__(self):
        if len(self.symbols) > MAX_VOCAB:
            raise ValueError("Ids are 16 bits wide: the vocabulary may hold 65,536 entries at most")

    @staticmethod
    def of_bytes() -> "Vocabulary":
        return Vocabulary(tuple(text.byte_symbols()))

    def __len__(self) -> int:
        return len(self.symbols)

    def spelled(self, token: int) -> str:
        if token < FIRST_BYTE:
            return text.SPECIALS[token]
        alphabet = text.byte_alphabet()
        return "".join(alphabet[b] for b in self.symbols[token])

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.spelled(i), i) for i in range(len(self))], VOCAB_SCHEMA
        )

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *m) for rank, m in enumerate(self.merges)]
        return spark.createDataFrame(rows, MERGE_SCHEMA)

    @property
    def longest(self) -> int:
        """Most bytes one id can stand for."""
        return max(len(s) for s in self.symbols)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, ``n`` over whole texts: one shuffle, combined on the map side, hot words included."""
    return (
        texts.select(F.explode(text.words(F.col(text_col))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def as_symbols(word: Column) -> Column:
    """A word as one symbol character per byte."""
    source = "".join(map(chr, range(256)))
    target = "".join(map(symbol_char, text.byte_symbol_ids()))
    return F.translate(text.latin1(word), source, target)


def symbol_char(token: int) -> str:
    point = SYMBOL_BASE + token
    return chr(point if point < SURROGATES else point + SURROGATE_COUNT)


def char_id(symbol: str) -> int:
    point = ord(symbol)
    return point - SYMBOL_BASE - (SURROGATE_COUNT if point > SURROGATES else 0)


def symbol_id(symbol: Column) -> Column:
    """:func:`char_id` as a column function."""
    point = F.ascii(symbol)
    skipped = F.when(point > SURROGATES, F.lit(SURROGATE_COUNT)).otherwise(F.lit(0))
    return (point - SYMBOL_BASE - skipped).cast("int")


def byte_token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``id``, ``n``: how often each byte symbol occurs. At most 256 rows leave a map task."""
    return (
        texts.select(F.explode(F.split(text.latin1(F.col(text_col)), "")).alias("c"))
        .where("c <> ''")
        .groupBy("c")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.get(F.lit(text.byte_symbol_ids()), F.ascii("c")).alias("id"), "n")
    )


def _pairs_in(syms: str) -> str:
    """SQL text: all adjacent symbol pairs of a word."""
    starts = f"if(char_length({syms}) > 1, sequence(1, char_length({syms}) - 1), array())"
    return f"transform({starts}, i -> substring({syms}, i, 2))"


def pair_counts(spelled: DataFrame) -> DataFrame:
    """``pair``, ``n`` from ``syms``, ``n``: adjacent symbols, each weighted by its word's count."""
    cut = spelled.where("char_length(syms) > 1").select(
        "syms", "n", F.expr("explode(sequence(1, char_length(syms) - 1)) as i")
    )
    return (
        cut.groupBy(F.expr("substring(syms, i, 2) as pair"))
        .agg(F.sum("n").alias("n"))
    )


def best_pairs(pairs: DataFrame, k: int, min_count: int = MIN_COUNT) -> DataFrame:
    """Most frequent pairs; ties by left id, then right id."""
    return pairs.where(F.col("n") >= min_count).orderBy(F.desc("n"), F.asc("pair")).limit(k)


def learn(
    counts: DataFrame,
    vocab_size: int,
    min_count: int = MIN_COUNT,
    rewrite_every: int = 512,
    ranking: int = 20_000,
) -> Vocabulary:
    """Learn merges from ``word``, ``n`` until the vocabulary has ``vocab_size`` entries.

    One full pair count gives a ranking of bounded length. From then on each round sends back only
    what its merges changed, counted over the words that hold a merged pair, which the occurrence
    index (:class:`_Index`) names; a new full count is due when the ranking is used up. Every
    ``rewrite_every`` merges the merged words are written out and indexed anew, which bounds the
    work per word and ends the lineage, and words that became equal are joined.
    """
    if not FIRST_MERGE <= vocab_size <= MAX_VOCAB:
        raise ValueError(f"vocab_size must lie between {FIRST_MERGE} and {MAX_VOCAB}")
    symbols = list(text.byte_symbols())
    known = {s: i for i, s in enumerate(symbols) if s}
    merges: list[tuple[int, int, int]] = []
    index = _Index(counts.select(as_symbols(F.col("word")).alias("syms"), "n"), len(symbols))
    ranked: _Ranking | None = None

    def joined(pair: str) -> bytes:
        return b"".join(symbols[char_id(c)] for c in pair)

    try:
        while len(symbols) < vocab_size:
            room = vocab_size - len(symbols)
            taken = ranked.independent(room, joined, known) if ranked else []
            if not taken:
                best = best_pairs(pair_counts(index.current()), ranking, min_count)
                ranked = _Ranking(best, ranking, min_count)
                taken = ranked.independent(room, joined, known)
            if not taken:
                raise ValueError("The text repeats too few pairs for so large a vocabulary")
            step, remade = [], False
            for pair in taken:
                left, right = map(char_id, pair)
                made = joined(pair)
                new = known.setdefault(made, len(symbols))
                if new == len(symbols):
                    symbols.append(made)
                else:
                    remade = True
                merges.append((left, right, new))
                step.append((pair, symbol_char(new)))
            if len(symbols) == vocab_size:
                break
            # A symbol made again may raise counts the ranking does not hold: count anew.
            if remade:
                ranked = None
            else:
                ranked.update(index.changes(step).collect(), {new for _, new in step})
            index.apply(step)
            if len(index.pending) >= rewrite_every:
                index.rewrite(len(symbols))
    finally:
        index.close()
    return Vocabulary(tuple(symbols), tuple(merges))


class _Index:
    """Distinct words, and for every pair of symbols the words that hold it.

    Both are written when words are spelled anew. Merges made since (``pending``) are not written
    back: a word's present spelling is its written one with those merges applied, and only words
    that a round looks up are spelled out. A pair with a symbol made since then occurs only in words
    that held a pair the symbol was made of, so written pairs (its cover) name the words of every
    pair. Index rows carry the word, sorted by pair: a round reads the
    batches that hold its cover alone.
    """

    def __init__(self, words: DataFrame, base: int):
        self._write(words, base)

    def _write(self, words: DataFrame, base: int) -> None:
        self.words = materialize(words, "words")
        rows = self.words.select(F.explode(F.array_distinct(F.expr(_pairs_in("syms")))).alias("pair"), "syms", "n")
        tasks = min(4 * rows.sparkSession.sparkContext.defaultParallelism, self.words.count() // WORDS_PER_TASK + 1)
        # Dealt by word, so that the words of one pair spread over all tasks.
        laid = rows.repartition(tasks, "syms").sortWithinPartitions("pair")
        self.rows = materialize(laid, "pair-index").persist()
        self.base = base  # symbols that the written words know
        self.made: dict[int, set[str]] = {}  # symbol made since: the written pairs it came from
        self.pending: list[tuple[str, str]] = []

    def cover(self, pair: str) -> set[str]:
        """Written pairs of which every word that now holds ``pair`` held one."""
        left, right = map(char_id, pair)
        if left >= self.base:
            return self.made[left]
        if right >= self.base:
            return self.made[right]
        return {pair} | self.made.get(left, set()) | self.made.get(right, set())

    def current(self) -> DataFrame:
        """``syms``, ``n``: every word as it is spelled now."""
        return self.words.select(F.expr(_merged("syms", self.pending)).alias("syms"), "n")

    def changes(self, step: Sequence[tuple[str, str]]) -> DataFrame:
        """Count changes of all pairs in the words that a step of merges touches.

        At most a few rows per merge and vocabulary entry come back: changed pairs hold a merged
        symbol. A word found by several pairs counts at the first one. Generators keep spellings
        from being worked out twice, and pairs are cut by compiled code.
        """
        cover = sorted(set().union(*(self.cover(pair) for pair, _ in step)))
        found = self.rows.where(F.col("pair").isin(cover))
        if len(cover) > 1:
            names = ", ".join(f"'{pair}'" for pair in cover)
            found = found.where(F.expr(f"element_at(filter(array({names}), p -> contains(syms, p)), 1) = pair"))
        spelled = found.select("n", F.explode(F.array(F.expr(_merged("syms", self.pending)))).alias("w"))
        touched = spelled.where(" or ".join(f"contains(w, '{pair}')" for pair, _ in step))
        sides = touched.select(
            F.expr(f"inline(array(struct(w as s, -n as by), struct({_merged('w', step)} as s, n as by)))")
        ).where("char_length(s) > 1")
        pairs = sides.select("s", "by", F.expr("explode(sequence(1, char_length(s) - 1)) as i"))
        return (
            pairs.groupBy(F.expr("substring(s, i, 2) as pair"))
            .agg(F.sum("by").alias("n"))
            .where("n != 0")
        )

    def apply(self, step: Sequence[tuple[str, str]]) -> None:
        for pair, new in step:
            self.made.setdefault(char_id(new), set()).update(self.cover(pair))
        self.pending += step

    def rewrite(self, base: int) -> None:
        same = self.current().where(F.char_length("syms") > 1).groupBy("syms")
        before = self.rows
        self._write(same.agg(F.sum("n").alias("n")), base)
        before.unpersist()

    def close(self) -> None:
        self.rows.unpersist()


class _Ranking:
    """Most frequent pairs with exact counts, and the rank below which other pairs may hide.

    Pairs left out only ever lose occurrences, unless a new symbol takes part; those pairs are
    complete in the changes of the round that makes the symbol.
    """

    def __init__(self, best: DataFrame, size: int, min_count: int):
        rows = [(r["pair"], r["n"]) for r in best.collect()]
        self.min_count = min_count
        self.counts = dict(rows)
        self.last = (-rows[-1][1], rows[-1][0]) if len(rows) == size else None

    def independent(
        self, room: int, made: Callable[[str], bytes] = str.encode, known: Container[bytes] = ()
    ) -> list[str]:
        """The next merges that are certain: the longest such prefix of the ranking.

        Merging ``(a, b)`` takes occurrences only from pairs that end in ``a`` or start with ``b``,
        so the prefix ends before the first pair that an earlier one touches. A pair that a merge
        creates counts at most as much as such a touched pair and loses every tie, as its new
        symbol has the highest id; so it cannot belong before the end of the prefix either. That
        does not hold for a symbol made again (``made`` gives its bytes), which ends the prefix too.
        """
        best = heapq.nsmallest(
            256, ((-n, p) for p, n in self.counts.items() if n >= self.min_count)
        )
        lefts: set[str] = set()
        rights: set[str] = set()
        fresh: set[bytes] = set()
        taken: list[str] = []
        for key in best:
            left, right = key[1]
            hidden = self.last is not None and key > self.last
            if hidden or len(taken) == room or right in lefts or left in rights:
                break
            taken.append(key[1])
            symbol = made(key[1])
            if symbol in known or symbol in fresh:
                break
            fresh.add(symbol)
            lefts.add(left)
            rights.add(right)
        return taken

    def update(self, changes, new_symbols: set[str]) -> None:
        """Take in the changes of a round. Counts only fall from here on, so a pair that ranks
        below the least one known, or occurs too rarely, is dropped for good."""
        for row in changes:
            pair, n = row["pair"], row["n"]
            if pair in self.counts:
                n += self.counts[pair]
            elif new_symbols.isdisjoint(pair):
                continue
            if n < self.min_count or (self.last is not None and (-n, pair) > self.last):
                self.counts.pop(pair, None)
            else:
                self.counts[pair] = n


WORDS_PER_TASK = 25_000


def _merged(syms: str, merges: Sequence[tuple[str, str]]) -> str:
    """SQL text that applies merges in order. Symbols hold no quote; the merges are two literals, so
    the compiled code is the same in every round."""
    if not merges:
        return syms
    pairs, news = (", ".join(f"'{x}'" for x in side) for side in zip(*merges))
    step = f"replace(s, element_at(array({pairs}), i), element_at(array({news}), i))"
    return f"aggregate(sequence(1, {len(merges)}), {syms}, (s, i) -> {step})"


def _merge_word(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked merge until none applies; a heap keeps very long words cheap."""
    size = len(ids)
    after = list(range(1, size + 1))
    prior = list(range(-1, size - 1))
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < size:
            pair = (ids[at], ids[after[at]])
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair][0], at, pair))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, at, pair = heapq.heappop(heap)
        nxt = after[at]
        if nxt >= size or (ids[at], ids[nxt]) != pair:
            continue
        ids[at], ids[nxt] = ranks[pair][1], -1
        after[at] = after[nxt]
        if after[at] < size:
            prior[after[at]] = at
        offer(prior[at])
        offer(at)
    return [i for i in ids if i >= 0]


SHORT_WORD = 64  # symbols up to which words are merged side by side
NEVER = np.iinfo(np.int64).max


class _Merger:
    """Applies a vocabulary's merges to many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right, new) in enumerate(vocabulary.merges):
            ranks.setdefault((left, right), (rank, new))
        self.ranks = ranks
        keys = np.array([left << 32 | right for left, right in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank, self.new = np.array(list(ranks.values()), np.int64)[order].T
        self.byte_ids = np.array(text.byte_symbol_ids(), np.int64)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and how many each has."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        long = sizes[word] > SHORT_WORD
        ended = [self._side_by_side(ids[~long], word[~long])]
        for w in np.flatnonzero(sizes > SHORT_WORD):
            whole = _merge_word(self.byte_ids[list(raw[w])].tolist(), self.ranks)
            ended.append((np.array(whole, np.int64), np.full(len(whole), w)))
        ids, word = (np.concatenate(x) for x in zip(*ended))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def _side_by_side(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge per word and pass, the first place of its lowest rank; ``word`` ascends."""
        done = [(ids[:0], word[:0])]
        while len(ids):
            key = np.append(ids[:-1] << 32 | ids[1:], 0)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ends = np.append(word[1:] != word[:-1], True)
            rank = np.where((self.keys[at] == key) & ~ends, self.rank[at], NEVER)
            start = np.flatnonzero(np.append(True, ends[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            open_ = best < NEVER
            done.append((ids[~open_], word[~open_]))
            found = np.flatnonzero(open_ & (rank == best))
            first = np.append(True, word[found[1:]] != word[found[:-1]])[: len(found)]
            found = found[first]
            ids[found] = self.new[at[found]]
            open_[found + 1] = False
            ids, word = ids[open_], word[open_]
        ids, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]


@lru_cache(maxsize=4)
def _word_codes(vocabulary: Vocabulary) -> WordCodes:
    """One dictionary of words per vocabulary and worker, of some 30 MB at most."""
    return WordCodes(_Merger(vocabulary).spell, most_words=1 << 17, most_ids=1 << 21)


def encoder(spark: SparkSession, vocabulary: Vocabulary):
    """Column function text -> ``array<int>``.

    Without merges the byte tokenizer stays in the JVM. Otherwise the JVM splits words and an Arrow
    UDF gathers their ids, with the vocabulary from a broadcast, which the 16-bit id range bounds at
    65,536 entries.
    """
    if not vocabulary.merges:
        return text.byte_ids
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield from encoded(_word_codes(shared.value), words)

    return lambda value: encode(text.words(value))


@lru_cache(maxsize=4)
def _token_bytes(vocabulary: Vocabulary) -> TokenBytes:
    return TokenBytes(vocabulary.symbols)


def decoder(spark: SparkSession, vocabulary: Vocabulary):
    """Column function ``array<int>`` -> text, for ids of any vocabulary.

    Bytes are gathered per text, so a character that several ids share comes out whole; what a cut
    leaves of one becomes the replacement character. Reserved ids have no text.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield from decoded(_token_bytes(shared.value), ids)

    return lambda ids: F.make_valid_utf8(decode(ids).cast("string"))
