"""Operator 2: language identification by language-bitmask n-gram filters.

Letters of a text, lower-cased, with one space for anything between them, give overlapping n-grams.
A bit-sliced Bloom filter holds the n-grams of all languages at once: a place of the filter has one
bit per language, in as many words of 64 as there are languages for, and the AND over an n-gram's
places has the bit of every language that (but for false positives) contains it. Popcounts per
language over a text, less the hits its filter gives by chance, decide.

An n-gram belongs to a language if it is not rare there and its relative frequency is at least
``SHARE`` of the sum over languages; so frequent n-grams may belong to several.

The filters are fitted on a bounded sample: of each language ``SAMPLE_ROWS`` labelled rows or so, by
a hash of the row's id. Every n-gram that belongs to a language is entered: the number of places grows
with the largest language up to 2 to the ``MOST_BITS``, and beyond that false positives grow, which the
correction takes off. Everything else reads whole texts of all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text
if no labelled row exists; rows whose label or id is null are not learned from. Ties go to the first
language in code-point order. Repeated rows get equal results; an empty table gives an empty one. Input
columns stay unless they bear the name of a result. A text of any length is read whole, in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import U, chunks, join_checked, materialize, mix, release

GRAM = 3
SAMPLE_ROWS = 4000  # labelled rows per language, in expectation
MIN_COUNT = 3  # occurrences in the sample below which an n-gram is left out
SHARE = 0.3
FILTER_BITS = 19  # log2 of the filter's places at least; 4 MB for 64 languages
MOST_BITS = 22  # and at most; 32 MB for 64 languages
ROOM = 8  # places for each one that the largest language sets
PROBES = 3
WIDTH = 64  # languages to a word
PIECE = 1 << 18  # letters worked on at once

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter. Built once per Python worker."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            table[lo:hi] = [chr(c).isalpha() for c in range(lo, hi)]
        _letters.append(table)
    return _letters[0]


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, every run of anything else as one 0, with a 0 before and
    after each text; and the bounds of the texts."""
    lowered = ["" if t is None else t.lower() for t in texts]
    joined = "\n" + "".join(t + "\n" for t in lowered)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).copy()
    code[~letter_table()[code]] = 0
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    keep = (code > 0) | np.concatenate([[True], code[:-1] > 0])
    keep[ends] = True  # the newline after each text
    at = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], np.concatenate([[0], at[ends]])


def grams(code: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that begins at each place."""
    n = max(0, len(code) - GRAM + 1)
    out = np.zeros(n, U)
    for i in range(GRAM):
        out = (out << U(21)) ^ (out >> U(43)) ^ code[i : i + n].astype(U)
    return out


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts with a letter in the middle, and the row each belongs to."""
    code, bounds = letters(texts)
    found = grams(code)
    middle = code[GRAM // 2 : GRAM // 2 + len(found)] > 0
    row = np.searchsorted(bounds[1:], np.arange(len(found)) + GRAM // 2, "left")
    return found[middle], row[middle]


def probes(found: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of n-grams in a filter of 2 to the ``bits`` places."""
    mask = U((1 << bits) - 1)
    return [
        (mix(found + U(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) & mask).astype(np.int64)
        for i in range(PROBES)
    ]


def filter_bits(most: int) -> int:
    """For a largest language of ``most`` n-grams."""
    return max(FILTER_BITS, min(MOST_BITS, (ROOM * PROBES * most).bit_length()))


@dataclass
class Filters:
    languages: list[str]
    places: np.ndarray  # per word of languages, a bit per language at each place
    chance: np.ndarray  # probability that a language's filter holds an n-gram by chance

    @classmethod
    def of(cls, languages: list[str], places: np.ndarray) -> Filters:
        fill = [float(((places[b // WIDTH] >> U(b % WIDTH)) & U(1)).mean()) for b in range(len(languages))]
        return cls(languages, places, np.array(fill) ** PROBES)

    @classmethod
    def build(cls, languages: list[str], held: list[np.ndarray]) -> Filters:
        bits = filter_bits(max(map(len, held), default=0))
        places = np.zeros((-(-len(languages) // WIDTH), 1 << bits), U)
        for b, found in enumerate(held):
            for probe in probes(found, bits):
                np.bitwise_or.at(places[b // WIDTH], probe, U(1) << U(b % WIDTH))
        return cls.of(languages, places)

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and how many of them each language's filter holds."""
        found, row = text_grams(texts)
        counts = np.zeros((len(texts), len(self.languages)))
        at = probes(found, self.places.shape[1].bit_length() - 1)
        for w, word in enumerate(self.places):
            held = np.full(len(found), ~U(0))
            for probe in at:
                held &= word[probe]
            for b in range(w * WIDTH, min((w + 1) * WIDTH, len(self.languages))):
                counts[:, b] = np.bincount(row, (held >> U(b % WIDTH)) & U(1), len(texts))
        return np.bincount(row, minlength=len(texts)), counts

    def decide(self, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its score per text. The score is the best language's corrected hit
        rate, less half of the next one's."""
        if not self.languages:
            return np.full(len(n), -1), np.zeros(len(n))
        total = np.maximum(n, 1)[:, None]
        rate = np.clip((counts / total - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = rate.argmax(1)
        ordered = np.sort(rate, 1)
        second = ordered[:, -2] if rate.shape[1] > 1 else np.zeros(len(n))
        score = np.clip(ordered[:, -1] - second / 2, 0, 1)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)


def learned(
    docs: DataFrame, labelled, text: str = "text", lang: str = "lang", row_id: str = "doc_id"
) -> DataFrame:
    """``lang, gram``: the n-grams that belong to each language, written. They are learned from the rows
    for which ``labelled`` holds."""
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(row_id).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(row_id).alias("id"))
    size = materialize(rows.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    draw = F.pmod(F.xxhash64(F.lit("language-sample"), "id"), F.lit(1 << 20)) / (1 << 20)
    sample = join_checked(rows, size, "lang").where(draw < F.lit(SAMPLE_ROWS) / F.col("size")).select("lang", "text")

    def count(batches):
        for batch in (part for whole in batches for part in chunks(whole, "text", PIECE)):
            langs = np.array(batch.column(0).to_pylist(), object)
            for one in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == one)).to_pylist()
                found, n = np.unique(text_grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "language-grams")
    totals = materialize(counted.groupBy("lang").agg(F.sum("n").alias("total")), "language-totals")
    rated = join_checked(counted, totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    per_gram = rated.groupBy("gram").agg(
        F.sum("rate").alias("rates"), F.collect_list(F.struct("lang", "n", "rate")).alias("each")
    )  # at most one entry per language
    own = per_gram.select("gram", "rates", F.explode("each").alias("e")).where(
        (F.col("e.n") >= MIN_COUNT) & (F.col("e.rate") >= SHARE * F.col("rates"))
    )
    return materialize(own.select("e.lang", "gram"), "language-own")


def fit(
    docs: DataFrame,
    labelled,
    text: str = "text",
    lang: str = "lang",
    row_id: str = "doc_id",
) -> Filters:
    """Filters for all languages among the rows for which ``labelled`` holds.

    N-grams are counted, chosen and put in their places by Spark; what reaches the driver is a row per
    language and the places of the filter that are not empty, 2 to the ``MOST_BITS`` at most for 64 languages.
    """
    own = learned(docs, labelled, text, lang, row_id)
    most = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    languages = sorted(most)
    if not languages:
        return Filters.build([], [])
    bits = filter_bits(max(most.values()))
    number = {one: b for b, one in enumerate(languages)}

    def place(batches):
        for batch in batches:
            found = batch.column(1).to_numpy().view(U)
            b = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            mask = (U(1) << (b % WIDTH).astype(U)).view(np.int64)
            for probe in probes(found, bits):
                columns = [pa.array(b // WIDTH), pa.array(probe), pa.array(mask)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "place", "mask"])

    set_ = own.mapInArrow(place, "word long, place long, mask long").groupBy("word", "place").agg(
        F.bit_or("mask").alias("mask")
    ).toArrow()
    places = np.zeros((-(-len(languages) // WIDTH), 1 << bits), U)
    word, at, mask = (set_.column(c).to_numpy() for c in ("word", "place", "mask"))
    places[word, at] = mask.view(U)
    return Filters.of(languages, places)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(column: pa.Array) -> pa.Array:
        own = shared.value
        texts = column.to_pylist()
        n = np.zeros(len(texts), np.int64)
        counts = np.zeros((len(texts), len(own.languages)))
        at = 0
        while at < len(texts):  # by pieces of bounded size
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= PIECE):
                size += len(texts[end] or "") + 1
                end += 1
            if size <= 2 * PIECE:
                n[at:end], counts[at:end] = own.hits(texts[at:end])
            else:  # one very long text; a word cut between pieces ends and begins like any other
                whole = texts[at]
                for lo in range(0, len(whole), PIECE):
                    some, hits = own.hits([whole[lo : lo + PIECE]])
                    n[at] += some[0]
                    counts[at] += hits[0]
            at = end
        release()
        best, score = own.decide(n, counts)
        names = pa.array([own.languages[b] if b >= 0 else "und" for b in best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], ["lang_pred", "score"])

    # So named, it stays one step: a filter on its result would otherwise be pushed below it with a copy of
    # it, and each text be judged twice, by two Python workers a task.
    judged = docs.withColumn("_judged", judge.asNondeterministic()(F.col(text)))
    return judged.withColumn("lang_pred", F.col("_judged.lang_pred")).withColumn(
        "score", F.col("_judged.score")
    ).drop("_judged")
