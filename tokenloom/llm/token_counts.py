"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

The count of a word is its number of bytes less its merges; no token ids are built. A heap holds the
adjacent pairs that can merge, by rank and place; a linked list joins neighbours after a merge.
Words repeat, so each Python worker keeps the counts of up to ``CACHE_WORDS`` words.

Defined results: null or empty text has 0 bytes and 0 tokens; texts of white space only have bytes
and no token; special strings inside a text count as one token each; text is never cut. Repeated
rows are counted each for itself. An empty table gives an empty one. Columns of the input stay
unless they bear the name of a result, which then takes their place.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import word_bpe

CACHE_WORDS = 600_000
_counts: dict[str, dict[str, int]] = {}


def word_tokens(word: str, rule: word_bpe.Rules) -> int:
    """Tokens of one word: initial symbols minus merges."""
    if word[0] == "\0" and word[1:] in rule.special:
        return 1
    data = word.encode()
    n = len(data)
    if n == 1:
        return 1
    symbol = rule.inner[list(data)].tolist()
    symbol[-1] = int(rule.final[data[-1]])
    merges, made = rule.merges, rule.made
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = []
    for i in range(n - 1):
        rank = merges.get(symbol[i] << 32 | symbol[i + 1])
        if rank is not None:
            heap.append((rank, i))
    heapify(heap)
    count = n
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j < 0 or merges.get(symbol[i] << 32 | symbol[j]) != rank:
            continue  # a neighbour has merged since
        symbol[i] = int(made[rank])
        symbol[j] = -1
        count -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            rank = merges.get(symbol[i] << 32 | symbol[k])
            if rank is not None:
                heappush(heap, (rank, i))
        h = before[i]
        if h >= 0:
            rank = merges.get(symbol[h] << 32 | symbol[i])
            if rank is not None:
                heappush(heap, (rank, h))
    return count


class _Counter(dict):
    """Counts of the words seen so far, a missing one worked out when it is asked for."""

    def __init__(self, rule: word_bpe.Rules):
        self.rule = rule

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = word_tokens(word, self.rule)
        return n


def text_tokens(text: str | None, path: str) -> int:
    """Tokens of one whole text."""
    known = _counts.get(path)
    if known is None:
        known = _counts[path] = _Counter(word_bpe.rules(path))
    return sum(map(known.__getitem__, known.rule.words(text))) if text else 0


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        return pa.array([text_tokens(t, path) for t in column.to_pylist()], pa.int64())

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", tokens(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
