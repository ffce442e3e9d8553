"""Learn and freeze a vocabulary from the training side of a document sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.operators import budget, vocab
from tokenloom.plans.documents import ORD, first_docs
from tokenloom.session import materialize, scratch
from tokenloom.sources import tokenizer_file
from tokenloom.sources.documents import require_no_null_text


def sample(docs: DataFrame, max_chars: int | None = None, max_docs: int | None = None) -> DataFrame:
    """Raw texts to learn from: long enough, not held out, up to ``max_chars`` characters if named."""
    t = F.col("text")
    docs = docs.where(first_docs(docs, max_docs))
    rows = docs.where(text.is_long_enough(t)).where(text.split_of(t) == "train")
    last = None
    if max_chars is not None:
        sizes = rows.select(ORD, F.length(t).cast("bigint").alias("n_chars"))
        last = budget.chars_cut(materialize(sizes, "sample-lengths"), ORD, max_chars)
    read = F.lit(True) if last is None else F.col(ORD) <= last
    require_no_null_text(docs.where(read))
    return rows.where(read)


def learn_tokenizer(
    docs: DataFrame,
    out: str,
    vocab_size: int = 32_768,
    max_chars: int | None = None,
    max_docs: int | None = None,
) -> tuple[vocab.Vocabulary, str]:
    """Learn from a sample, write ``tokenizer.json`` to a new folder, give vocabulary and hash."""
    with scratch(docs.sparkSession):
        counts = vocab.word_counts(sample(docs, max_chars, max_docs))
        learned = vocab.learn(counts, vocab_size)
    digest = tokenizer_file.save(
        learned,
        out,
        {"vocab_size": vocab_size, "max_chars": max_chars, "max_docs": max_docs},
    )
    return learned, digest
