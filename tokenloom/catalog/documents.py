"""Named queries on documents: filters, split, budgets, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.registry import query
from tokenloom.functions import text
from tokenloom.operators import budget
from tokenloom.operators.running import first_crossings, running_totals
from tokenloom.session import materialize
from tokenloom.sources.documents import (
    file_slices,
    read_documents,
    seeded_order,
    shuffled,
)


def documents(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    return read_documents(spark, f"{sf_dir}/documents.parquet", also=also)


def measured(docs: DataFrame, *also: str) -> DataFrame:
    """Kept documents as ``doc_id``, ``split``, ``n_tokens`` (byte tokens with end mark)."""
    t = F.col("text")
    return docs.where(text.is_long_enough(t)).select(
        "doc_id",
        *also,
        text.split_of(t).alias("split"),
        (text.byte_count(text.neutralize(t)) + 1).alias("n_tokens"),
    )


def lengths(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """:func:`measured`, written once: the later passes read three small columns."""
    return materialize(measured(documents(spark, sf_dir, *also), *also), "lengths")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def scan_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.byte_count(F.col("text")).alias("bytes"))


@query(
    f"SELECT doc_id, length({q.stripped('text')})::BIGINT AS chars FROM documents "
    f"WHERE length({q.stripped('text')}) >= 100"
)
def filter_min_length(spark, sf_dir):
    kept = documents(spark, sf_dir).where(text.is_long_enough(F.col("text")))
    return kept.select("doc_id", F.length(text.strip(F.col("text"))).cast("bigint").alias("chars"))


@query(
    """WITH f AS (SELECT source AS file, count(*)::BIGINT AS docs FROM documents GROUP BY source),
    i AS (SELECT *, row_number() OVER (ORDER BY file) - 1 AS k, count(*) OVER () AS n FROM f)
    SELECT file, docs, s::INT AS slice FROM i, range(6) r(s)
    WHERE k >= (n * s) // 6 AND k < (n * (s + 1)) // 6"""
)
def file_slice(spark, sf_dir):
    listing = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .groupBy(F.col("source").alias("file"))
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    return file_slices(listing, 6, "file").select("file", "docs", "slice")


@query(f"SELECT doc_id, sha256('{q.SEED}:' || doc_id) AS sort_key FROM documents ORDER BY sort_key")
def seeded_shuffle(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return ids.withColumn("sort_key", seeded_order("doc_id", q.SEED)).orderBy("sort_key")


# The given texts hold no reserved token, so two are written over frequent letters first.
_MARKED = "replace(replace(text, 'an', '<|eos|>'), 'er', '<|user|><|pad|>')"


@query(f"SELECT doc_id, {q.neutral(_MARKED)} AS text FROM documents")
def neutralize_specials(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.neutralize(F.expr(_MARKED)).alias("text"))


@query(
    f"""WITH {q.DOCS}, run AS (
      SELECT doc_id, n_tokens, ('0x' || substr(sha256('{q.SEED}:' || doc_id), 1, 15))::BIGINT AS place FROM doc),
    total AS (SELECT *, sum(n_tokens) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM run)
    SELECT doc_id, place FROM total WHERE upto - n_tokens < {q.MAX_TOKENS}"""
)
def seeded_budget(spark, sf_dir):
    """The documents a token budget takes when they are read in seeded order."""
    rows = materialize(shuffled(lengths(spark, sf_dir).withColumn("id", F.col("doc_id")), "doc_id", q.SEED), "seeded")
    last = first_crossings(rows, "doc_id", {"tokens": ("n_tokens", q.MAX_TOKENS)}).first()["tokens_at"]
    kept = rows if last is None else rows.where(F.col("doc_id") <= last)
    return kept.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("place"))


@query(f"SELECT doc_id, {q.bucket('text')} AS bucket FROM documents")
def holdout_bucket(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", text.holdout_bucket(F.col("text")).alias("bucket"))


@query(f"SELECT doc_id, {q.split('text')} AS split FROM documents")
def holdout_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.split_of(F.col("text")).alias("split"))


@query(
    f"""WITH k AS (SELECT {q.collapsed('substr(text, 1, 4096)')} AS key, {q.split('text')} AS split
                   FROM documents),
    g AS (SELECT key, count(*) AS docs, count(DISTINCT split) AS splits FROM k GROUP BY key)
    SELECT count(*)::BIGINT AS keys, sum(docs)::BIGINT AS docs,
           (count(*) FILTER (splits > 1))::BIGINT AS leaking FROM g"""
)
def split_leakage(spark, sf_dir):
    t = F.col("text")
    # The digest stands for the key, so the shuffle carries 32 bytes instead of 4,096 characters.
    keyed = documents(spark, sf_dir).select(
        F.sha2(text.split_key(t), 256).alias("key"), text.split_of(t).alias("split")
    )
    per_key = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("split") == "val").alias("held_out")
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("docs").alias("docs"),
        F.count_if((F.col("held_out") > 0) & (F.col("held_out") < F.col("docs"))).alias("leaking"),
    )


@query(
    f"""WITH {q.DOCS}
    SELECT split, sum(n_tokens)::BIGINT AS tokens, count(*)::BIGINT AS docs FROM doc GROUP BY split
    UNION ALL
    SELECT 'skipped', 0::BIGINT, count(*)::BIGINT FROM documents
    WHERE text IS NULL OR length({q.stripped('text')}) < 100"""
)
def split_counts(spark, sf_dir):
    t = F.col("text")
    kept = text.is_long_enough(t)
    size = text.byte_count(text.neutralize(t)) + 1
    return (
        documents(spark, sf_dir)
        .select(
            F.when(kept, text.split_of(t)).otherwise(F.lit("skipped")).alias("split"),
            F.when(kept, size).otherwise(F.lit(0)).alias("n"),
        )
        .groupBy("split")
        .agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    )


@query(
    f"""WITH {q.DOCS}
    SELECT doc_id, split, n_tokens, sum(n_tokens) OVER
           (PARTITION BY split ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM doc"""
)
def running_tokens(spark, sf_dir):
    rows = running_totals(lengths(spark, sf_dir), "doc_id", {"running": "n_tokens"}, ["split"])
    return rows.select("doc_id", "split", "n_tokens", "running")


@query(
    f"""WITH {q.DOCS}, r AS (
      SELECT doc_id, n_tokens, sum(n_tokens) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s
      FROM doc WHERE split = 'val')
    SELECT doc_id, n_tokens FROM r WHERE s - n_tokens < {q.VAL_TOKENS}"""
)
def val_budget(spark, sf_dir):
    val = lengths(spark, sf_dir).where("split = 'val'")
    cut = budget.token_cut(
        val, "doc_id", max_tokens=1, val_tokens=q.VAL_TOKENS, seq_len=q.SEQ_LEN
    )
    return val.where(cut.keep("doc_id")).select("doc_id", "n_tokens")


@query(
    f"""WITH {q.BUDGET}
    SELECT split, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens,
           max(doc_id) AS last_doc FROM budget GROUP BY split"""
)
def token_budget_pack(spark, sf_dir):
    rows = lengths(spark, sf_dir)
    cut = budget.token_cut(
        rows, "doc_id", max_tokens=q.MAX_TOKENS, val_tokens=q.VAL_TOKENS, seq_len=q.SEQ_LEN
    )
    return (
        rows.where(cut.keep("doc_id"))
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.sum("n_tokens").alias("tokens"),
            F.max("doc_id").alias("last_doc"),
        )
    )


@query(
    f"""WITH s AS (SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents
      WHERE length({q.stripped('text')}) >= 100 AND {q.bucket('text')} <> 0),
    r AS (SELECT *, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT doc_id, n_chars FROM r WHERE run - n_chars < {q.MAX_CHARS}"""
)
def tokenizer_sample(spark, sf_dir):
    t = F.col("text")
    sampled = documents(spark, sf_dir).where(text.is_long_enough(t)).where(text.split_of(t) == "train")
    rows = materialize(
        sampled.select("doc_id", F.length(t).cast("bigint").alias("n_chars")), "sample-lengths"
    )
    last = budget.chars_cut(rows, "doc_id", q.MAX_CHARS)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


@query(f"SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {q.MAX_DOCS}")
def max_docs_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    last = budget.first_rows_cut(docs, "doc_id", q.MAX_DOCS)
    return docs if last is None else docs.where(F.col("doc_id") <= last)


_PER_LANG = 100_000
_VAL_PER_LANG = 3_000


@query(
    f"""WITH {q.DOCS}, run AS (
      SELECT *, sum(CASE WHEN split = 'train' THEN n_tokens ELSE 0 END) OVER w AS train_run,
             sum(CASE WHEN split = 'val' THEN n_tokens ELSE 0 END) OVER w AS val_run
      FROM doc WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
    capped AS (SELECT *, split = 'train' OR val_run - n_tokens < {_VAL_PER_LANG} AS in_cap FROM run),
    kept_run AS (SELECT *, sum(CASE WHEN split = 'val' AND in_cap THEN n_tokens ELSE 0 END)
      OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS val_kept FROM capped),
    stop AS (SELECT lang, min(doc_id) FILTER (train_run >= {_PER_LANG}
      AND val_kept >= {q.SEQ_LEN + 1}) AS stop_at FROM kept_run GROUP BY lang)
    SELECT lang, split, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens
    FROM kept_run JOIN stop USING (lang)
    WHERE in_cap AND (stop_at IS NULL OR doc_id <= stop_at) GROUP BY lang, split"""
)
def source_mix(spark, sf_dir):
    rows = lengths(spark, sf_dir, "lang")
    cuts = budget.token_cuts(
        rows,
        "doc_id",
        max_tokens=_PER_LANG,
        val_tokens=_VAL_PER_LANG,
        seq_len=q.SEQ_LEN,
        by=["lang"],
    )
    kept = budget.apply_cuts(rows, cuts, "doc_id", ["lang"])
    return kept.groupBy("lang", "split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")
    )
