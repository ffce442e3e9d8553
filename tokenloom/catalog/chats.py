"""Named queries on conversations: grammar, dedup, template, mask, budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.registry import query
from tokenloom.functions import chat, text
from tokenloom.operators import budget
from tokenloom.operators import conversations as convs
from tokenloom.operators.dedup import first_per_key
from tokenloom.session import materialize


def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text"
    )


def judged(spark, sf_dir):
    return materialize(convs.judged(turns(spark, sf_dir), q.CHAT_SEQ_LEN), "judged")


def examples(spark, sf_dir):
    accepted = judged(spark, sf_dir).where("reason is null")
    return convs.examples(turns(spark, sf_dir), accepted, q.CHAT_SEQ_LEN, convs.byte_bodies())


def joined(ids):
    """Ids as decimal numbers with commas. The JSON writer makes no string for each of them."""
    return F.btrim(F.to_json(ids), F.lit("[]"))


@query(
    """SELECT conv_id, count(*)::INT AS messages,
           string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS body
    FROM conversations GROUP BY conv_id"""
)
def assemble_conversations(spark, sf_dir):
    rows = turns(spark, sf_dir)
    line = lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["text"], F.lit("")))
    return convs.assemble(rows, None, [F.col("role"), F.col("text")]).select(
        "conv_id",
        F.size("messages").alias("messages"),
        F.array_join(F.transform("messages", line), "\n").alias("body"),
    )


@query(
    f"""WITH {q.HEADS} SELECT conv_id, prompt, {q.collapsed('prompt')} AS key, split FROM heads"""
)
def first_prompt(spark, sf_dir):
    return convs.heads(turns(spark, sf_dir)).select(
        "conv_id", "prompt", text.collapse(F.col("prompt")).alias("key"), "split"
    )


@query(
    f"""SELECT doc_id, {q.bucket('text')} AS bucket FROM documents
    QUALIFY row_number() OVER (PARTITION BY {q.bucket('text')}, source ORDER BY doc_id) = 1"""
)
def first_per_bucket(spark, sf_dir):
    """First document of each hold-out bucket and source: keys that repeat many times."""
    t = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keyed = docs.select("doc_id", "source", text.holdout_bucket(t).alias("bucket"))
    return keyed.join(
        first_per_key(keyed, ["bucket", "source"], "doc_id"), "doc_id", "left_semi"
    ).select("doc_id", "bucket")


@query(f"WITH {q.HEADS} SELECT conv_id, split FROM heads WHERE is_first")
def dedup_first_prompt(spark, sf_dir):
    heads = convs.heads(turns(spark, sf_dir)).select("conv_id", "key", "split")
    return heads.join(first_per_key(heads, ["key"], "conv_id"), "conv_id", "left_semi").select(
        "conv_id", "split"
    )


@query(
    f"""WITH {q.HEADS} SELECT conv_id, regexp_full_match(shape, 's?(ua)+') AND filled AS valid FROM heads"""
)
def valid_conversations(spark, sf_dir):
    return convs.shapes(turns(spark, sf_dir)).select(
        "conv_id", (F.col("grammar") & F.col("filled")).alias("valid")
    )


@query(
    f"""WITH {q.HEADS} SELECT coalesce(reason, 'accepted') AS reason, count(*)::BIGINT AS conversations
    FROM judged GROUP BY 1"""
)
def reject_reasons(spark, sf_dir):
    return (
        convs.judged(turns(spark, sf_dir), q.CHAT_SEQ_LEN)
        .groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("conversations"))
    )


@query(
    f"""WITH {q.HEADS}
    SELECT split, count(*)::BIGINT AS conversations FROM judged WHERE reason IS NULL GROUP BY split
    UNION ALL SELECT 'skipped', count(*)::BIGINT FROM judged WHERE reason IS NOT NULL"""
)
def sft_counts(spark, sf_dir):
    label = F.when(F.col("reason").isNull(), F.col("split")).otherwise(F.lit("skipped"))
    return (
        convs.judged(turns(spark, sf_dir), q.CHAT_SEQ_LEN)
        .groupBy(label.alias("split"))
        .agg(F.count(F.lit(1)).alias("conversations"))
    )


@query(
    f"""WITH {q.EXAMPLES}
    SELECT conv_id, n_tokens, sha256({q.joined('ids')}) AS tokens, sha256({q.joined('mask')}) AS mask,
           len(ids)::INT AS width FROM padded"""
)
def sft_examples(spark, sf_dir):
    return examples(spark, sf_dir).select(
        "conv_id",
        "n_tokens",
        F.sha2(joined(F.col("tokens")), 256).alias("tokens"),
        F.sha2(joined(F.col("mask")), 256).alias("mask"),
        F.size("tokens").alias("width"),
    )


@query(
    f"""WITH {q.EXAMPLES}
    SELECT conv_id, list_sum(mask[2:])::BIGINT AS supervised,
           (len(mask) - n_tokens)::BIGINT AS padding FROM padded"""
)
def sft_mask_stats(spark, sf_dir):
    return examples(spark, sf_dir).select(
        "conv_id",
        chat.supervised(F.col("mask")).cast("bigint").alias("supervised"),
        (F.size("mask") - F.col("n_tokens")).cast("bigint").alias("padding"),
    )


@query(
    f"""WITH {q.HEADS}, run AS (
      SELECT *, sum((reason IS NULL AND split = 'train')::INT) OVER w AS train_run,
             sum((reason IS NULL AND split = 'val')::INT) OVER w AS val_run
      FROM judged WINDOW w AS (ORDER BY conv_id ROWS UNBOUNDED PRECEDING)),
    stop AS (SELECT min(conv_id) AS stop_at FROM run WHERE train_run >= {q.MAX_EXAMPLES} AND val_run > 0)
    SELECT CASE WHEN reason IS NULL THEN split ELSE 'skipped' END AS split,
           count(*)::BIGINT AS conversations, max(conv_id) AS last_conv
    FROM run, stop WHERE stop_at IS NULL OR conv_id <= stop_at GROUP BY 1"""
)
def sft_budget(spark, sf_dir):
    rows = judged(spark, sf_dir)
    cut = budget.example_cut(rows.where("reason is null"), "conv_id", q.MAX_EXAMPLES)
    label = F.when(F.col("reason").isNull(), F.col("split")).otherwise(F.lit("skipped"))
    return (
        rows.where(cut.read("conv_id"))
        .groupBy(label.alias("split"))
        .agg(F.count(F.lit(1)).alias("conversations"), F.max("conv_id").alias("last_conv"))
    )
