"""Named queries on manifests, parts and their merge. Languages stand for separately packed parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.chats import judged
from tokenloom.catalog.documents import documents, lengths
from tokenloom.catalog.registry import query
from tokenloom.functions import text
from tokenloom.operators import budget, parts, vocab
from tokenloom.operators.running import running_totals
from tokenloom.operators.shards import (
    assign_shards,
    roll_equal_rows,
    roll_shards,
    shard_file,
    shard_table,
)
from tokenloom.session import materialize
from tokenloom.sources.shards import shard_entries

_PARTS = f"""WITH RECURSIVE {q.DOCS},
keyed AS (SELECT doc_id, n_tokens, text, lang || '/' || split AS k FROM doc),
{q.rolled('keyed', 'k', q.SHARD_LIMIT)}, part_shards AS (
  SELECT split_part(k, '/', 1) AS part, split_part(k, '/', 2) AS split, shard,
         sum(n_tokens)::BIGINT AS tokens, count(*)::BIGINT AS docs,
         flatten(list(list_concat({q.byte_ids(q.neutral('text'))}, [1]) ORDER BY doc_id)) AS ids
  FROM placed GROUP BY k, shard)"""
_NAME = "split || '-' || lpad(shard::VARCHAR, 5, '0') || '.bin'"


def part_placed(spark, sf_dir):
    rows = lengths(spark, sf_dir, "lang").withColumnRenamed("lang", "part")
    return roll_shards(rows, "doc_id", q.SHARD_LIMIT, by=("part", "split"))


def part_shards(spark, sf_dir):
    return shard_table(part_placed(spark, sf_dir), by=("part", "split"))


@query(
    f"""{_PARTS} SELECT part, split, shard, part || '-' || {_NAME} AS file, tokens,
    sha256(unhex(array_to_string(list_transform(ids,
      lambda i: printf('%02X%02X', i % 256, i // 256)), ''))) AS sha256
    FROM part_shards"""
)
def manifest_rows(spark, sf_dir):
    ids = text.with_eos(text.byte_ids(text.neutralize(F.col("text"))))
    docs = documents(spark, sf_dir, "lang").where(text.is_long_enough(F.col("text")))
    rows = docs.select(
        F.col("lang").alias("part"), text.split_of(F.col("text")).alias("split"), "doc_id", ids.alias("tokens")
    )
    rows = assign_shards(rows, part_placed(spark, sf_dir), "doc_id", ("part", "split"))
    return shard_entries(rows, by_part=True).drop("mask", "mask_sha256")


@query(
    f"""{_PARTS} SELECT part || '-' || {_NAME} AS file, part, split, tokens, docs FROM part_shards"""
)
def merge_parts(spark, sf_dir):
    shards = part_shards(spark, sf_dir)
    name = shard_file(F.col("split"), F.col("shard"), F.concat("part", F.lit("-")))
    entries = materialize(shards.select(name.alias("file"), "part", "split", "tokens", "docs"), "entries")
    clash = parts.duplicate_files(entries).limit(1).collect()
    if clash:
        raise ValueError(f"Duplicate shard name across parts: {clash[0]['file']}")
    return entries


@query(
    f"""{_PARTS} SELECT {_NAME} AS file, count(*)::BIGINT AS parts FROM part_shards
    GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_shards(spark, sf_dir):
    """Which shard names would collide if parts were packed without a tag."""
    untagged = part_shards(spark, sf_dir).select(
        shard_file(F.col("split"), F.col("shard")).alias("file")
    )
    return parts.duplicate_files(untagged)


@query(
    f"""WITH {q.DOCS}
    SELECT (sum(n_tokens) FILTER (split = 'train'))::BIGINT AS train,
           (sum(n_tokens) FILTER (split = 'val'))::BIGINT AS val,
           (SELECT count(*) FROM documents WHERE text IS NULL OR length({q.stripped('text')}) < 100)::BIGINT
             AS skipped FROM doc"""
)
def merge_counts(spark, sf_dir):
    t = F.col("text")
    kept = text.is_long_enough(t)
    size = text.byte_count(text.neutralize(t)) + 1
    per_part = (
        documents(spark, sf_dir, "lang")
        .select(
            F.col("lang").alias("part"),
            F.when(kept, text.split_of(t)).otherwise(F.lit("skipped")).alias("split"),
            F.when(kept, size).otherwise(F.lit(1)).alias("n"),
        )
        .groupBy("part")
        .agg(*[F.sum(F.when(F.col("split") == c, F.col("n"))).alias(c) for c in parts.COUNT_FIELDS])
    )
    return parts.merged_counts(per_part)


_USED = f"""used AS (
  SELECT lang AS part, ({q.symbol('h')})::INT AS id FROM (
    SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)
  GROUP BY 1, 2),
tok AS (SELECT part, (count(*) + 6)::BIGINT AS vocab_size,
               sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM used GROUP BY part)"""


@query(
    f"""WITH {_USED}, {q.DOCS},
    names AS (SELECT lang AS part, string_agg(DISTINCT split, ',' ORDER BY split) AS s
              FROM doc GROUP BY lang),
    f AS (SELECT 'vocab_size' AS field, vocab_size::VARCHAR AS v FROM tok
          UNION ALL SELECT 'tokenizer_sha256', digest FROM tok
          UNION ALL SELECT 'split_names', s FROM names
          UNION ALL SELECT 'seq_len', '{q.SEQ_LEN}' FROM tok)
    SELECT field, count(DISTINCT v)::BIGINT AS "values" FROM f GROUP BY field
    HAVING count(DISTINCT v) > 1"""
)
def merge_agreement(spark, sf_dir):
    """Parts that each kept only the byte symbols they use would disagree: on what?"""
    docs = documents(spark, sf_dir, "lang").withColumnRenamed("lang", "part")
    used = (
        docs.select("part", F.explode(F.split(text.latin1(F.col("text")), "")).alias("c"))
        .distinct()
        .select("part", F.get(F.lit(text.byte_symbol_ids()), F.ascii("c")).alias("id"))
    )
    # At most 256 symbols per part are gathered here.
    ids = F.array_sort(F.collect_list("id"))
    tokenizers = used.groupBy("part").agg(
        (F.count(F.lit(1)) + len(text.SPECIALS)).alias("vocab_size"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("tokenizer_sha256"),
    )
    splits = (
        docs.where(text.is_long_enough(F.col("text")))
        .select("part", text.split_of(F.col("text")).alias("split"))
        .distinct()
        .groupBy("part")
        .agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("split_names"))
    )
    described = (
        tokenizers.join(splits, "part", "left")
        .withColumn("version", F.lit(1))
        .withColumn("kind", F.lit("pretrain"))
        .withColumn("seq_len", F.lit(q.SEQ_LEN))
    )
    return parts.disagreements(described, [*parts.AGREED_FIELDS, "split_names"])


_ROLL_ALL = f"WITH RECURSIVE {q.DOCS}, {q.rolled('doc', 'split', q.SHARD_LIMIT)}"


@query(
    f"""WITH RECURSIVE {q.BUDGET},
    keyed AS (SELECT doc_id, n_tokens, 'all/' || split AS k FROM doc
              UNION ALL SELECT doc_id, n_tokens, 'cut/' || split FROM budget),
    {q.rolled('keyed', 'k', q.SHARD_LIMIT)},
    files AS (SELECT DISTINCT split_part(k, '/', 1) AS pack, split_part(k, '/', 2) || '-'
              || lpad(shard::VARCHAR, 5, '0') || '.bin' AS file FROM placed)
    SELECT file FROM files WHERE pack = 'all'
    AND file NOT IN (SELECT file FROM files WHERE pack = 'cut')"""
)
def missing_shards(spark, sf_dir):
    """Shards a manifest of the whole corpus lists that a budgeted pack has not written."""
    rows = lengths(spark, sf_dir)
    cut = budget.token_cut(
        rows, "doc_id", max_tokens=q.MAX_TOKENS, val_tokens=q.VAL_TOKENS, seq_len=q.SEQ_LEN
    )
    name = shard_file(F.col("split"), F.col("shard"))
    names = lambda d: shard_table(roll_shards(d, "doc_id", q.SHARD_LIMIT)).select(name.alias("file"))
    return parts.missing_files(names(rows), names(rows.where(cut.keep("doc_id"))))


_WIDTH = q.CHAT_SEQ_LEN + 1
_ROWS = -(-q.CHAT_SHARD_LIMIT // _WIDTH)


@query(
    f"""WITH RECURSIVE {q.HEADS},
    chat AS (
      SELECT split, (row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1) // {_ROWS} AS shard
      FROM judged WHERE reason IS NULL),
    chats AS (SELECT 'chat-' || {_NAME} AS file, count(*) * {_WIDTH} AS tokens FROM chat
              GROUP BY split, shard),
    {q.DOCS}, {q.rolled('doc', 'split', q.SHARD_LIMIT)},
    docs AS (SELECT {_NAME} AS file, sum(n_tokens) AS tokens FROM placed GROUP BY split, shard)
    SELECT file, 'sft' AS kind, 'ok' AS reason FROM chats
    UNION ALL SELECT file, 'pretrain', 'ok' FROM docs
    UNION ALL SELECT file, 'sft', CASE WHEN tokens % {_WIDTH} <> 0 THEN 'ragged_rows' ELSE 'bad_mask' END
    FROM docs"""
)
def layout_check(spark, sf_dir):
    """Sizes of chat and document shards against their row layout, and documents declared as chat."""
    accepted = judged(spark, sf_dir).where("reason is null")
    ranked = running_totals(accepted, "conv_id", {"nth": F.lit(1)}, ["split"]).withColumn(
        "nth", F.col("nth") - 1
    )
    chats = (
        roll_equal_rows(ranked, "nth", _WIDTH, q.CHAT_SHARD_LIMIT)
        .groupBy("split", "shard")
        .agg((F.count(F.lit(1)) * _WIDTH).alias("tokens"))
        .select(shard_file(F.col("split"), F.col("shard"), "chat-").alias("file"), "tokens")
    )
    docs = shard_table(roll_shards(lengths(spark, sf_dir), "doc_id", q.SHARD_LIMIT)).select(
        shard_file(F.col("split"), F.col("shard")).alias("file"), "tokens"
    )
    both = materialize(
        chats.withColumn("chat", F.lit(True)).unionByName(docs.withColumn("chat", F.lit(False))),
        "shard-sizes",
    )
    mask = F.regexp_replace("file", "bin$", "mask")
    entry = lambda rows, kind: rows.select(
        F.lit(kind).alias("kind"),
        F.lit(q.CHAT_SEQ_LEN).alias("seq_len"),
        "file",
        (mask if kind == "sft" else F.lit(None).cast("string")).alias("mask"),
    )
    entries = (
        entry(both.where("chat"), "sft")
        .unionByName(entry(both.where("not chat"), "pretrain"))
        .unionByName(entry(both.where("not chat"), "sft"))
    )
    files = both.select("file", (F.col("tokens") * 2).alias("bytes")).unionByName(
        both.where("chat").select(mask.alias("file"), F.col("tokens").alias("bytes"))
    )
    return parts.layout_faults(entries, files).select(
        "file", "kind", F.coalesce("reason", F.lit("ok")).alias("reason")
    )
