"""Named queries on shards, blocks, block order and corpus mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.chats import examples, joined
from tokenloom.catalog.documents import documents, lengths
from tokenloom.catalog.registry import query
from tokenloom.functions import text
from tokenloom.functions.schedule import Schedule
from tokenloom.operators import blocks, mix
from tokenloom.operators.order import EpochOrder, in_epoch_order
from tokenloom.operators.shards import assign_shards, roll_shards, shard_table
from tokenloom.session import materialize

_ROLLED = f"WITH RECURSIVE {q.DOCS}, {q.rolled('doc', 'split', q.SHARD_LIMIT)}"
_SHARDS = f"""{_ROLLED}, shards AS (
  SELECT split, shard, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens,
         greatest(0, (sum(n_tokens)::BIGINT - 1) // {q.SEQ_LEN})::BIGINT AS blocks
  FROM placed GROUP BY split, shard)"""
_RANGES = f"""{_SHARDS}, ranges AS (
  SELECT *, (sum(blocks) OVER (PARTITION BY split ORDER BY shard ROWS UNBOUNDED PRECEDING)
             - blocks)::BIGINT AS first_block FROM shards)"""
_INDEXED = f"""{_RANGES}, indexed AS (
  SELECT split, shard, unnest(range(blocks)) AS block,
         first_block + unnest(range(blocks)) AS block_index FROM ranges)"""

# An order written out, so SQL can follow it; drawn orders are tested against NumPy instead.
_FACTOR = 1_000_003
_SHIFT = 12_345


def placed(spark, sf_dir):
    return materialize(roll_shards(lengths(spark, sf_dir), "doc_id", q.SHARD_LIMIT), "placed")


def shards(spark, sf_dir):
    return materialize(shard_table(placed(spark, sf_dir)), "shards")


def cut(spark, sf_dir):
    """Blocks of the whole corpus."""
    t = F.col("text")
    docs = documents(spark, sf_dir).where(text.is_long_enough(t))
    docs = docs.select("doc_id", text.split_of(t).alias("split"), text.neutralize(t).alias("text"))
    sharded = assign_shards(docs, placed(spark, sf_dir), "doc_id")
    laid = blocks.offsets_in_shards(sharded, "doc_id", text.byte_count(t) + 1)
    return blocks.cut_blocks(laid.withColumn("ids", text.with_eos(text.byte_ids(t))), q.SEQ_LEN)


def indexed(spark, sf_dir):
    """``split``, ``shard``, ``block``, ``block_index`` of every usable block, without its tokens."""
    ranges = blocks.block_starts(shards(spark, sf_dir), q.SEQ_LEN)
    return ranges.where("blocks > 0").select(
        "split",
        "shard",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        "first_block",
    ).select("split", "shard", "block", (F.col("first_block") + F.col("block")).alias("block_index"))


@query(f'{_ROLLED} SELECT doc_id, split, n_tokens, shard, "offset" FROM placed')
def shard_roll(spark, sf_dir):
    return roll_shards(lengths(spark, sf_dir), "doc_id", q.SHARD_LIMIT)


@query(f"{_SHARDS} SELECT split, shard, docs, tokens, blocks FROM shards")
def usable_blocks(spark, sf_dir):
    return shards(spark, sf_dir).withColumn(
        "blocks", blocks.usable_blocks(F.col("tokens"), q.SEQ_LEN)
    )


@query(
    f"""{_INDEXED}, flat AS (
      SELECT split, shard, flatten(list(list_concat({q.byte_ids(q.neutral('text'))}, [1])
             ORDER BY doc_id)) AS ids FROM placed GROUP BY split, shard)
    SELECT split, shard, block,
           sha256({q.joined(f'ids[block * {q.SEQ_LEN} + 1 : block * {q.SEQ_LEN} + {q.SEQ_LEN + 1}]')}) AS tokens
    FROM indexed JOIN flat USING (split, shard)"""
)
def pack_blocks(spark, sf_dir):
    return cut(spark, sf_dir).select(
        "split", "shard", "block", F.sha2(joined(F.col("tokens")), 256).alias("tokens")
    )


@query(
    f"""{_RANGES} SELECT split, i AS block_index, shard, i - first_block AS block
    FROM (SELECT split, shard, first_block, unnest(range(first_block, first_block + blocks)) AS i
          FROM ranges)"""
)
def block_lookup(spark, sf_dir):
    ranges = materialize(blocks.block_starts(shards(spark, sf_dir), q.SEQ_LEN), "ranges")
    found = None
    for split in ("train", "val"):
        mine = ranges.where(F.col("split") == split)
        n = mine.agg(F.max("end_block")).first()[0] or 0
        rows = blocks.lookup_blocks(spark.range(n).toDF("block_index"), "block_index", mine)
        rows = rows.withColumn("split", F.lit(split))
        found = rows if found is None else found.unionByName(rows)
    return found


def _order(rows, split):
    n = rows.where(F.col("split") == split).count()
    return EpochOrder(n, _FACTOR % n or 1, _SHIFT % n)


_POSITIONED = f"""{_INDEXED}, size AS (SELECT count(*)::BIGINT AS n FROM indexed WHERE split = 'train'),
slots AS (
  SELECT i AS position, ({_FACTOR} * i + {_SHIFT}) % n AS block_index, n
  FROM (SELECT unnest(range(n)) AS i, n FROM size)),
ordered AS (
  SELECT position, block_index, shard, block, n
  FROM slots JOIN indexed USING (block_index) WHERE split = 'train')"""


@query(
    f"""{_POSITIONED} SELECT position, block_index, shard, block,
    (position + 1)::DOUBLE / n AS epoch_share FROM ordered"""
)
def epoch_order(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("split = 'train'")
    order = _order(rows, "train")
    return in_epoch_order(rows, "block_index", order).select(
        "position",
        "block_index",
        "shard",
        "block",
        ((F.col("position") + 1).cast("double") / F.lit(order.n)).alias("epoch_share"),
    )


_CURSOR, _BATCH = 100, 64


@query(
    f"""{_POSITIONED} SELECT position, shard, block FROM ordered
    WHERE position >= {_CURSOR} AND position < {_CURSOR + _BATCH}"""
)
def resume_batch(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("split = 'train'")
    placed_rows = in_epoch_order(rows, "block_index", _order(rows, "train"))
    at = F.col("position")
    return placed_rows.where((at >= _CURSOR) & (at < _CURSOR + _BATCH)).select(
        "position", "shard", "block"
    )


@query(
    f"""{_INDEXED}, size AS (SELECT count(*)::BIGINT AS n FROM indexed WHERE split = 'val'),
    slots AS (SELECT i AS position, ({_FACTOR} * i + {_SHIFT}) % n AS block_index
              FROM (SELECT unnest(range(n)) AS i, n FROM size))
    SELECT position, shard, block FROM slots JOIN indexed USING (block_index)
    WHERE split = 'val' AND position < 8"""
)
def val_subset(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("split = 'val'")
    placed_rows = in_epoch_order(rows, "block_index", _order(rows, "val"))
    return placed_rows.where("position < 8").select("position", "shard", "block")


@query(
    f"""WITH {q.EXAMPLES}
    SELECT conv_id, sha256({q.joined(f'ids[1:{q.CHAT_SEQ_LEN}]')}) AS x,
           sha256({q.joined('''list_transform(list_zip(ids[2:], mask[2:]),
             lambda p: CASE WHEN p[2] = 0 THEN -100 ELSE p[1] END)''')}) AS y
    FROM padded"""
)
def shifted_targets(spark, sf_dir):
    x, y = blocks.training_pair(F.col("tokens"), F.col("mask"))
    rows = examples(spark, sf_dir).select("conv_id", x.alias("x"), y.alias("y"))
    return rows.select(
        "conv_id",
        F.sha2(joined(F.col("x")), 256).alias("x"),
        F.sha2(joined(F.col("y")), 256).alias("y"),
    )


_MICRO, _ACCUM = 2, 4
_BATCH_TOKENS = _MICRO * _ACCUM * q.SEQ_LEN


def _schedule(spark, sf_dir):
    """Budget = the train tokens the corpus holds."""
    total = lengths(spark, sf_dir).where("split = 'train'").agg(F.sum("n_tokens")).first()[0]
    return Schedule(total_tokens=total, decay_fraction=0.25, decay_mix=0.5)


_TOTAL = f"""{q.DOCS}, t AS (SELECT sum(n_tokens)::BIGINT AS total FROM doc WHERE split = 'train')"""


@query(
    f"""WITH {_TOTAL}, p AS (
      SELECT total, greatest(1, floor(total * 0.02::DOUBLE))::BIGINT AS warm,
             floor(total * 0.75::DOUBLE)::BIGINT AS decay_start FROM t),
    u AS (SELECT unnest(range(total // {_BATCH_TOKENS})) AS "update", * FROM p),
    s AS (SELECT "update", "update" * {_BATCH_TOKENS} AS tokens_before,
                 ("update" + 1) * {_BATCH_TOKENS} AS tokens_after, * EXCLUDE ("update") FROM u)
    SELECT "update", tokens_before, tokens_after,
           CASE WHEN tokens_after < warm THEN 'warmup' WHEN tokens_after < decay_start THEN 'stable'
                ELSE 'decay' END AS phase,
           CASE WHEN tokens_after < warm THEN 0.001::DOUBLE * tokens_after / warm::DOUBLE
                WHEN tokens_after < decay_start THEN 0.001::DOUBLE
                ELSE 0.001::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE,
                     (tokens_after - decay_start)::DOUBLE / (total - decay_start)::DOUBLE))
                     * (0.0001::DOUBLE - 0.001::DOUBLE) END AS rate
    FROM s"""
)
def schedule_phases(spark, sf_dir):
    return mix.update_table(spark, _schedule(spark, sf_dir), _BATCH_TOKENS)


_DECAY_LANG = "en"


@query(
    f"""WITH {_TOTAL}, sizes AS (
      SELECT (sum(n_tokens)::BIGINT - 1) // {q.SEQ_LEN} AS n_main,
             (sum(n_tokens) FILTER (lang = '{_DECAY_LANG}')::BIGINT - 1) // {q.SEQ_LEN} AS n_decay
      FROM doc WHERE split = 'train'),
    slot AS (
      SELECT unnest(range(total // {_BATCH_TOKENS} * {_ACCUM})) AS slot, total FROM t),
    chosen AS (
      SELECT slot, CASE WHEN slot // {_ACCUM} * {_BATCH_TOKENS} >= total * 0.75::DOUBLE
             AND ('0x' || substr(sha256('{q.SEED}:' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5
             THEN 'decay' ELSE 'main' END AS source FROM slot),
    nth AS (
      SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM chosen),
    read AS (
      SELECT slot, source, j::INT AS "row", nth * {_MICRO} + j AS cur,
             CASE source WHEN 'main' THEN n_main ELSE n_decay END AS n
      FROM nth, sizes, range({_MICRO}) r(j))
    SELECT slot, source, "row", (cur // n)::BIGINT AS epoch, (cur % n)::BIGINT AS position,
           (({_FACTOR} * (cur % n) + {_SHIFT} + cur // n) % n)::BIGINT AS block_index FROM read"""
)
def training_mix(spark, sf_dir):
    rows = lengths(spark, sf_dir, "lang").where("split = 'train'")
    total, decay = rows.agg(
        F.sum("n_tokens"), F.sum(F.when(F.col("lang") == _DECAY_LANG, F.col("n_tokens")))
    ).first()
    schedule = Schedule(total_tokens=total, decay_fraction=0.25, decay_mix=0.5)
    slots = mix.training_slots(spark, schedule, q.SEQ_LEN, _MICRO, _ACCUM, q.SEED)
    sizes = {"main": (total - 1) // q.SEQ_LEN, "decay": (decay - 1) // q.SEQ_LEN}
    epochs = mix.epochs_read(slots, _MICRO, sizes)
    orders = {
        s: [EpochOrder(n, _FACTOR % n or 1, (_SHIFT + e) % n) for e in range(epochs[s])]
        for s, n in sizes.items()
    }
    return mix.slot_blocks(slots, _MICRO, orders)
