import math
import random

import pytest
from pyspark.sql import functions as F

from tests import twins
from tokenloom.functions.schedule import Schedule, phase, rate
from tokenloom.operators import blocks, mix
from tokenloom.operators.order import (
    EpochOrder,
    ReaderState,
    in_epoch_order,
    next_batch,
    validation_subset,
)


@pytest.mark.parametrize("seq_len", [2, 8, 16])
def test_blocks_equal_slices_of_the_stream(spark, seq_len):
    rng = random.Random(seq_len)
    docs = [[rng.randint(0, 999) for _ in range(rng.randint(1, 40))] for _ in range(120)]
    places = twins.roll([len(d) for d in docs], 150)
    df = spark.createDataFrame(
        [("train", s, o, d) for d, (s, o) in zip(docs, places)],
        "split string, shard long, offset long, ids array<int>",
    )
    got = {(r["shard"], r["block"]): r["tokens"] for r in blocks.cut_blocks(df, seq_len).collect()}
    expected = {}
    for shard in {s for s, _ in places}:
        flat = [t for d, (s, _) in zip(docs, places) if s == shard for t in d]
        for b in range(max(0, (len(flat) - 1) // seq_len)):
            expected[shard, b] = flat[b * seq_len : b * seq_len + seq_len + 1]
    assert got == expected


def test_usable_blocks_edges(spark):
    df = spark.createDataFrame([(n,) for n in (1, 8, 9, 16, 17, 64, 65)], "tokens long")
    got = [r[0] for r in df.select(blocks.usable_blocks(F.col("tokens"), 8)).collect()]
    assert got == [0, 0, 1, 1, 2, 7, 8]
    shards = spark.createDataFrame([("train", 0, 8)], "split string, shard long, tokens long")
    with pytest.raises(ValueError, match="too short for one block"):
        blocks.require_blocks(shards, 8, "train")


def test_lookup_finds_the_shard(spark):
    sizes = [3, 0, 5, 1, 0, 7]
    shards = spark.createDataFrame(
        [("train", i, n * 4 + 1 if n else 1) for i, n in enumerate(sizes)],
        "split string, shard long, tokens long",
    )
    ranges = blocks.block_starts(shards, 4)
    got = blocks.lookup_blocks(spark.range(sum(sizes)).toDF("i"), "i", ranges).orderBy("i").collect()
    flat = [(s, b) for s, n in enumerate(sizes) for b in range(n)]
    assert [(r["shard"], r["block"]) for r in got] == flat


def test_training_pair(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 0, 1, 1])], "t array<int>, m array<int>")
    x, y = blocks.training_pair(F.col("t"), F.col("m"))
    _, plain = blocks.training_pair(F.col("t"))
    assert df.select(x, y, plain).first()[:] == ([1, 2, 3], [-100, 3, 4], [2, 3, 4])


# Multiplier and shift by block count and epoch, for seed 13. Fixed values.
DRAWN = {(97, 0): (87, 83), (97, 2): (90, 67), (20, 0): (19, 17), (20, 1): (3, 16), (20, 2): (19, 13)}


@pytest.mark.parametrize("n", [1, 2, 97, 100, 24])
def test_epoch_order_is_a_bijection_and_inverts(spark, n):
    for epoch in range(3):
        order = EpochOrder.drawn(n, 13, epoch)
        assert (order.a, order.b) == DRAWN.get((n, epoch), (order.a, order.b))
        assert math.gcd(order.a, n) == 1 and 0 <= order.b < n
        rows = spark.range(n).select(
            "id", order.block_at(F.col("id")).alias("b")
        ).withColumn("back", order.position_of(F.col("b"))).collect()
        assert sorted(r["b"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] and r["b"] == (order.a * r["id"] + order.b) % n for r in rows)


def test_order_beyond_long_products(spark):
    n = 3_500_000_011
    order = EpochOrder(n, 3_499_999_999, 123)
    rows = spark.createDataFrame([(i,) for i in (0, 1, n - 1, n // 2)], "i long")
    for r in rows.select("i", order.block_at(F.col("i")).alias("b")).collect():
        assert r["b"] == (order.a * r["i"] + order.b) % n


def test_resume_gives_the_same_batches(spark):
    n = 20
    blocks_df = spark.range(n).toDF("block_index")
    start = ReaderState(0, 13, "f")
    whole, _ = next_batch(blocks_df, "block_index", n, start, 50)  # two and a half epochs
    expected = {r["cursor"]: r["block_index"] for r in whole.collect()}
    assert sorted(expected) == list(range(50))
    for i, block in expected.items():
        a, b = DRAWN[n, i // n]
        assert block == (a * (i % n) + b) % n
    state, got = start, {}
    for take in (7, 4, 30, 9):
        rows, state = next_batch(blocks_df, "block_index", n, state, take)
        got.update({r["cursor"]: r["block_index"] for r in rows.collect()})
    assert got == expected and state.cursor == 50
    with pytest.raises(ValueError, match="other data or another seed"):
        state.check(14, "f")
    with pytest.raises(ValueError, match="other data or another seed"):
        state.check(13, "other")
    state.check(13, "f")


def test_validation_subset_is_fixed(spark):
    rows = validation_subset(spark.range(30).toDF("i"), "i", 30, 2, 4).collect()
    a, b = 29, 19  # drawn for 30 blocks and seed 0
    assert sorted(r["i"] for r in rows) == sorted((a * p + b) % 30 for p in range(8))


def test_schedule(spark):
    s = Schedule(total_tokens=10_000, warmup_fraction=0.1, decay_fraction=0.2)
    df = spark.createDataFrame([(t,) for t in (0, 500, 1000, 5000, 8000, 9000, 10_000, 12_000)], "t long")
    got = [r[:] for r in df.select(phase(F.col("t"), s), rate(F.col("t"), s)).collect()]
    expected = [0, 5e-4, 1e-3, 1e-3, 1e-3, 5.5e-4, 1e-4, 1e-4]
    assert [p for p, _ in got] == ["warmup"] * 2 + ["stable"] * 2 + ["decay"] * 4
    assert [v for _, v in got] == pytest.approx(expected)
    with pytest.raises(ValueError):
        Schedule(total_tokens=10, warmup_fraction=0.5, decay_fraction=0.6)
    with pytest.raises(ValueError):
        Schedule(total_tokens=10, decay_mix=1.5)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_mix_share_and_positions(spark, share):
    s = Schedule(total_tokens=64 * 400, decay_fraction=0.5, decay_mix=share)
    slots = mix.training_slots(spark, s, 8, 2, 4, 42)
    rows = slots.orderBy("slot").collect()
    assert len(rows) == 1600
    early = [r for r in rows if r["slot"] // 4 * 64 < 64 * 200]
    assert {r["source"] for r in early} == {"main"}
    late = [r["source"] for r in rows[len(early):]]
    assert abs(late.count("decay") / len(late) - share) < 0.04
    for source in ("main", "decay"):
        assert [r["nth"] for r in rows if r["source"] == source] == list(
            range(sum(r["source"] == source for r in rows))
        )
    sizes = {"main": 300, "decay": 7}
    epochs = mix.epochs_read(slots, 2, sizes)
    orders = {k: [EpochOrder.drawn(n, 42, e) for e in range(epochs[k])] for k, n in sizes.items()}
    seen = mix.slot_blocks(slots, 2, orders).collect()
    assert len(seen) == 3200
    for r in seen:
        order = orders[r["source"]][r["epoch"]]
        assert r["block_index"] == (order.a * r["position"] + order.b) % order.n
    again = mix.training_slots(spark, s, 8, 2, 4, 42).orderBy("slot").collect()
    assert again == rows


def test_in_epoch_order_needs_no_join(spark):
    plan = in_epoch_order(spark.range(10).toDF("i"), "i", EpochOrder(10, 3, 1))
    assert "Join" not in plan._jdf.queryExecution().toString()


def test_blocks_are_cut_where_texts_arrive(spark):
    """Texts move once, to their shard, but for the dealing out of a file that is one split."""
    from tokenloom.catalog import packing

    plan = packing.cut(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange " in line and "REPARTITION_BY" not in line]
    assert len(moves) == 1 and "hashpartitioning(split#" in moves[0], plan
