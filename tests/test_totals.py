import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tests import twins
from tokenloom.operators import budget, running, shards
from tokenloom.operators.dedup import mark_first
from tokenloom.operators.shards import roll_equal_rows, roll_shards


def lengths(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, split string, n_tokens long")


def corpus(n, seed, gap=3, val=0.2, top=40):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(n * gap), n))
    return [(i, "val" if rng.random() < val else "train", rng.randint(1, top)) for i in ids]


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_running_totals_equal_a_fold(spark, chunk):
    rows = corpus(700, 1)
    got = running.running_totals(
        lengths(spark, rows).repartition(5), "doc_id", {"run": "n_tokens"}, ["split"], chunk
    )
    have = {r["doc_id"]: r["run"] for r in got.collect()}
    for side in ("train", "val"):
        mine = [r for r in rows if r[1] == side]
        for (i, _, _), total in zip(mine, accumulate(r[2] for r in mine)):
            assert have[i] == total


def test_chunks_stay_even_when_ids_cluster(spark):
    ids = [(i,) for i in range(1000)] + [(10**15 + 10**9 * i,) for i in range(1000)]
    df = spark.createDataFrame(ids, "doc_id long")
    bounds = running.chunk_bounds(df, "doc_id", 100)
    sizes = df.groupBy(running.chunk_of(F.col("doc_id"), bounds)).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) <= 250


def test_sampled_bounds_change_nothing_but_balance(spark, monkeypatch):
    monkeypatch.setattr(running, "BOUND_ROWS", 60)
    rows = corpus(600, 21)
    df = lengths(spark, rows)
    assert 2 <= len(running.chunk_bounds(df, "doc_id", 100)) <= 6
    got = running.running_totals(df, "doc_id", {"run": "n_tokens"}, rows_per_chunk=100)
    have = {r["doc_id"]: r["run"] for r in got.collect()}
    assert [have[r[0]] for r in rows] == list(accumulate(r[2] for r in rows))


@pytest.mark.parametrize("sample", [60, 10**9])
def test_chunks_are_bounded_beyond_one_sketch(spark, monkeypatch, sample):
    """Ids crowd in places, and one sketch gives four chunks only."""
    monkeypatch.setattr(running, "MAX_CHUNKS", 4)
    monkeypatch.setattr(running, "BOUND_ROWS", sample)
    rng = random.Random(8)
    ids = sorted({rng.randrange(10**12) for _ in range(1500)} | set(range(5 * 10**11, 5 * 10**11 + 3000, 2)))
    rows = [(i, "val" if rng.random() < 0.2 else "train", rng.randint(1, 40)) for i in ids]
    df = lengths(spark, rows).repartition(5)
    bounds = running.chunk_bounds(df, "doc_id", 50)
    sizes = df.groupBy(running.chunk_of(F.col("doc_id"), bounds)).count().collect()
    assert max(r["count"] for r in sizes) <= 100 and len(sizes) < 300
    got = {r["doc_id"]: (r["shard"], r["offset"]) for r in roll_shards(df, "doc_id", 700, rows_per_chunk=50).collect()}
    for side in ("train", "val"):
        mine = [r for r in rows if r[1] == side]
        assert [got[r[0]] for r in mine] == twins.roll([r[2] for r in mine], 700)


def test_values_that_repeat_too_often_stay_in_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(running, "MAX_CHUNKS", 4)
    df = spark.createDataFrame([(7,)] * 500 + [(i,) for i in range(100, 300)], "doc_id long")
    bounds = running.chunk_bounds(df, "doc_id", 20)
    sizes = sorted(r["count"] for r in df.groupBy(running.chunk_of(F.col("doc_id"), bounds)).count().collect())
    assert 500 <= sizes[-1] < 540 and sizes[-2] <= 40


def test_chunk_of_counts_bounds_at_or_below(spark):
    for bounds in ([], [5], [3, 9], [1, 2, 4, 8, 16], list(range(0, 70, 7))):
        got = spark.range(80).select("id", running.chunk_of(F.col("id"), bounds).alias("c")).collect()
        assert all(r["c"] == sum(b <= r["id"] for b in bounds) for r in got)


@pytest.mark.parametrize(
    "max_tokens,val_tokens,seq_len",
    [(2000, 150, 64), (2000, 30, 64), (2000, 64, 64), (10**9, 100, 8), (1, 500, 300), (50, 10**9, 8), (3000, 1, 8), (None, 60, 8), (500, None, 8), (None, None, 8)],
)
def test_token_budget_equals_the_rules(spark, max_tokens, val_tokens, seq_len):
    for seed, val in ((2, 0.2), (3, 0.01), (4, 0.0)):
        rows = corpus(400, seed, val=val)
        df = lengths(spark, rows)
        cut = budget.token_cut(
            df, "doc_id", max_tokens=max_tokens, val_tokens=val_tokens, seq_len=seq_len, rows_per_chunk=50
        )
        kept = sorted(r["doc_id"] for r in df.where(cut.keep("doc_id")).collect())
        assert kept == twins.budget(rows, max_tokens, val_tokens, seq_len)[0]


def test_budget_per_source(spark):
    parts = {p: corpus(150, s) for p, s in (("a", 5), ("b", 6), ("c", 7))}
    parts["hot"] = corpus(600, 8)
    df = spark.createDataFrame(
        [(p, *r) for p, rows in parts.items() for r in rows],
        "source string, doc_id long, split string, n_tokens long",
    )
    cuts = budget.token_cuts(
        df, "doc_id", max_tokens=900, val_tokens=60, seq_len=32, by=["source"], rows_per_chunk=64
    )
    kept = budget.apply_cuts(df, cuts, "doc_id", ["source"]).collect()
    for p, rows in parts.items():
        assert sorted(r["doc_id"] for r in kept if r["source"] == p) == twins.budget(rows, 900, 60, 32)[0]


def test_first_rows_and_chars(spark):
    df = spark.createDataFrame([(i * 5, i + 1) for i in range(300)], "doc_id long, n_chars long")
    assert budget.first_rows_cut(df, "doc_id", 10, 20) == 45
    assert budget.first_rows_cut(df, "doc_id", 301, 20) is None
    assert budget.chars_cut(df, "doc_id", 6, 20) == 10  # 1 + 2 + 3 reaches six
    assert budget.chars_cut(df, "doc_id", 10**9, 20) is None


@pytest.mark.parametrize("limit,top,fan_out,chunk", [(100, 40, 64, 30), (25, 60, 2, 10), (400, 9, 3, 8), (10**6, 5, 2, 50)])
def test_shard_roll_equals_a_search(spark, limit, top, fan_out, chunk):
    rows = corpus(500, limit, top=top)
    got = roll_shards(lengths(spark, rows), "doc_id", limit, rows_per_chunk=chunk, fan_out=fan_out)
    have = {r["doc_id"]: (r["shard"], r["offset"]) for r in got.collect()}
    floors = 0
    for side in ("train", "val"):
        mine = [r for r in rows if r[1] == side]
        for (i, _, n), place, total in zip(
            mine, twins.roll([r[2] for r in mine], limit), accumulate(r[2] for r in mine)
        ):
            assert have[i] == place
            floors += (total - n) // limit != place[0]
    if limit <= 100:
        assert floors  # the division rule really is another rule


def test_row_longer_than_the_limit(spark):
    rows = [(0, "train", 5), (1, "train", 1000), (2, "train", 5), (3, "train", 5)]
    got = roll_shards(lengths(spark, rows), "doc_id", 10).orderBy("doc_id").collect()
    assert [(r["shard"], r["offset"]) for r in got] == [(0, 0), (0, 5), (1, 0), (1, 5)]


def test_equal_rows(spark):
    df = spark.range(40).withColumnRenamed("id", "nth")
    got = roll_equal_rows(df, "nth", 9, 40).orderBy("nth").collect()
    assert [(r["shard"], r["offset"]) for r in got] == twins.roll([9] * 40, 40)


def test_first_row_wins_per_source(spark):
    rng = random.Random(11)
    rows = [(rng.choice("xy"), i, rng.choice(["hot"] * 10 + list("abcdef"))) for i in range(500)]
    df = spark.createDataFrame(rows, "source string, conv_id long, key string")
    got = {
        (r["source"], r["conv_id"])
        for r in mark_first(df, ["key"], "conv_id", ["source"]).where("is_first").collect()
    }
    seen, expected = set(), set()
    for s, i, k in rows:
        if (s, k) not in seen:
            seen.add((s, k))
            expected.add((s, i))
    assert got == expected


def test_assigned_shards_equal_placed_ones(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(f"p{i % 2}", "train" if i % 7 else "val", i, 1 + i % 13) for i in range(900)],
        "part string, split string, doc_id long, n_tokens long",
    )
    placed = shards.roll_shards(rows, "doc_id", 60, ("part", "split"), rows_per_chunk=100).cache()
    want = {(r["doc_id"], r["shard"]) for r in placed.collect()}
    for most in (4_000_000, 3):
        monkeypatch.setattr(shards, "MAX_BOUNDS", most)
        got = shards.assign_shards(rows, placed, "doc_id", ("part", "split"))
        assert {(r["doc_id"], r["shard"]) for r in got.collect()} == want


def test_groups_stay_small_whatever_a_shard_holds(spark, monkeypatch):
    """Tiny rows and a limit that no chunk reaches: few tables meet, and the result is the same."""
    monkeypatch.setattr(shards, "GROUP_ROWS", 300)
    rows = spark.createDataFrame([("train", i, 1) for i in range(3000)], "split string, doc_id long, n_tokens long")
    got = shards.roll_shards(rows, "doc_id", 700, rows_per_chunk=60).orderBy("doc_id").collect()
    assert [(r["shard"], r["offset"]) for r in got] == twins.roll([1] * 3000, 700)
