import random

import pytest
from pyspark.sql import functions as F

from tests import twins
from tokenloom.functions import text
from tokenloom.operators import budget
from tokenloom.operators.vocab import Vocabulary
from tokenloom.plans.documents import DocumentPack
from tokenloom.sources import files
from tokenloom.sources import runlog
from tokenloom.streaming import intake

SCHEMA = "doc_id long, text string, lang string"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = intake.stream_documents(spark, str(tmp_path / "in"), SCHEMA)
    intake.write_parts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    docs.limit(7).write.mode("append").parquet(str(tmp_path / "in"))
    stream = intake.stream_documents(spark, str(tmp_path / "in"), SCHEMA)
    intake.write_parts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["part"] for r in got.select("part").distinct().collect()} == {0, 1}
    t = F.col("text")
    expected = docs.where(text.is_long_enough(t)).select("doc_id", text.split_of(t).alias("split"))
    first = got.where("part = 0").select("doc_id", "split")
    assert first.exceptAll(expected).count() == 0 and expected.exceptAll(first).count() == 0


@pytest.mark.parametrize("by", [(), ("source",)])
def test_first_prompt_over_batches(spark, tmp_path, by):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), f"ask {rng.randint(0, 40)}" + " " * rng.randint(0, 2)) for i in range(200)]
    schema = "conv_id long, source string, prompt string"
    for n in range(4):
        batch = spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema)
        batch.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        intake.first_prompts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), by=by).awaitTermination()
    seen, expected = set(), set()
    for i, s, p in rows:
        key = (s if by else "", " ".join(p.split()))
        if key not in seen:
            seen.add(key)
            expected.add(i)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["conv_id"] for r in got.collect()} == expected and got.count() == len(expected)


def test_first_prompt_ignores_history(spark, tmp_path):
    """A later batch with lower order values changes nothing, and no batch reads an older part."""
    schema = "conv_id long, prompt string"
    for n, rows in enumerate([[(9, "a"), (7, "a"), (8, None)], [(1, "a "), (2, "b")], [(0, ""), (3, "c"), (3, "b")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = intake.first_prompts(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert n == 0 or q.lastProgress["numInputRows"] == len(rows)
    got = {(r["part"], r["conv_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 7), (0, 8), (1, 2), (2, 3)}
    assert "RocksDB" not in spark.conf.get(intake.STATE_STORE)


@pytest.mark.parametrize("turns", [1, 4])
def test_budget_over_batches_equals_one_cut(spark, turns):
    rng = random.Random(turns)
    for max_tokens, val_tokens, seq_len in [(300, 40, 30), (300, 20, 30), (60, None, 50)]:
        rows = [(i, rng.choice(["train"] * 5 + ["val"]), rng.randint(1, 12)) for i in range(120)]
        df = spark.createDataFrame(rows, "doc_id long, split string, n_tokens long")
        whole = budget.token_cut(df, "doc_id", max_tokens=max_tokens, val_tokens=val_tokens, seq_len=seq_len)
        expected = {r["doc_id"] for r in df.where(whole.keep("doc_id")).collect()}
        kept, totals = set(), budget.Totals()
        for t in range(turns):
            part = df.where((F.col("doc_id") >= t * 120 // turns) & (F.col("doc_id") < (t + 1) * 120 // turns))
            cut, totals = budget.carried_cut(part, "doc_id", totals, max_tokens, val_tokens, seq_len)
            kept |= {r["doc_id"] for r in part.where(cut.keep("doc_id")).collect()}
        assert kept == expected
        assert totals.train == sum(n for i, s, n in rows if i in kept and s == "train")


def test_replayed_batch_goes_on_from_the_same_totals(spark, tmp_path):
    import os

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    options = DocumentPack(seq_len=64, max_tokens=200_000, val_tokens=2_000, shard_tokens=20_000)
    out, shards = str(tmp_path / "out"), {}
    for turn in range(3):
        docs.where(F.col("doc_id") % 200 >= turn * 60).where(F.col("doc_id") < turn * 60 + 60).write.mode("append").parquet(str(tmp_path / "in"))
        for again in (False, True):
            stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
            intake.pack_stream(stream, Vocabulary.of_bytes(), "x", out, str(tmp_path / "cp"), options).awaitTermination()
            meta = files.read_json(f"{out}/manifest.b{turn:06d}.json")
            if not again:  # the commit of the batch and its manifest are lost; it runs once more
                shards[turn] = meta
                os.remove(tmp_path / "cp" / "commits" / str(turn))
                for crc in (tmp_path / "cp" / "commits").glob(f".{turn}.crc"):
                    os.remove(crc)
                os.remove(f"{out}/manifest.b{turn:06d}.json")
        assert meta == shards[turn]
    assert shards[2]["source"]["totals"]["stopped"] and not shards[0]["source"]["totals"]["stopped"]


def test_state_store_variant_keeps_one_per_key(spark, tmp_path):
    schema = "conv_id long, prompt string"
    spark.createDataFrame([(i, f"p {i % 5}") for i in range(50)], schema).write.parquet(str(tmp_path / "in"))
    stream = intake.distinct_prompts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "log")
    train = spark.createDataFrame(
        [(10, 1000, 2.5, 300.0), (20, 2000, 2.0, 310.0)], "step long, tokens long, loss double, tokens_per_second double"
    )
    runlog.append_run_log(train, log)
    runlog.append_run_log(
        spark.createDataFrame([(20, 2000, 1.9, 8)], "step long, tokens long, val_loss double, val_blocks long"), log
    )
    rows = runlog.read_run_log(spark, log)
    assert runlog.train_records(rows).count() == 2 and runlog.validation_records(rows).count() == 1
    seen = []
    intake.follow_run_log(spark, log, str(tmp_path / "cp"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 3
    timed = spark.createDataFrame([("r", 1, 100, 0.0), ("r", 2, 400, 2.0)], "run string, step long, tokens long, at double")
    assert runlog.rates_between(timed, "at").orderBy("step").collect()[1]["rate"] == 150.0


def test_best_run_and_money(spark):
    runs = spark.createDataFrame(
        [(1, 50.0, False), (4, 90.0, False), (8, None, True)], "micro_batch int, tokens_per_second double, failed boolean"
    )
    assert runlog.best_run(runs).first()["micro_batch"] == 4
    df = spark.createDataFrame([(1000.0, 3.6, 36.0)], "r double, p double, d double")
    got = df.select(
        runlog.tokens_per_dollar(F.col("r"), F.col("p")),
        runlog.affordable_tokens(F.col("r"), F.col("p"), F.col("d")),
    ).first()
    assert got[0] == pytest.approx(1_000_000) and got[1] == pytest.approx(30_600_000, abs=1)
