import random
import sys

from pyspark.sql import functions as F

from tests import twins
from tokenloom.functions import text

SPACES = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")


def hostile(n, seed=7):
    rng = random.Random(seed)
    alphabets = ["".join(SPACES) + "ab​", " \n\t\r a", " ", "é中🐈’ \n", "<|eos>pad "]
    return [
        "".join(rng.choice(a) for _ in range(rng.choice([0, 1, 5, 60, 300])))
        for a in (rng.choice(alphabets) for _ in range(n))
    ]


def test_whitespace_set_is_pythons():
    assert sorted(text.WHITESPACE) == SPACES


def test_strip_collapse_and_bucket(spark):
    values = hostile(600) + [" " * 5000, "a" + " " * 4095 + "b", "x\x00y", "a" * 4096 + " tail"]
    got = (
        frame(spark, values)
        .select(
            "t",
            text.strip(F.col("t")).alias("strip"),
            text.collapse(F.col("t")).alias("collapse"),
            text.split_key(F.col("t")).alias("key"),
            text.holdout_bucket(F.col("t")).alias("bucket"),
            text.split_of(F.col("t")).alias("split"),
        )
        .collect()
    )
    for r in got:
        assert r["strip"] == r["t"].strip()
        assert r["collapse"] == " ".join(r["t"].split())
        assert r["key"] == " ".join(r["t"][:4096].split())
        assert r["bucket"] == twins.bucket(r["t"])
        assert r["split"] == twins.split(r["t"])


def test_equal_prefixes_share_a_split(spark):
    head = "word " * 900
    rows = frame(spark, [head + "one", head + "two", "some  text", "some text"])
    b = [r[0] for r in rows.orderBy("i").select(text.holdout_bucket(F.col("t"))).collect()]
    assert b[0] == b[1] and b[2] == b[3]


def test_length_filter_edges(spark):
    values = ["é" * n for n in (99, 100, 101)] + [None, " " * 200, " " + "a" * 99 + " ", " " + "b" * 100]
    got = [r[0] for r in frame(spark, values).orderBy("i").select(text.is_long_enough(F.col("t"))).collect()]
    assert got == [False, True, True, False, False, False, True]


def test_neutralize(spark):
    values = [
        "<|eos|><|eos|>x", "<<|pad|>|eos|>", "<|nope|>", "< |eos|>", "<|assistant|>", "plain",
        "<|<|eos|>", "<|end|><|user|><|system|>", *hostile(200, 3),
    ]
    for r in frame(spark, values).select("t", text.neutralize(F.col("t")).alias("n")).collect():
        assert r["n"] == twins.neutral(r["t"])


def test_byte_ids_round_trip(spark):
    values = ["Größe 東京 ñandú 🧵✂", "a\x00b", "", "ÿ", *hostile(100, 5)]
    ids = text.byte_ids(F.col("t"))
    rows = frame(spark, values).select(
        "t", ids.alias("ids"), text.byte_count(F.col("t")).alias("n"),
        text.decode_ids(ids, text.byte_symbols()).alias("back"),
    )
    table = text.byte_symbol_ids()
    for r in rows.collect():
        assert r["ids"] == [table[b] for b in r["t"].encode()]
        assert r["n"] == len(r["ids"]) and r["back"] == r["t"]


def test_words_cover_the_text(spark):
    values = [v for v in hostile(300, 9) if v]
    for r in frame(spark, values).select("t", text.words(F.col("t")).alias("w")).collect():
        assert "".join(r["w"]) == r["t"]
