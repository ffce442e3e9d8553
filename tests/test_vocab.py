import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.operators import vocab
from tokenloom.sources import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


def reference_trainer(texts, size, min_count=2):
    from tokenizers import decoders, models, pre_tokenizers, trainers

    tok = tokenizers.Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    tok.train_from_iterator(
        texts,
        trainers.BpeTrainer(
            vocab_size=size,
            min_frequency=min_count,
            special_tokens=text.SPECIALS,
            initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
            show_progress=False,
        ),
    )
    return tok


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r["text"] for r in rows]


@pytest.fixture(scope="module")
def learned(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return vocab.learn(vocab.word_counts(df), 400)


def test_learns_the_same_vocabulary(learned, texts):
    theirs = reference_trainer(texts, 400).get_vocab()
    assert {learned.spelled(i): i for i in range(len(learned))} == theirs


def test_ties_repeats_and_short_words(spark):
    samples = ["aaaa aaaa aaa bb bb bb b", "abab abab ba ba", "xy yx xy yx zz zz zz zz"] * 3
    df = spark.createDataFrame([(t,) for t in samples], "text string")
    mine = vocab.learn(vocab.word_counts(df), 272, rewrite_every=3)
    assert {mine.spelled(i): i for i in range(len(mine))} == reference_trainer(samples, 272).get_vocab()
    with pytest.raises(ValueError, match="too few pairs"):
        vocab.learn(vocab.word_counts(df), 2000)
    with pytest.raises(ValueError, match="must lie"):
        vocab.learn(vocab.word_counts(df), 100_000)


def test_encodes_like_the_public_tokenizer(spark, learned, texts, tmp_path):
    digest = tokenizer_file.save(learned, str(tmp_path / "tok"), {"note": "test"})
    theirs = tokenizers.Tokenizer.from_file(str(tmp_path / "tok" / "tokenizer.json"))
    rng = random.Random(4)
    odd = ["", "Größe 東京 ñandú 🧵✂", " \n\n  a", "a" * 5000, "don't we'll  x", "　  b", "\x00\x1c "]
    odd += ["".join(rng.choice("ab \n’é中1.!") for _ in range(60)) for _ in range(200)]
    cases = texts[:60] + odd
    df = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    encode = vocab.encoder(spark, learned)
    rows = df.select("i", encode(F.col("t")).alias("ids")).withColumn(
        "back", text.decode_ids(F.col("ids"), list(learned.symbols))
    )
    for r in rows.collect():
        assert r["ids"] == theirs.encode(cases[r["i"]], add_special_tokens=False).ids
        assert r["back"] == cases[r["i"]]
    assert tokenizer_file.load(str(tmp_path / "tok")) == learned
    tokenizer_file.check(str(tmp_path / "tok"), digest)
    with pytest.raises(ValueError, match="another tokenizer"):
        tokenizer_file.check(str(tmp_path / "tok"), "other")
    with pytest.raises(ValueError, match="already exists"):
        tokenizer_file.save(learned, str(tmp_path / "tok"))


def test_reserved_tokens_never_encode(spark, learned):
    encode = vocab.encoder(spark, learned)
    df = spark.createDataFrame([("<|assistant|> and <|eos|>",)], "t string")
    ids = df.select(encode(text.neutralize(F.col("t")))).first()[0]
    assert min(ids) >= len(text.SPECIALS)


def test_byte_encoder_needs_no_python(spark):
    encode = vocab.encoder(spark, vocab.Vocabulary.of_bytes())
    plan = spark.range(1).select(encode(F.col("id").cast("string")))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_tables(spark, learned):
    v = learned.vocab_table(spark)
    assert v.count() == 400 and v.where("token = '<|end|>'").first()["id"] == text.END
    m = learned.merge_table(spark).orderBy("rank").collect()
    assert len(m) == 400 - vocab.FIRST_MERGE
    assert all(
        learned.symbols[r["left"]] + learned.symbols[r["right"]] == learned.symbols[r["new_id"]] for r in m
    )


def test_symbol_characters_keep_id_order(spark):
    ids = list(range(0, vocab.MAX_VOCAB, 97)) + [0xD6FF, 0xD700, vocab.MAX_VOCAB - 1]
    chars = [vocab.symbol_char(i) for i in ids]
    assert [vocab.char_id(c) for c in chars] == ids
    assert not any(0xD800 <= ord(c) < 0xE000 or c in "'," for c in chars)
    df = spark.createDataFrame(list(zip(ids, chars)), "i int, c string")
    assert df.where(vocab.symbol_id(F.col("c")) != F.col("i")).count() == 0
    assert [r["i"] for r in df.orderBy("c").collect()] == sorted(ids)


def test_small_rankings_give_the_same_merges(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts[:40]], "text string")
    counts = vocab.word_counts(df)
    whole = vocab.learn(counts, 300)
    assert vocab.learn(counts, 300, ranking=5, rewrite_every=4) == whole


def test_independent_prefix(spark):
    rows = spark.createDataFrame([("ab", 9), ("cd", 8), ("bc", 7), ("ef", 6)], "pair string, n long")
    ranked = vocab._Ranking(rows.orderBy(F.desc("n")), 100, 2)
    assert ranked.independent(10) == ["ab", "cd"]
    assert ranked.independent(1) == ["ab"]
    assert ranked.independent(10, known={b"ab"}) == ["ab"]
    assert ranked.independent(10, lambda pair: b"same") == ["ab", "cd"]
    fans = spark.createDataFrame([("ab", 9), ("ac", 8), ("db", 7), ("xa", 6)], "pair string, n long")
    assert vocab._Ranking(fans.orderBy(F.desc("n")), 100, 2).independent(10) == ["ab", "ac", "db"]
    hiding = vocab._Ranking(rows.orderBy(F.desc("n")).limit(1), 1, 2)
    hiding.counts["cd"] = 8
    assert hiding.independent(10) == ["ab"]
