"""What bounds time and memory at size: batches that leave tasks, and how work is dealt."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tokenloom.catalog.chats import joined
from tokenloom.functions import text
from tokenloom.operators import wordcodes
from tokenloom.operators.vocab import Vocabulary, encoder
from tokenloom.plans.documents import DocumentPack, held_documents, kept_documents
from tokenloom.sources import shards

SEQ = 4096


def _task(monkeypatch, rows, make):
    """What a reader hands to its tasks, and the function that they run."""
    taken = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, use, schema: taken.append((df, use)) or df)
    make()
    monkeypatch.undo()
    return taken[0]


def test_blocks_leave_in_small_batches(spark, tmp_path, monkeypatch):
    ids = np.arange((SEQ + 1) * 600, dtype="<u2")
    ids.tofile(tmp_path / "a.bin")
    (ids % 2).astype("u1").tofile(tmp_path / "a.mask")
    asked = spark.createDataFrame([(0, "a.bin", "a.mask", 0)], "nth long, file string, mask string, block long")
    df, read = _task(monkeypatch, asked, lambda: shards.read_wanted(str(tmp_path), asked, SEQ, "sft"))
    # The requests are tiny and what they name is not: Spark must not gather them by their size.
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    n = 600
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(["a.bin"] * n), pa.array(["a.mask"] * n), pa.array(range(n))],
        ["nth", "file", "mask", "block"],
    )
    got = list(read(iter([batch])))
    assert max(len(b) * (SEQ + 1) for b in got) <= shards.VALUES_AT_ONCE
    got = pa.Table.from_batches(got)
    assert got["nth"].to_pylist() == list(range(n))
    flat = got["tokens"].combine_chunks().flatten().to_numpy()
    assert (flat == ids).all() and (got["mask"].combine_chunks().flatten().to_numpy() == ids % 2).all()


def test_packs_hold_texts_not_ids(spark):
    rows = [(i, f"Document {i} says <|end|> and füllt its line with words enough to be kept. " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = held_documents(docs, Vocabulary.of_bytes())
    assert "tokens" not in held.columns
    kept = {r["doc_id"]: r for r in kept_documents(docs, Vocabulary.of_bytes(), DocumentPack())[0].collect()}
    table = text.byte_symbol_ids()
    placed = held.withColumn("shard", F.lit(0).cast("long")).withColumn("offset", F.col("doc_id"))
    entries = {r["split"]: r for r in shards.shard_entries(placed.withColumn("split", F.lit("x"))).collect()}
    flat = []
    for i, t in rows:
        ids = [*(table[b] for b in t.replace("<|end|>", "< |end|>").encode()), text.EOS]
        assert kept[i]["tokens"] == ids and kept[i]["n_tokens"] == len(ids)
        flat += ids
    import hashlib

    assert entries["x"]["tokens"] == len(flat)
    assert entries["x"]["sha256"] == hashlib.sha256(np.array(flat, "<u2").tobytes()).hexdigest()


def test_encoder_hands_on_pieces():
    codes = wordcodes.WordCodes(lambda words: wordcodes.flattened([list(w.encode()) for w in words]), most_words=50)
    rows = [[f"w{i}", "x", f"y{i}"] if i % 7 else None for i in range(100)]
    pieces = list(wordcodes.encoded(codes, pa.array(rows, pa.list_(pa.string())), most=30))
    assert max(len(p.flatten()) for p in pieces) < 200 and len(pieces) > 5
    expected = [None if r is None else list("".join(r).encode()) for r in rows]
    assert pa.concat_arrays(pieces).to_pylist() == expected
    table = wordcodes.TokenBytes([bytes([i]) for i in range(256)])
    back = wordcodes.decoded(table, pa.concat_arrays(pieces))
    assert [b for p in back for b in p.to_pylist()] == [None if r is None else "".join(r).encode() for r in rows]


def test_encoding_whole_column_by_pieces(spark, monkeypatch):
    words = Vocabulary((*text.byte_symbols(), b"th"), ((text.byte_symbol_ids()[ord("t")], text.byte_symbol_ids()[ord("h")], 262),))
    rows = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else "the thing " * (i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r[0]: r[1] for r in docs.select("doc_id", encoder(spark, words)(F.col("text"))).collect()}
    table = text.byte_symbol_ids()
    for i, t in rows:
        plain = None if t is None else [262 if c == "Þ" else table[ord(c)] for c in t.replace("th", "Þ")]
        assert got[i] == plain


def test_joined_ids(spark):
    rows = [(0, [1, 20, 65535]), (1, []), (2, None), (3, [7])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    assert {r[0]: r[1] for r in df.select("i", joined(F.col("ids"))).collect()} == {0: "1,20,65535", 1: "", 2: None, 3: "7"}


def test_words_beyond_what_is_numbered_at_once(monkeypatch):
    monkeypatch.setattr(wordcodes, "WORDS_NUMBERED", 7)
    monkeypatch.setattr(wordcodes, "WORDS_GATHERED", 3)
    rows = [["ab", "c"] * 5, None, [], ["c", "é"] * 4, ["x" * k for k in range(12)]]
    codes = wordcodes.WordCodes(lambda words: wordcodes.flattened([list(w.encode()) for w in words]), most_words=4)
    ids, bounds = codes.texts(pa.array(rows, pa.list_(pa.string())))
    spelled = [list("".join(r or []).encode()) for r in rows]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == spelled
