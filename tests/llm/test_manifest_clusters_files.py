"""Operators 11 to 13 against plain versions, on odd rows and on the given tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tokenloom.llm import bitplanes, byte_words, merkle, rangecoder, token_files
from tokenloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clusters"])
def test_equals_twin(llm, name):
    assert not differences(QUERIES[name](llm, SF), connect(SF), ORACLES[name])


# --- 11: manifest -------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    steps, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j, (_, own) in enumerate(run):
                for i in own:
                    steps[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            above.append((H(*[x for x, _ in run]), [i for _, own in run for i in own]))
        nodes = above
    return nodes[0][0], steps


def manifest(rows):
    def leaf(r, text):
        return H(*map(spelled, [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]))

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, *tree([leaf(r, r["text"]) for r in own])))
    root, upper = tree([t[1] for t in trees])
    out = []
    for (own, subroot, inner), up in zip(trees, upper):
        for r, steps in zip(own, inner):
            text, i = r["text"], r["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for left, right in steps + up:
                at = H(left, at, right)
            proof = H(*[a + b for a, b in steps + up])
            out.append((i, leaf(r, r["text"]), subroot, root, proof, at, at == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in merkle.verified(df).collect()), key=repr)


def test_manifest_of_odd_rows(odd_docs):
    df = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    clashing = df.withColumns({n: F.lit(1) for n in ("tree", "lo", "hi", "steps", "bucket", "digest", "leaves")})
    assert found(clashing) == manifest(df.collect())
    one = df.where("doc_id = 1")
    assert found(one) == manifest(one.collect())
    assert merkle.verified(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows,sources", [(1, 1), (3, 1), (82, 1), (244, 2), (700, 90), (300, 300)])
def test_manifest_of_tree_sizes(llm, rows, sources):
    """Trees below, at and above the ends of bands, and as many trees as need bands of their own."""
    rng = random.Random(rows)
    data = [(i * 7, f"s{rng.randrange(sources) if i % 3 else 0}", "x", i, f"t{i}\n{i % 5}") for i in range(rows)]
    df = llm.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    got = found(df.repartition(5))
    assert got == manifest(df.collect())
    assert any(not r[-1] for r in got) or rows < 5


def test_intervals_name_ancestors(llm):
    feet = llm.range(200).selectExpr("'t' tree", "200L leaves", "id lo", "id + 1 hi", "sha2(string(id), 256) digest")
    nodes = merkle.band(feet, 1)
    steps = {r["lo"]: r["steps"] for r in merkle.ancestors(feet.select("tree", "lo"), nodes, 1).collect()}
    assert all(len(s) == merkle.BAND for s in steps.values())
    assert [len(s["left"]) // 64 for s in steps[199]] == [1, 0, 1, 1]
    assert [len(s["right"]) // 64 for s in steps[199]] == [0, 0, 0, 0]


# --- 12: clusters -------------------------------------------------------------------------------


def clusters(rows, k=16, rounds=3):
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    start = sorted(vectors, key=lambda r: (H(f"1:{'' if r[0] is None else r[0]}"),))
    centroids = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(near(v)[1], []).append(v)
        for c, vs in own.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    labels = [(i, near(v)) for i, v in vectors]
    total = {}
    for _, (d, c) in labels:
        total[c] = total.get(c, 0) + d
    digest = [H(",".join(map(str, c))) for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, (d, c) in labels), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [0.3, 5.0, 30_000.0])
def test_clusters_of_odd_rows(llm, size):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=64) * size).tolist()) for i in range(150)]
    good += [(1000 + i, good[3][1]) for i in range(80)] + [(2000, [0.0] * 64), (7, good[7][1]), (2001, [size] * 64)]
    bad = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [None] + [1.0] * 63)]
    bad += [(3005, [float("nan")] * 64), (3006, [float("inf")] + [0.0] * 63), (3007, [1e300] * 64)]
    df = llm.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumns({n: F.lit(0) for n in ("v", "planes", "cluster", "distance", "n", "at")})
    got = bitplanes.cluster(df).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == clusters(good)
    assert bitplanes.cluster(df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert sorted(tuple(r) for r in bitplanes.cluster(few).select(*COLUMNS).collect()) == clusters(good[:3])


def test_planes_give_exact_products():
    rng = np.random.default_rng(6)
    for bits in (1, 2, 9, 27):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (n, 64)) for n in (9, 4))
        packed = [bitplanes.pack(x, bits + 1) for x in (a, b)]
        assert (bitplanes.unpack(packed[0]) == a).all()
        assert (bitplanes.dots(*packed) == a @ b.T).all()
        assert (bitplanes.norms(packed[0]) == (a * a).sum(1)).all()
        cluster, distance = bitplanes.nearest(*packed)
        assert distance.tolist() == [min(int(((x - c) ** 2).sum()) for c in b) for x in a]
    same = bitplanes.pack(np.ones((2, 64), np.int64), 2)
    assert bitplanes.nearest(same, np.concatenate([same, same]))[0].tolist() == [0, 0]


# --- 13: token files ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def expected(tokenizer, rows, end=2):
    out, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def reread(df, path, vocabulary):
    token_files.write(df, str(path), vocabulary, end_id=2)
    rows = token_files.read(df.sparkSession, str(path))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c"))


def test_files_of_given_documents(llm, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](llm, SF).collect())
    assert got == expected(tokenizer[1], sorted(rows))


def test_files_of_odd_rows(llm, odd_docs, tokenizer, tmp_path):
    rng = random.Random(9)
    letters = "ab Zé1 \n\t'’s.!　 東京🧵́ß\x00\x1c"
    odd = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(200)]
    marked = ["<|endoftext|>", "a <|endoftext|>  b", "!!<|endoftext|><|endoftext|>'s", "<|endoftext", "x  <|endoftext|>"]
    odd += [(400 + i, t) for i, t in enumerate(marked)]
    df = odd_docs.select("doc_id", "text").unionByName(llm.createDataFrame(odd, "doc_id long, text string"))
    clashing = df.withColumns({n: F.lit("x") for n in ("hash", "words", "part", "start", "n_tokens")})
    got = [tuple(r) for r in reread(clashing, tmp_path / "ids", tokenizer[0]).collect()]
    rows = sorted(((r[0], r[1]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(got, key=lambda r: r[1]) == expected(tokenizer[1], rows)
    empty = reread(df.limit(0), tmp_path / "none", tokenizer[0])
    assert empty.count() == 0


def test_many_segments_and_damage(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    texts = [["one"] * 60, [], None, [" two", " three"], ["x"] * 45, ["tail"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "words"])
    parts = list(token_files._segments(iter([batch, batch.slice(0, 0), batch]), tokenizer[0], 2))
    assert [i for named, _, _ in parts for i in named] == [*range(6)] * 2 and len(parts) > 1
    assert [int(n) for _, sizes, _ in parts for n in sizes] == [61, 1, 1, 3, 46, 2] * 2
    one = [tokenizer[1].encode(w).ids for w in (" two", " three")]
    flat = np.concatenate([ids for _, _, ids in parts])
    assert flat[63:66].tolist() == [*one[0], *one[1], 2]
    data = token_files.segment([5, None], np.array([3, 700]), np.arange(703, dtype=np.int32), 50257)
    named, sizes, back = token_files.parse(data)
    assert named == [5, None] and sizes.tolist() == [3, 700] and (back == np.arange(703)).all()
    for at in (2, 30, len(data) // 2, len(data) - 9):
        broken = bytearray(data)
        broken[at] ^= 0x11
        with pytest.raises(ValueError):
            token_files.parse(bytes(broken))


@pytest.mark.parametrize("lanes", [1, 2, 40])
def test_coder_round_trip(lanes):
    rng = np.random.default_rng(lanes)
    kinds = [
        lambda n: rng.integers(0, 50257, n),
        lambda n: np.full(n, 50256),
        lambda n: rng.zipf(1.3, n) % 50257,
        lambda n: np.tile(rng.integers(0, 50257, 7), n)[:n],
    ]
    blocks = [kinds[i % 4](int(rng.integers(0, 900))).astype(np.int32) for i in range(lanes)]
    blocks.sort(key=len, reverse=True)
    words = rangecoder.encode(blocks, 50257)
    back = rangecoder.decode(words, [len(b) for b in blocks], 50257)
    assert all((a == b).all() for a, b in zip(blocks, back))
    for i in range(lanes):  # a block stands for itself
        alone = rangecoder.encode([blocks[i]], 50257)[0]
        assert (alone == words[i]).all()
    repeated = np.tile(np.arange(50), 40)
    assert 16 * len(rangecoder.encode([repeated], 50257)[0]) < 2 * len(repeated)


def test_coder_keeps_pace_and_size():
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 3000, (3000, 6))  # what may follow an id
    ids = np.zeros((1 << 11, 1 << 8), np.int64)
    for i in range(1, ids.shape[1]):
        ids[:, i] = follow[ids[:, i - 1], np.minimum(rng.geometric(0.4, len(ids)), 6) - 1]
    ids = ids.ravel().astype(np.int32)

    def spent(work):
        times = []
        for _ in range(3):
            begin = time.thread_time()
            out = work()
            times.append(time.thread_time() - begin)
        return min(times), out

    measure, _ = spent(lambda: sum(range(len(ids))))
    coded, words = spent(lambda: rangecoder.encode([ids], 50257))
    read, back = spent(lambda: rangecoder.decode(words, [len(ids)], 50257))
    assert (back[0] == ids).all()
    assert coded + read < 60 * measure
    assert 16 * len(words[0]) < 8.5 * len(ids)  # order 0 alone takes 11


def test_damaged_blocks_are_errors():
    ids = np.random.default_rng(4).zipf(1.4, 3000).astype(np.int32) % 50257
    words = rangecoder.encode([ids], 50257)[0]
    table = token_files.segment([1], np.array([3000]), ids, 50257)
    for cut in (0, 3, 8, 40, len(words) - 5):
        with pytest.raises(ValueError):
            rangecoder.decode([words[:cut]], [3000], 50257)
    noticed = 0
    for at in range(0, len(table), 23):
        broken = bytearray(table)
        broken[at] ^= 0x40
        try:
            back = token_files.parse(bytes(broken))
        except ValueError:
            noticed += 1
        else:  # padding, and the last bits of a lane, change nothing
            assert back[0] == [1] and back[1].tolist() == [3000] and (back[2] == ids).all()
    assert noticed > 0.9 * len(range(0, len(table), 23))


def test_words_by_columns():
    from tokenizers.pre_tokenizers import ByteLevel

    mark, library = "<|endoftext|>", ByteLevel(add_prefix_space=False, use_regex=True)
    rng = random.Random(12)
    signs = ["a", "S", "s", "t", "re", "ve", "ll", "m", "d", "l", "'", "'", " ", " ", "  ", "\n", "\t", "\r", "12", "!", "<", "|", ">"]
    wide = [mark, "’", "²", "½", "é", "東", "　", " ", " ", "\x00", "\x1c", "\x85", "​", "🧵", "́", "٣", "﻿", "\U0010ffff"]
    for alphabet in (signs, signs + wide):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, " ", "'s"]
        got = byte_words.split(pa.array(texts), [mark], byte_words.Classes())
        for text, words in zip(texts, got.to_pylist()):
            found = []
            for part in re.split(f"({re.escape(mark)})", text or ""):
                found += [part] if part == mark else [part[a:b] for _, (a, b) in library.pre_tokenize_str(part)]
            assert words == found
        some = pa.array(texts).slice(7, 50)
        assert byte_words.split(some, [mark], byte_words.Classes()).equals(got.slice(7, 50))
    for empty in ([], [None], ["", ""]):
        none = byte_words.split(pa.array(empty, pa.string()), [mark], byte_words.Classes())
        assert none.to_pylist() == [[] for _ in empty]


@pytest.mark.parametrize("size", [1, 5, 40])
def test_long_texts_in_parts(monkeypatch, size):
    marks = ["<|endoftext|>", "x y"]
    rng = random.Random(size)
    signs = ["a", "Z", "9", "'s", "'", " ", "  ", "\n", "\n", " \n", "é", "東", "　", "!", *marks]
    texts = ["".join(rng.choice(signs) for _ in range(200)) for _ in range(60)] + ["東" * 90, "a" * 90, " " * 90]
    classes = byte_words.Classes()
    whole = byte_words.split(pa.array(texts), marks, classes)
    assert ["".join(words) for words in whole.to_pylist()] == texts
    monkeypatch.setattr(byte_words, "TEXT_AT_ONCE", size)
    column, cuts = pa.array(texts), 0
    for i, words in enumerate(whole.to_pylist()):
        one = column.slice(i, 1)
        assert byte_words.split(one, marks, classes).to_pylist() == [words]
        data = np.frombuffer(texts[i].encode(), np.uint8)
        cuts += len(byte_words._cuts(data, byte_words._marks(one, np.zeros(1, np.int64), marks))) - 1
    assert cuts > 100


def test_new_words_encoded_together(tokenizer):
    codes = token_files.word_codes(tokenizer[0])
    mark = "<|endoftext|>"
    for words in ([" one", "\n\n", "<|endof", "text|>", "é", "  "], ["x", mark, " y"], [], ["|>", "<", "<|endoftext|"]):
        ids, sizes = codes.spell(words) if words else codes.gather(pa.array(words, pa.string()))
        each = [tokenizer[1].encode(w, add_special_tokens=False).ids for w in words]
        assert ids.tolist() == [i for e in each for i in e] and sizes.tolist() == [len(e) for e in each]


def test_words_of_many_batches_are_numbered_once(tokenizer, monkeypatch):
    asked = []
    codes = token_files.word_codes(tokenizer[0])
    rows = codes.rows
    monkeypatch.setattr(codes, "rows", lambda words: (asked.append(len(words)), rows(words))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([["a", " b"], [" b"]], pa.list_(pa.string()))], ["doc_id", "words"])
    (named, sizes, ids), = token_files._segments(iter([batch] * 5), tokenizer[0], 2)
    assert named == [1, 2] * 5 and sizes.tolist() == [3, 2] * 5 and asked == [2]
    one = [tokenizer[1].encode(w).ids[0] for w in ("a", " b")]
    assert ids.tolist() == [*one, 2, one[1], 2] * 5
