"""Operators on texts against brute force, on odd rows and on the given tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.llm import bpe, language, lines, mixing, pii, queries, simhash, substrings, token_counts, word_bpe

SF = "/root/testdata/sf0.001"
PATH = word_bpe.default_path()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- BPE ----------------------------------------------------------------------------------------


def odd_strings(n=1500):
    random.seed(7)
    letters = "aAbBéÉ'sStTrRvVlLdDmM  \t\n\x1c\x85\xa0 Σςİßé가½²٣x01***$$%<|>|م好🐈\u0000"
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " 's", "I'Ll", "ΟΔΟΣ"]
    made = [
        "".join(random.choice(parts) if random.random() < 0.1 else random.choice(letters) for _ in range(random.randint(0, 30)))
        for _ in range(n)
    ]
    return made + ["a" * i for i in range(40)] + ["%" * i for i in range(40)]


@pytest.mark.parametrize("careful", [False, True])
def test_pair_index_equals_library(library, careful):
    own = bpe.Encoder(PATH)
    if careful:
        own.rule = word_bpe.Rules(PATH)
        own.rule.careful[:] = True
    texts = odd_strings()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = own.encode(texts)
    assert ids.to_pylist() == want
    assert bpe.decode_ids(ids, PATH).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


def test_encoder_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    own = bpe.Encoder(PATH)
    for text in ("one two three", "a b c d e f g h i j k l m n o p q r s t u v", "one two"):
        assert own.encode([text]).to_pylist() == [library.encode(text, add_special_tokens=False).ids]


def test_new_words_of_several_batches_merge_together(library, monkeypatch):
    made, merged = bpe.encode_words, []
    monkeypatch.setattr(bpe, "encode_words", lambda words, rule: merged.append(len(words)) or made(words, rule))
    rows = [["one oneé, " * 60_000, "two"], ["two six, " * 60_000, None], ["ten", "", "one"]]
    columns = [pa.array(texts, pa.string()) for texts in rows]
    assert sum(c.nbytes for c in columns) > 1 << 20
    found = list(bpe._spelled(iter(columns), PATH))
    assert len(merged) == 1 and len(found) == 3
    for column, ids in zip(columns, found):
        assert ids.to_pylist() == [e.ids for e in library.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]


def test_plain_texts_split_like_others():
    rule = word_bpe.rules(PATH)
    plain = "".join(a + b for a in map(chr, range(128)) for b in map(chr, range(128)))
    for text in (plain, "I'll we'Ve 'S '' 12a_b\x1c\x1f\x0b x", ""):
        assert rule.words(text) == rule._split.findall(rule.normal(text))


def test_heap_counts_equal_library(library):
    texts = odd_strings()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [token_counts.text_tokens(t, PATH) for t in texts] == want


def test_bpe_queries(llm, library):
    rows = dict(texts_of(llm.read.parquet(f"{SF}/documents.parquet")))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    for r in queries.op5_bpe_encode_decode(llm, SF).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))
    for r in queries.op10_token_counts(llm, SF).collect():
        n = len(want[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 2048)
        assert r["n_bytes"] == len(rows[r["doc_id"]].encode())


def test_bpe_odd_rows(odd_docs, library):
    coded = bpe.decode(bpe.encode(odd_docs, PATH), PATH)
    both = bpe.round_trip(odd_docs, PATH)
    assert sorted(map(str, coded.collect())) == sorted(map(str, both.select(*coded.columns).collect()))
    assert set(odd_docs.columns) < set(coded.columns) and coded.count() == 12
    for r in coded.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    for r in token_counts.count_tokens(odd_docs, PATH).collect():
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert bpe.encode(odd_docs.limit(0), PATH).count() == 0
    assert token_counts.count_tokens(odd_docs.limit(0), PATH).count() == 0


# --- mixing -------------------------------------------------------------------------------------


def water(sizes, weights, cap):
    """Targets by repeated sharing, source by source."""
    left, out = float(sum(sizes)), [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(out) if t is None]
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            return out
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)


def test_mix_odd_rows(odd_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == 12
    size = Counter()
    for _, text, source in odd_docs.select("doc_id", "text", "source").collect():
        size[source] += len(SPACE.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3.0)))
    by = {r["source_size"]: r["target"] for r in got}
    for s in order:
        assert by[size[s]] == pytest.approx(want[s])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(size.values()), abs=len(order) + 40)
    assert sorted(map(tuple, mixing.mix(odd_docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_targets_reshare_more_than_once(llm):
    sizes = [10, 1000, 30, 5000, 2, 700, 0, 90]
    rows = [(f"={i}", f"{i}", s) for i, s in enumerate(sizes)]
    table = llm.createDataFrame(rows, "skey string, source string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.targets(table, (5, 2, 1), 3.0).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(8)], 3.0)
    assert [got[f"={i}"] for i in range(8)] == pytest.approx(want)


def test_apply_mix_takes_whole_rows_near_the_target(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").withColumn("_mix_note", F.lit(1))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    count = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    plan = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        s = source[r["doc_id"]]
        taken[s] += count[r["doc_id"]] * r["size"]
        target[s], largest[s] = r["target"], max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


# --- language -----------------------------------------------------------------------------------


def test_language_held_out_accuracy(llm):
    sf = "/root/testdata/sf0.01"
    true = {r["doc_id"]: r["lang"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op2_language_id(llm, sf).collect()]
    assert len(got) == len(true) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(llm, odd_docs, monkeypatch):
    filters = language.fit(odd_docs, F.lit(True))
    got = {r["doc_id"]: r for r in language.identify(odd_docs, filters).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert got[5]["lang_pred"] == "en" and got[10]["lang_pred"] == "fr"
    none = language.fit(odd_docs, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(odd_docs, none).collect()} == {"und"}
    assert language.identify(odd_docs.limit(0), filters).count() == 0


def test_bit_slices_hold_what_was_entered():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 62, 3000).astype(np.uint64) for _ in range(70)]
    filters = language.Filters.build([f"l{i:02}" for i in range(70)], sets)
    assert filters.places.shape == (2, 1 << language.FILTER_BITS)
    for b, held in enumerate(sets):
        found = np.full(len(held), ~np.uint64(0))
        for probe in language.probes(held, language.FILTER_BITS):
            found &= filters.places[b // 64][probe]
        assert ((found >> np.uint64(b % 64)) & np.uint64(1)).all()
    assert (filters.chance < 0.01).all()
    assert language.filter_bits(20_000) == 19 and language.filter_bits(10**9) == language.MOST_BITS


def plain_grams(text):
    """Three letters, lower-cased, with one space for all else; the middle one is a letter."""
    cleaned = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + re.sub(" +", " ", cleaned).strip(" ") + " "
    return [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]


def made_up_languages(llm, n):
    """Texts of words that a language has of its own or shares with the next one; ties, nulls, copies."""
    random.seed(n)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(5))
    own = [[word() for _ in range(8)] for _ in range(n)]
    rows = []
    for i in range(n):
        for _ in range(6):
            some = random.choices(own[i], k=20) + random.choices(own[(i + 1) % n], k=4)
            rows.append((len(rows), " ".join(some).title(), f"l{i:02}"))
    rows += [(len(rows), None, "l00"), (len(rows) + 1, "Nobody's text", None), (None, "an id is missing here", "l01")]
    return rows, llm.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [5, 70])
def test_language_filters_equal_plain_sets(llm, n):
    """Which n-grams belong to a language, and what they decide, against sets of strings."""
    rows, docs = made_up_languages(llm, n)
    counts = {}
    for i, text, lang in rows:
        if None not in (i, text, lang):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    rate = {k: {g: x / sum(c.values()) for g, x in c.items()} for k, c in counts.items()}
    rates = Counter()
    for each in rate.values():
        rates.update(each)
    want = {
        k: {g for g, x in c.items() if x >= language.MIN_COUNT and rate[k][g] >= language.SHARE * rates[g]}
        for k, c in counts.items()
    }
    got = {}
    for r in language.learned(docs, F.lit(True)).collect():
        got.setdefault(r["lang"], set()).add(r["gram"])
    code = lambda g: int(language.grams(np.array([0 if c == " " else ord(c) for c in g], np.uint32))[0])
    assert got == {k: {np.uint64(code(g)).astype(np.int64) for g in v} for k, v in want.items()}
    filters = language.fit(docs, F.lit(True))
    assert filters.languages == sorted(want)
    texts = [r[1] for r in rows if r[1]]
    found, hits = filters.hits(texts)
    for t, total, each in zip(texts, found, hits):
        mine = plain_grams(t)
        assert total == len(mine)
        plain = np.array([sum(g in want[k] for g in mine) for k in filters.languages])
        assert (each >= plain).all() and (each - plain).sum() <= 1 + 0.01 * len(mine) * n
    judged = {r["doc_id"]: r for r in language.identify(docs, filters).collect()}
    for i, text, lang in rows:
        if text is not None and lang is not None and i is not None:
            share = sorted((sum(g in want[k] for g in plain_grams(text)) / len(plain_grams(text)), k) for k in want)
            assert judged[i]["lang_pred"] == lang == share[-1][1]
            assert judged[i]["score"] == pytest.approx(share[-1][0] - share[-2][0] / 2, abs=0.02)


def test_language_ties_go_to_the_first(llm):
    rows = [(i, "one text in two languages", ("b", "a")[i % 2]) for i in range(8)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs, F.lit(True))).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and all(abs(r["score"] - 0.5) < 0.01 for r in got)


# --- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = SPACE.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_query(llm):
    rows = dict(texts_of(llm.read.parquet(f"{SF}/documents.parquet")))
    fp = {i: plain_fingerprint(t) for i, t in rows.items()}
    ids = sorted(fp)
    near = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = reach(ids, near)
    got = queries.op3_simhash_near_dedup(llm, SF).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_links_equal_all_pairs(llm, bits):
    random.seed(bits)
    base = [random.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(6)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values | {0, (1 << 64) - 1})
    df = llm.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df, bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want


def test_simhash_odd_rows(odd_docs):
    got = {r["doc_id"]: r for r in simhash.groups(odd_docs).collect()}
    assert {got[i]["fp"] for i in (2, 3, 4)} == {0} and {got[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert got[6]["component_id"] == 5 and got[None] is not None
    assert simhash.groups(odd_docs.limit(0)).count() == 0


def test_one_of_each_group_stays(llm, odd_docs):
    given = llm.read.parquet(f"{SF}/documents.parquet")
    rows = dict(texts_of(given))
    fp = {i: plain_fingerprint(t) for i, t in rows.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = reach(sorted(fp), near)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(given).collect()}
    assert kept == set(want.values()) and len(kept) < len(rows)
    left = simhash.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[2] == 1 and ids[3] == ids[4] == 0 and ids[10] == 2 and ids[None] == 1
    assert simhash.drop_near_duplicates(odd_docs.limit(0)).count() == 0


def test_no_group_loses_all_to_a_repeated_id(llm):
    """Document 1 has two texts; it stands for a group by one of them, and stays for it."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = llm.createDataFrame([(0, one), (1, one), (1, two), (2, two), (2, two)], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == {0: 1, 1: 2}


# --- substrings ---------------------------------------------------------------------------------


def plain_dedup(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [1, 3, 6, 20])
def test_substrings_equal_plain_scan(llm, window):
    random.seed(window)
    words = ["a", "b", "é", "ab"]
    rows = []
    for i in range(60):
        w = [random.choice(words) if window > 3 else f"{random.randrange(40)}" for _ in range(random.randint(0, 60))]
        if i % 5 == 0:
            w = ["x", "y"] * random.randint(0, 40)
        if i % 7 == 3:
            w = SPACE.findall(rows[i - 2][1] or "") + w[:5]
        rows.append((i * 3, random.choice([" ", "\n", "\t "]).join(w) if i % 11 else None))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2], r[3]) for r in substrings.dedup(docs, window).collect()}
    assert got == plain_dedup(rows, window)


def test_substrings_odd_rows(odd_docs):
    got = {r["doc_id"]: r for r in substrings.dedup(odd_docs).collect()}
    assert got[6]["n_removed"] == got[6]["n_words"] == 60_000 and got[3]["n_words"] == 0
    assert got[5]["n_removed"] == 60_000 - 700  # all but the first round of the 700 words
    assert got[8]["kept"] == "head" and got[7]["n_removed"] == 0
    assert substrings.dedup(odd_docs.limit(0)).count() == 0


# --- lines --------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, n):
    b = list(text)
    for _ in range(n):
        at = random.randint(0, len(b))
        kind = random.randrange(3)
        if kind == 0:
            b.insert(at, random.choice("abé🐈"))
        elif at < len(b):
            b[at : at + 1] = [] if kind == 1 else [random.choice("abc")]
    return "".join(b)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_bits_equal_the_matrix(edits):
    random.seed(edits)
    a = ["".join(random.choice("abcé") for _ in range(random.randint(0, 14))) for _ in range(1500)]
    b = [edited(x, random.randint(0, 4)) for x in a]
    assert lines.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b)]


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_equal_all_pairs(llm, edits):
    random.seed(20 + edits)
    pool = ["".join(random.choice("abcdefé ") for _ in range(random.randint(5, 70))).strip() for _ in range(60)]
    pool += ["x" * n for n in (19, 20, 21, 22, 30, 31, 32, 33)]
    rows = []
    for i in range(50):
        own = [edited(random.choice(pool), random.randint(0, 4)) for _ in range(random.randint(0, 6))]
        rows.append((i, "\n".join(own)))
    first, order = {}, []
    for i, t in rows:
        for j, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if len(line) >= 20:
                order.append((i, j, line))
                first.setdefault(line, (i, j))
    gone = set()
    for i, j, line in order:
        earlier = [p for other, p in first.items() if p < (i, j) and abs(len(other) - len(line)) <= edits and distance(other, line) <= edits]
        if earlier:
            gone.add((i, j))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["line"]) for r in lines.repeated_lines(docs.toDF("doc", "text"), edits, 20).collect()}
    assert got == gone
    for r in lines.drop_lines(docs, edits, 20).collect():
        text = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for j, x in enumerate(text) if (r["doc_id"], j) not in gone)
        assert r["_n_lines"] == len(text)


def test_many_near_lines_make_few_candidates(llm, monkeypatch):
    """Lines that are all near the first of them, and one document of very many equal lines."""
    asked = []
    near = lines._near
    monkeypatch.setattr(lines, "_near", lambda docs, distinct, pairs, *a: asked.append(pairs.distinct().count()) or near(docs, distinct, pairs, *a))
    base = "the same sentence with only two letters that differ in a line"
    rows = [(0, base)] + [(i, base[:20] + chr(97 + i % 26) + chr(97 + i // 26) + base[22:]) for i in range(1, 500)]
    rows.append((1000, "\n".join(["a line that a very long document repeats"] * 200_000)))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r for r in lines.drop_lines(docs).collect()}
    assert all(kept[i]["_n_removed"] == (i > 0) for i in range(500))
    assert kept[1000]["_n_removed"] == 199_999 and kept[1000]["text"] == "a line that a very long document repeats"
    assert len(asked) == 2 and sum(asked) <= 4 * len(rows)


def test_lines_odd_rows(odd_docs):
    out = lines.drop_lines(odd_docs)
    assert set(odd_docs.columns) < set(out.columns) and out.count() == 12
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[6]["text"] == "" and got[3]["text"] is None and got[2]["text"] == ""
    assert got[4]["text"] == " \t\n\x0b " and got[10]["_n_removed"] == 0
    assert lines.drop_lines(odd_docs.limit(0)).count() == 0


# --- private data -------------------------------------------------------------------------------

BASE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = (
                True,
                k == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0,
                9 <= len(digits) <= 15,
            )[k]
            if good:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_plain_patterns(llm):
    random.seed(9)
    parts = [
        "a@b.c", "a@b.c_d@e.f", "x.y%z@host-1.example.com", "@", "a@b", "é@b.c", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "0001.2.3.255",
        "99999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "4111  1111", "5500000000000004", "1234567890123", "7" * 25,
        "+49 (30) 123456-78", "+1.2.3.4", "+12 345 678 9012 3456 789", "+1", "🐈", "é", " ", "\n", "-", "+", ".", "12", "0",
    ]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 9)))) for i in range(1500)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] < 4] for r in pii.report(docs).collect()}
    wrong = [(t, got[i], plain_spans(t)) for i, t in rows if got[i] != plain_spans(t)]
    assert not wrong, wrong[:3]


def test_words_that_disclose(llm, odd_docs):
    rows = [(i, f"Please ask Grimaldine at jane@corp.example about number {i} today") for i in range(5)]
    rows += [(10 + i, f"today we ask about number {i} and please") for i in range(40)]
    rows += [(60, "one time only Zebulonia writes bob@corp.example")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i in range(5):
        term = [s for s in got[i]["spans"] if s["kind"] == pii.TERM]
        assert [rows[i][1][s["start"] : s["end"]] for s in term] == ["Grimaldine"]
        assert got[i]["n_email"] == 1
    assert all(not got[i]["spans"] for i in range(10, 50))
    assert [s["kind"] for s in got[60]["spans"]] == [0]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "Please ask [TERM] at [EMAIL] about number 3 today" and clean[12] == rows[7][1]
    assert dict(texts_of(pii.sanitise(docs, remove=True)))[3] == "Please ask  at  about number 3 today"
    odd = pii.report(odd_docs).collect()
    assert len(odd) == 12 and not any(r["spans"] for r in odd)
    assert pii.report(odd_docs.limit(0)).count() == 0 and pii.sanitise(odd_docs.limit(0)).count() == 0


def plain_terms(texts, disclosure, chance):
    """Places of disclosing words, by counting every word and value over every text."""
    spans = [plain_spans(t) for t in texts]
    kind = {(i, s): (s[0], t[s[1] : s[2]].lower() if s[0] < 2 else re.sub("[^0-9]", "", t[s[1] : s[2]])) for i, t in enumerate(texts) for s in spans[i]}
    held = [{kind[i, s] for s in spans[i]} for i in range(len(texts))]
    found = [[m for m in regex.finditer(r"\p{L}{3,}", t.lower())] for t in texts]
    every = [{m[0] for m in ms} for ms in found]
    free = [
        [m for m in regex.finditer(r"\p{L}{3,}", "".join("\0" if any(a <= k < b for _, a, b in spans[i]) else c for k, c in enumerate(t.lower())))]
        for i, t in enumerate(texts)
    ]
    tests = sum(len(every[i]) for i in range(len(texts)) for _ in held[i])
    total, out = len(texts), [set() for _ in texts]

    def unlikely(both, one, other):
        p, q = both / one, other / total
        if p <= q:
            return 0.0
        return -one * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0))

    for entity in set().union(*held):
        with_it = [i for i in range(total) if entity in held[i]]
        for term in {m[0] for i in with_it for m in free[i]}:
            both = sum(term in every[i] for i in with_it)
            n_term = sum(term in w for w in every)
            if len(with_it) == total:
                continue
            ratio = math.log2(total * both / (n_term * len(with_it))) / math.log2(total / len(with_it))
            bound = min(unlikely(both, len(with_it), n_term), unlikely(both, n_term, len(with_it)))
            if ratio >= disclosure - 1e-9 and bound < math.log(chance / tests):
                for i in with_it:
                    out[i] |= {(4, *m.span()) for m in free[i] if m[0] == term}
    return [sorted(x) for x in out]


@pytest.mark.parametrize("disclosure,chance", [(0.8, 0.05), (0.5, 0.5), (1.0, 1e-6)])
def test_disclosure_rule_equals_a_double_loop(llm, disclosure, chance):
    random.seed(13)
    values = ["jane@corp.example", "JANE@corp.example", "kim@two.example", "+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4"]
    tells = ["Grimaldine", "Grimaldine", "Kimberly", "Zebulonia", "Wort", "host"]
    common = "please ask about the number today or some other time é it corp jane".split()
    texts = []
    for i in range(400):
        parts = random.choices(common, k=random.randint(0, 8))
        for v, t in zip(values, tells):
            if random.random() < 0.04:
                parts += [v, t] if t == "Zebulonia" or random.random() < 0.8 else [v]
            elif t != "Zebulonia" and random.random() < 0.004:
                parts.append(t)
        random.shuffle(parts)
        texts.append(" ".join(parts))
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] == pii.TERM] for r in pii.report(docs, disclosure, chance).collect()}
    want = plain_terms(texts, disclosure, chance)
    wrong = [(t, got[i], want[i]) for i, t in enumerate(texts) if got[i] != want[i]]
    assert not wrong, wrong[:3]
    assert sum(map(len, want)) > 10


def test_sanitised_texts_stay_with_their_rows(llm):
    """The rows fall differently each time the table is read."""
    rows = [(i, f"ask n{i}@corp.example about {i}" if i % 3 else f"plain {i}") for i in range(400)]
    dealt = llm.createDataFrame(rows, "doc_id long, text string").repartition(7)
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    docs = dealt.repartition(5, draw("doc_id")).select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert got == {i: f"ask [EMAIL] about {i}" if i % 3 else f"plain {i}" for i, _ in rows}


def test_words_far_away_often_and_rarely_disclose(llm):
    """A name by an address in 29 documents and far from it in one, and without it in another; a name
    of three letters in the only two documents of an address; one met once."""
    far = " plain" * 40
    rows = [(i, "Grimaldine at jane@corp.example") for i in range(29)]
    rows += [(29, f"Grimaldine{far} jane@corp.example"), (30, "Grimaldine without")]
    rows += [(40 + i, "Kim or kim@two.example") for i in range(2)]
    rows += [(50, "Zebulonia by bob@corp.example")]
    rows += [(100 + i, "some plain words or others") for i in range(900)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == pii.TERM] for r in pii.report(docs).collect()}
    assert all(got[i] == ["Grimaldine"] for i in range(30)) and got[30] == []
    assert got[40] == got[41] == ["Kim"] and got[50] == [] and got[100] == []


def test_bags_of_near_lines_are_near(llm):
    random.seed(11)
    rows = []
    for n in (0, 1, 2, 2, 2, 30):
        for size in (20, 90, 4000):
            a = "".join(random.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(size))
            rows.append((n, a, edited(a, n)))

    def bag(text):
        return int(np.sum(lines.CLASS_ONE[np.frombuffer(text.encode(), np.uint8)], dtype=np.uint64).view(np.int64))

    table = llm.createDataFrame([(n, bag(a), bag(b)) for n, a, b in rows], "n int, a long, b long")
    got = table.select("n", lines._bags_near("a", "b", 2).alias("near")).collect()
    assert all(r["near"] for r in got if r["n"] <= 2) and not all(r["near"] for r in got)
