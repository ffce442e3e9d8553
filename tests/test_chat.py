import random

import pytest
from pyspark.sql import functions as F

from tests import twins
from tokenloom.functions import text
from tokenloom.operators import conversations as convs
from tokenloom.operators.vocab import Vocabulary
from tokenloom.plans import chats
from tokenloom.plans.chats import ChatPack, chat_rows

SEQ = 48


def size(value):
    return len(value.encode())


def table(spark, conversations, part=None):
    rows = [
        (id_, turn, role, content)
        for id_, messages in conversations
        for turn, (role, content) in enumerate(messages)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


CASES = [
    [("user", "hi"), ("assistant", "hello")],
    [("system", "be kind"), ("user", "hi there"), ("assistant", "yes")],
    [("system", "only system")],
    [("user", "q1"), ("system", "late"), ("assistant", "a")],
    [("user", "q2"), ("user", "q3"), ("assistant", "a")],
    [("user", "q4"), ("assistant", "a"), ("user", "again")],
    [("user", "q5"), ("assistant", "  \n　 ")],
    [("user", "q6"), ("assistant", None)],
    [("sam", "q7"), ("assistant", "a")],
    [("user", "q8"), ("ursula", "a")],
    [("assistant", "no user at all")],
    [("assistant", "no user either")],
    [("user", "hi   there \n"), ("assistant", "repeated prompt, other space")],
    [("user", "hide"), ("assistant", "")],
    [("user", "hide"), ("assistant", "valid, but the first copy counts as seen")],
    [("user", "x" * 20), ("assistant", "y" * (SEQ + 1 - 24))],
    [("user", "z" * 20), ("assistant", "y" * (SEQ + 2 - 24))],
    [("user", "<|end|> in text"), ("assistant", "ok")],
    [("user", "u"), ("assistant", "a"), ("user", "b"), ("assistant", "c")],
    [(None, "no role"), ("assistant", "a")],
]


def test_rules_case_by_case(spark):
    conversations = list(enumerate(CASES))
    got = convs.judged(table(spark, conversations), SEQ).orderBy("conv_id").collect()
    labels = [r["split"] if r["reason"] is None else "skipped" for r in got]
    assert labels == [s for _, s in twins.chat_pack(conversations, SEQ, 10**9, size)]
    reasons = {r["conv_id"]: r["reason"] for r in got}
    assert reasons[12] == "repeated_prompt" and reasons[14] == "repeated_prompt"
    assert reasons[16] == "too_long" and reasons[15] is None and reasons[6] == "blank_message"
    assert reasons[11] == "repeated_prompt"  # all conversations without a user share the empty key


def test_template_mask_and_padding(spark):
    rows = table(spark, list(enumerate(CASES)))
    accepted = convs.judged(rows, SEQ).where("reason is null")
    ids = text.byte_symbol_ids()
    for r in convs.examples(rows, accepted, SEQ, convs.byte_bodies()).collect():
        tokens, mask = [], []
        for role, content in CASES[r["conv_id"]]:
            body = [ids[b] for b in twins.neutral(content).encode()] + [text.END]
            tokens += [{"system": 2, "user": 3, "assistant": 4}[role], *body]
            mask += [0] + [int(role == "assistant")] * len(body)
        pad = SEQ + 1 - len(tokens)
        assert r["tokens"] == tokens + [0] * pad
        assert r["mask"] == mask + [0] * pad
        assert r["n_tokens"] == len(tokens)


def generated(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < 0.3:
            messages = rng.choice(CASES)
        else:
            messages = [("user", f"question {rng.randint(0, n)}"), ("assistant", "a" * rng.randint(1, 30))]
        out.append((i * 2, messages))
    return out


@pytest.mark.parametrize("stop", [5, 60, 10**6])
def test_chat_budget_equals_a_fold(spark, stop):
    conversations = generated(250, stop)
    placed, read = chat_rows(
        table(spark, conversations), Vocabulary.of_bytes(), ChatPack(SEQ, stop, shard_tokens=SEQ * 3)
    )
    expected = twins.chat_pack(conversations, SEQ, stop, size)
    got = {
        r["conv_id"]: r["split"] if r["reason"] is None else "skipped" for r in read.collect()
    }
    assert got == dict(expected)
    for side in ("train", "val"):
        ids = [i for i, s in expected if s == side]
        where = {r["conv_id"]: (r["shard"], r["offset"]) for r in placed.where(F.col("split") == side).collect()}
        assert [where[i] for i in ids] == twins.roll([SEQ + 1] * len(ids), SEQ * 3)


def test_conversations_past_a_safe_stop_are_not_encoded(spark, monkeypatch):
    """Merges make ids fewer than bytes, so the stop by bytes lies at or behind the true one."""
    seen = []
    encode = chats.encoded_turns

    def spied(turns, *rest):
        seen.append(turns.agg(F.max("conv_id")).first()[0])
        return encode(turns, *rest)

    conversations = generated(250, 4)
    rows = table(spark, conversations)
    base = Vocabulary.of_bytes().symbols
    a = base.index(b"a")
    doubled = Vocabulary((*base, b"aa", b"aaaa"), ((a, a, len(base)), (len(base), len(base), len(base) + 1)))
    whole, _ = chat_rows(rows, doubled, ChatPack(SEQ))
    good = [(r["conv_id"], r["split"]) for r in whole.orderBy("conv_id").collect()]
    train = [i for i, side in good if side == "train"][:10]
    first_val = next(i for i, side in good if side == "val")
    monkeypatch.setattr(chats, "encoded_turns", spied)
    placed, _ = chat_rows(rows, doubled, ChatPack(SEQ, 10))
    stop = max(train[-1], first_val)
    assert sorted(r["conv_id"] for r in placed.collect()) == [i for i, _ in good if i <= stop]
    assert stop <= seen[0] < conversations[-1][0]


def test_sources_are_packed_on_their_own(spark):
    a, b = generated(120, 1), generated(150, 2)
    both = (
        table(spark, a).withColumn("part", F.lit("a")).unionByName(table(spark, b).withColumn("part", F.lit("b")))
    )
    _, read = chat_rows(both, Vocabulary.of_bytes(), ChatPack(SEQ, 30, max_docs=100), by=("part",))
    got = {
        (r["part"], r["conv_id"]): r["split"] if r["reason"] is None else "skipped"
        for r in read.collect()
    }
    expected = {
        (p, i): s for p, rows in (("a", a), ("b", b)) for i, s in twins.chat_pack(rows[:100], SEQ, 30, size)
    }
    assert got == expected


def test_message_arrays(spark):
    df = spark.createDataFrame(
        [(0, [("user", "hi"), ("assistant", "yo")]), (1, []), (2, [("user", "only")])],
        "conv_id long, messages array<struct<role:string,content:string>>",
    )
    got = convs.judged(convs.turns_of(df), SEQ).orderBy("conv_id").collect()
    assert [r["reason"] for r in got] == [None, "bad_turns", "bad_turns"]
    with pytest.raises(ValueError, match="list of messages"):
        convs.turns_of(spark.createDataFrame([(0, "x")], "conv_id long, messages string"))


def test_one_conversation_may_hold_most_rows(spark):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", "word") for t in range(3000)]
    rows += [(i, t, r, f"{r} {i}") for i in range(1, 200) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["reason"] for r in convs.judged(df, SEQ).collect()}
    assert got[0] == "too_long" and sum(v is None for v in got.values()) == 199
