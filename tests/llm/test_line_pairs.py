"""Candidate pairs of the line join: each near pair is made, and none under every key it shares."""

from pyspark.sql import functions as F

from tokenloom.llm import lines

WORDS = "sand noel bans lone anso elon sban nole osan leno nabs enol".split()


def test_pairs_of_a_group_are_made_once(spark, monkeypatch):
    base = "the line that many others were copied from and then changed at one place or another by a short word"
    cut = base.split(" ")
    texts = [" ".join([*cut[:i], w, *cut[i:]]) for i in range(1, len(cut), 2) for w in WORDS[i % 3 :: 3]]
    texts += [t[:9] + "#" + t[10:] for t in texts[::3]] + [t + "!?" for t in texts[::4]] + [t[1:] for t in texts[::5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    made, near = [], lines._near

    def spied(docs, distinct, pairs, *more):
        made.append((pairs.count(), pairs.distinct().count()))
        return near(docs, distinct, pairs, *more)

    monkeypatch.setattr(lines, "_near", spied)
    gone = {r["doc"] for r in lines.repeated_lines(docs, 2, 20).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    close = lines.within([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs], 2)
    assert gone == {i for (i, _), hit in zip(pairs, close) if hit}
    rows, distinct = made[1]
    assert distinct > 100 and rows <= 2 * distinct  # a shared segment each, three at most
    assert distinct < n * (n - 1) / 2


def test_keys_are_made_in_one_exchange(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a line of some length, number {i}") for i in range(50)], "doc long, text string")
    plans, write = {}, lines.materialize

    def spied(df, name):
        if name == "shared-keys":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()  # as it ran
        return write(df, name)

    monkeypatch.setattr(lines, "materialize", spied)
    distinct = spark.createDataFrame([], "h long, doc long, line int")
    lines.near_lines(docs, distinct, 2, 20)
    ran = plans["shared-keys"].split("== Initial Plan ==")[0]
    assert "ReusedExchange" in ran and ran.count("MapInArrow") == 1


def test_keys_of_one_line_leave_before_anything_is_sorted_or_grouped_by_line(spark):
    rows = [(k, 100 + k, 0, True, k) for k in range(40)]  # one line each
    rows += [(50, 1, 7, False, 3), (50, 2, 8, False, 4)]  # two lines, neither by its own segment
    rows += [(60, 5, 7, True, 9), (60, 5, 7, False, 2), (60, 6, 8, False, 4), (60, 6, 8, False, None)]
    keys = spark.createDataFrame(rows, "key long, h long, bag long, own boolean, doc long")
    shared = lines._shared(keys)
    found = sorted(map(tuple, shared.select("key", "a", "bag_a", "h", "bag", "own", "doc").collect()))
    assert found == [(60, 6, 8, 5, 7, True, 2), (60, 6, 8, 6, 8, False, 4)]  # the row without an id comes first
    assert "SortAggregate" not in shared._jdf.queryExecution().executedPlan().toString()
