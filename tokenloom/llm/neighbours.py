"""Operator 4: approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` orderings projects the vectors to a few random directions, shifts them and sorts
them along a Hilbert curve by a range partitioning. Around a query's place on every curve a window of
neighbouring keys is searched in full; the windows' best merge and are ranked by the exact measure.

How wide windows must be depends on the data alone: clustered vectors need little, vectors without
structure need a large part of the table. So it is measured: for ``AUDIT_QUERIES`` queries the true
neighbours are found by comparing with every row, in blocks, and the window is the smallest that
holds ``TARGET`` of them on some curve. Every vector is indexed; only the directions' scales and the
window come from bounded samples.

A query's own block on each curve comes first. What it finds there bounds what the other blocks of
its windows need to report, so windows of many blocks do not mean many candidates.

Nearness is the largest inner product. For vectors of unequal length one coordinate is added that
turns it into the smallest distance (the public reduction), on the curves only.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have another
length than most, take no part, as queries or candidates, and neither do rows without an id. Equal
vectors are searched once; of a vector's copies only the ``k + 1`` smallest ids can appear in a
result, and only they are kept. Rows that repeat an id are one vector, the least. Ties go to the smaller id. With
fewer candidates than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize
from tokenloom.llm.hilbert import hilbert_keys
from tokenloom.llm.vectors import lists, matrix, same_length, usable

CURVES = 8
DIRECTIONS = 8
BITS = 7
SCALE_SAMPLE = 4096  # vectors that set the directions' scales
AUDIT_QUERIES = 200
TARGET = 0.97
BLOCK = 4096  # neighbouring keys searched together
QUERIES_AT_ONCE = 2048  # queries of one block in one group
SALTS = 16


def _bounded(rows: DataFrame, n: int, tag: str) -> list:
    return rows.orderBy(F.xxhash64(F.lit(tag), "rid"), "rid").limit(n).collect()


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``rid, v, ids``: each distinct vector with its smallest ids, ``keep`` at most.

    Ids are limited before each shuffle and in salted parts first, so copies never meet in one task.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("v", "salt").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    few = salted.withColumn("n", F.row_number().over(part)).where(F.col("n") <= keep)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= keep)
    return few.groupBy("v").agg(F.min("id").alias("rid"), F.sort_array(F.collect_list("id")).alias("ids"))


class Curves:
    """Keys of points on all curves. Small, made on the driver from a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int):
        random = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.longest = longest
        self.ways = [random.normal(size=(d, DIRECTIONS)) for _ in range(CURVES)]
        self.shifts = random.random((CURVES, DIRECTIONS))
        points = self.lifted(sample)
        grid = np.linspace(0, 1, 257)
        self.grid = grid
        self.scales = [np.quantile(points @ way, grid, axis=0) for way in self.ways]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))
        return np.concatenate([v, rest[:, None]], 1)

    def sought(self, q: np.ndarray) -> np.ndarray:
        q = q / np.sqrt((q * q).sum(1))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], 1)

    def keys(self, points: np.ndarray) -> Iterator[np.ndarray]:
        for way, scale, shift in zip(self.ways, self.scales, self.shifts):
            z = points @ way
            u = np.stack([np.interp(z[:, i], scale[:, i], self.grid) for i in range(DIRECTIONS)], 1)
            cell = ((u + shift) / 2 * (1 << BITS)).astype(np.int64)
            yield hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1), BITS)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row; of scores tied with the last, the first."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    take = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(scores, take, 1).min(1)[:, None]
    for i in np.flatnonzero((scores >= last).sum(1) > k):
        above, tied = np.flatnonzero(scores[i] > last[i]), np.flatnonzero(scores[i] == last[i])
        take[i] = np.concatenate([above, tied[: k - len(above)]])
    return take


def _top(q_ids, q, ids, v, k: int, bound=None) -> pa.RecordBatch:
    """The ``k`` best of each query, those below its ``bound`` left out."""
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    scores = q @ v.T
    take = best(scores, k)
    n = take.shape[1]
    row, column = np.repeat(np.arange(len(q)), n), take.ravel()
    exact = np.zeros(len(row))
    for i in range(q.shape[1]):  # in order, so the sum does not depend on the block
        exact += q[row, i] * v[column, i]
    if bound is not None:  # a rounding error below it is kept
        enough = exact >= bound[row] - 1e-9 * np.abs(bound[row])
        row, column, exact = row[enough], column[enough], exact[enough]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(q_ids[row]),
            pa.array(ids[column]),
            pa.array(exact),
        ],
        ["qid", "rid", "score"],
    )


def _ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def exact(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """``qid, rid, score`` of a bounded list of query rows against every row of ``vectors``."""
    q_ids = np.array([r["rid"] for r in queries], np.int64)
    q = np.array([r["v"] for r in queries], np.float64)

    def search(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield _top(q_ids, q, ids, matrix(batch.column(1)), k)

    rows = vectors.select("rid", "v").mapInArrow(search, "qid long, rid long, score double")
    return _ranked(rows, "qid", k).drop("place")


def _places(vectors: DataFrame, queries: DataFrame, curves: Curves) -> DataFrame:
    """``curve, place, query, rid, v``: all vectors and query marks on every curve, by their rank."""
    shared = vectors.sparkSession.sparkContext.broadcast(curves)

    def key(batches):
        own = shared.value
        for batch in batches:
            v = matrix(batch.column(1))
            query = batch.column(2).to_numpy(zero_copy_only=False)
            points = np.where(query[:, None], own.sought(v), own.lifted(v))
            for c, keys in enumerate(own.keys(points)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(v), c, np.int32)),
                        pa.array(keys),
                        batch.column(2),
                        batch.column(0),
                        lists(v),
                    ],
                    ["curve", "key", "query", "rid", "v"],
                )

    both = vectors.select("rid", "v", F.lit(False).alias("query")).union(
        queries.select("rid", "v", F.lit(True).alias("query"))
    )
    keyed = materialize(
        both.mapInArrow(key, "curve int, key long, query boolean, rid long, v array<double>"), "curve-keys"
    )
    order = ["curve", "key", "rid", "query"]
    # The partition count comes from the session; stating it keeps Spark from merging partitions.
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches):
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy(zero_copy_only=False)
            place = np.zeros(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                here = curve == c
                place[here] = counts.get(c, 0) + np.arange(here.sum())
                counts[c] = counts.get(c, 0) + int(here.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(curve), part, np.int32)),
                    pa.array(place),
                    batch.column(2),
                    batch.column(3),
                    batch.column(4),
                ],
                ["curve", "part", "nth", "query", "rid", "v"],
            )

    schema = "curve int, part int, nth long, query boolean, rid long, v array<double>"
    placed = materialize(ordered.mapInArrow(number, schema), "curve-order")
    sizes = placed.groupBy("curve", "part").count()
    upto = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    return placed.join(F.broadcast(sizes.drop("count")), ["curve", "part"]).select(
        "curve", (F.col("before") + F.col("nth")).alias("place"), "query", "rid", "v"
    )  # at most a row for each curve and partition is broadcast


def _window(places: DataFrame, truth: DataFrame, target: float) -> int:
    """Smallest reach along the curves that meets ``target`` of the true neighbours."""
    marks = places.where("query").select("curve", F.col("rid").alias("qid"), F.col("place").alias("at"))
    truth = F.broadcast(truth)  # AUDIT_QUERIES times k rows at most
    seen = places.where("not query").select("curve", "rid", "place").join(truth, "rid")
    gap = seen.join(marks, ["curve", "qid"]).withColumn("gap", F.abs(F.col("place") - F.col("at")))
    least = gap.groupBy("qid", "rid").agg(F.min("gap").alias("gap"))
    gaps = sorted(r["gap"] for r in least.select("gap").collect())
    return gaps[min(len(gaps) - 1, int(len(gaps) * target))] if gaps else 0


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    vector: str = "embedding",
    row_id: str = "vec_id",
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` its ``k`` nearest others."""
    session = table.sparkSession
    rows = table.where(usable(vector) & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("query")
    )
    rows = same_length(rows, "v").groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    rows = materialize(rows, "vectors")
    vectors = materialize(distinct_vectors(rows.select("id", "v"), k + 1), "distinct-vectors")
    asked = rows.where("query").select(F.col("id").alias("query_id"), "v")
    asked = materialize(
        asked.join(vectors.select("v", "rid"), "v").select("query_id", "rid"), "asked"
    )
    queries = vectors.join(asked.select("rid").distinct(), "rid").select("rid", "v")
    queries = materialize(queries, "query-vectors")
    count = vectors.count()
    n_queries = queries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count or not n_queries:
        return session.createDataFrame([], schema)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = vectors.agg(F.max(norm)).first()[0]
    sample = np.array([r["v"] for r in _bounded(vectors.select("rid", "v"), SCALE_SAMPLE, "scale")])
    places = _places(vectors, queries, Curves(sample, longest, seed))
    audit = _bounded(queries, AUDIT_QUERIES, "audit")
    truth = materialize(exact(vectors, audit, k + 1).select("qid", "rid"), "audit-truth")
    reach = _window(places, truth, TARGET)

    total = count + n_queries
    per_block = n_queries * min(1.0, (2 * reach + 2 * BLOCK) / total)
    parts = max(1, int(np.ceil(per_block / QUERIES_AT_ONCE)))
    block = lambda at: F.floor(at / BLOCK).cast("long")
    held = places.where("not query").select(
        "curve",
        block(F.col("place")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        "rid",
        "v",
    )
    marks = places.where("query").drop("query").toDF("on_curve", "at", "qid", "q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        if not left.num_rows or not right.num_rows:
            left, right = left.slice(0, 0), right.slice(0, 0)
            return pa.table({"qid": right["qid"], "rid": left["rid"], "score": right["bound"]})
        queries = column(right, "qid"), matrix(right.column("q"))
        rows = column(left, "rid"), matrix(left.column("v"))
        return pa.Table.from_batches([_top(*queries, *rows, k + 1, column(right, "bound"))])

    def visit(sent: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
        sent = sent.select("on_curve", "to_block", part.alias("to_part"), "qid", "q", "bound")
        met = (
            held.groupBy("curve", "block", "part")
            .cogroup(sent.groupBy("on_curve", "to_block", "to_part"))
            .applyInArrow(meet, "qid long, rid long, score double")
        )
        return met.groupBy("qid", "rid").agg(F.max("score").alias("score"))

    least = F.lit(float("-inf"))
    home = marks.withColumn("to_block", block(F.col("at"))).withColumn("bound", least)
    near = materialize(_ranked(visit(home), "qid", k + 1).drop("place"), "nearest-at-home")
    bound = near.groupBy("qid").agg(
        F.when(F.count("*") > k, F.min("score")).otherwise(least).alias("bound")
    )
    lo = F.greatest(F.col("at") - reach, F.lit(0))
    hi = F.least(F.col("at") + reach, F.lit(total))
    away = marks.withColumn("to_block", F.explode(F.sequence(block(lo), block(hi))))
    away = away.where(F.col("to_block") != block(F.col("at")))
    away = away.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", least))
    found = near.union(visit(away))
    found = found.groupBy("qid", "rid").agg(F.max("score").alias("score"))
    nearest = materialize(_ranked(found, "qid", k + 1).drop("place"), "nearest")
    answers = asked.withColumnRenamed("rid", "qid").join(nearest, "qid")
    answers = answers.join(vectors.select("rid", "ids"), "rid")
    answers = answers.select("query_id", F.explode("ids").alias("rid"), "score").where("rid != query_id")
    return _ranked(answers, "query_id", k).select(
        "query_id", F.col("place").alias("rank"), F.col("rid").alias("vec_id"), "score"
    )
