"""Operator 12: centroid clustering on packed bit planes.

A vector of 64 integers is stored as its bit planes: plane ``b`` is one 64-bit word that holds bit
``b`` of every component, and the last plane is the sign (two's complement, weight ``-2**b``). The
dot product of two vectors is then a sum over pairs of planes of ``weight * popcount(a & b)``: exact,
in integers, and so are squared distances. Only the packed planes are written and read again by the
rounds; a round brings back sums per centroid and component, added up in tasks before the shuffle,
so neither the number of rows nor the size of a cluster matters to any single task.

Components become ``floor(scale * x)``. Kept are vectors with exactly ``DIMS`` components, none null
or non-finite, none of a magnitude of ``2**27`` after scaling (a squared distance would not fit a
long). Others, null and empty vectors included, have no row in the result.

Defined results: zero vectors count like any. Rows with one id, or none, are vectors of their own
and start centroids in the order of id and planes on a tie. With fewer vectors than ``k`` every vector
starts a centroid. Equal distances go to the smaller number; a centroid without vectors stays where
it is. An empty table gives an empty one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize
from tokenloom.llm.vectors import lists

DIMS = 64  # components of a vector: one bit of each makes a word
MOST_BITS = 27  # of a scaled component, without its sign


def scaled(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def kept(vector: str, scale: int) -> Column:
    most = float(1 << MOST_BITS)
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale).cast("double")) < most),
    )
    return F.coalesce((F.size(vector) == DIMS) & fine, F.lit(False))


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane is worth; the last one is the sign."""
    out = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def pack(rows: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (``n x planes`` words) of a matrix of integers (``n x DIMS``)."""
    bits = (rows[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers of packed rows."""
    return np.tensordot(_bits(words), weights(words.shape[1]), axes=(1, 0))


def _bits(words: np.ndarray) -> np.ndarray:
    """``n x planes x DIMS`` bits."""
    n, planes = words.shape
    parts = np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(n, planes, 8)
    return np.unpackbits(parts, axis=2, bitorder="little").astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of packed rows with packed rows, modulo 2**64."""
    out = np.zeros((len(a), len(b)), np.int64)
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]) * (wa[i] * wb[j])
    return out


def norms(a: np.ndarray) -> np.ndarray:
    """Dot product of every packed row with itself."""
    out = np.zeros(len(a), np.int64)
    w = weights(a.shape[1])
    for i in range(a.shape[1]):
        for j in range(a.shape[1]):
            out += np.bitwise_count(a[:, i] & a[:, j]) * (w[i] * w[j])
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one on a tie, and the squared distance to it."""
    distance = norms(rows)[:, None] - 2 * dots(rows, centroids) + norms(centroids)[None, :]
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(rows)), cluster]


def packed(table: DataFrame, vec_id: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """A written table of ``vec_id, planes``, and the number of planes: as many as the data need."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(kept("v", scale))
    rows = rows.select("vec_id", scaled("v", scale).alias("v"))
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    planes = 1 + max((-low - 1).bit_length() if low < 0 else 0, max(high, 0).bit_length()) if low is not None else 1

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists(pack(whole, planes).view(np.int64))], ["vec_id", "planes"]
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(words, f"vec_id {kind}, planes array<bigint>"), "bit-planes"), planes


def _words(column: pa.Array, planes: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(-1, planes)


def starts(table: DataFrame, planes: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (a parameter, so few) whose ids hash lowest, packed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = table.orderBy(F.sha2(named, 256), "vec_id", "planes").limit(k).collect()
    return np.array([r["planes"] for r in first], np.int64).view(np.uint64).reshape(-1, planes)


def sums(table: DataFrame, centroids: np.ndarray) -> list:
    """``cluster, n, at, total``: rows and component sums of every centroid that has vectors.

    A task adds up all it reads; what it hands on are at most ``k`` rows.
    """
    k, planes = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _words(batch.column(0), planes)
            cluster, _ = nearest(rows, centroids)
            member = (cluster[None, :] == np.arange(k)[:, None]).astype(np.int64)
            count += member.sum(1)
            total += np.tensordot(np.tensordot(member, _bits(rows), axes=(1, 0)), weights(planes), axes=(1, 0))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(count[met]), lists(total[met])], ["cluster", "n", "total"]
        )

    each = table.select("planes").mapInArrow(add, "cluster int, n bigint, total array<bigint>")
    parts = each.select("cluster", "n", F.posexplode("total").alias("at", "x"))
    return (
        parts.groupBy("cluster", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
        .collect()
    )


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid with vectors goes to their mean, rounded down."""
    values = unpack(centroids)
    for r in sums(table, centroids):
        values[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return pack(values, centroids.shape[1])


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every packed vector."""
    planes = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_words(batch.column(1), planes), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(label, f"vec_id {kind}, cluster int, distance bigint")


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """``cluster, centroid``: the components of every centroid, ``k`` rows."""
    rows = [(i, [int(x) for x in row]) for i, row in enumerate(unpack(centroids))]
    return spark.createDataFrame(rows, "cluster int, centroid array<bigint>")


def fit(table: DataFrame, planes: int, k: int, rounds: int, seed: int) -> np.ndarray:
    """The centroids, packed, after so many rounds over a packed table."""
    centroids = starts(table, planes, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids)
    return centroids


def cluster(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    scale: int = 64,
) -> DataFrame:
    """``vec_id, cluster, distance``, the summed distance of the cluster and of all
    (``cluster_inertia, inertia``), and the SHA-256 of the centroid's components."""
    spark = table.sparkSession
    words, planes = packed(table, vec_id, vector, scale)
    centroids = fit(words, planes, k, rounds, seed)
    rows = materialize(assigned(words, centroids), "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    spelled = [",".join(str(int(x)) for x in row) for row in unpack(centroids)]
    facts = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(spelled[c].encode()).hexdigest()) for c in sorted(inertia)
    ]
    small = spark.createDataFrame(
        facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return rows.join(F.broadcast(small), "cluster")  # k rows at most
