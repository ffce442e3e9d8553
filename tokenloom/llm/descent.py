"""Operator 6: embedding near-dedup by NN-descent.

Every vector starts with the neighbours it has in a few random orders (sorted by sign bits, compared
within a sliding window). Then lists are refined: whatever vectors share a neighbour are compared
with one another, and a list takes over what is nearer than its last entry. Rounds end when one
finds no more links, that is pairs at or above the threshold.

A list that is full of links is saturated: it is enlarged to the vector's whole component, compared
in blocks of bounded size. Two vectors whose link is in neither list both have saturated ones, so such
vectors of different components are compared in blocks too, unless middles and radii of the blocks rule
a link out. (Longer lists alone would not find such links: two groups whose lists hold nothing but their own
members share no neighbour, however long the lists are.)

An audit compares ``AUDIT_ROWS`` vectors with every row, in blocks. Half of them are drawn from all; the
others, where links are rare, from those that the graph brings near the threshold, as many of each class:
no link found, one, few, or more than a list holds. As long as fewer than ``TARGET`` of those with one, with
few or with many links have all of them, more orders are added, and after ``EXTRA`` more all vectors are
compared with all, in blocks. Orders and windows grow with the logarithm of the number of vectors.
``measured`` reports the audit with a bound of 95 % confidence for each class.

Equal vectors are one, weighted by their number. Links are verified in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have another
length than most, link with nothing, and neither do rows without an id (their component is null).
Rows that repeat an id are one vector, the least. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize
from tokenloom.llm.components import components
from tokenloom.llm.vectors import lists, matrix, same_length, usable

LIST = 12  # neighbours a vector keeps
REVERSE = 12  # vectors that have it as a neighbour, the nearest ones, in a round
ORDERS = 8
SIGNS = 31
REACH = 12  # places to either side in an order
SCALE = 8192  # vectors from which orders and reach grow, by two for each doubling
FIRST = 6  # neighbours taken from each order
BLOCK = 512  # vectors of a component compared with as many others
AUDIT_ROWS = 2048
CLASSES = 4  # of vectors near the threshold: links found 0, 1, to LIST - 1, more
MARGIN = 0.05  # below the threshold that counts as near it
TARGET = 0.99
EXTRA = 4  # further sets of orders, at most

_PAIRS = "a long, b long, sim float"


def unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(1, keepdims=True)
    v = v / scale  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _pairs(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(sim.astype(np.float32))], ["a", "b", "sim"]
    )


def _nearest(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of each ``a``, every pair once."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _orders(vectors: DataFrame, seed: int) -> DataFrame:
    """Neighbours in random orders: ``a, b, sim``. ``vectors`` has ``rid`` and the unit vector ``u``."""
    more = max(0, math.ceil(math.log2(max(vectors.count(), 1) / SCALE)))
    orders, reach = ORDERS + 2 * more, REACH + 2 * more

    def code(batches):
        ways = None
        for batch in batches:
            u = matrix(batch.column(1))
            if ways is None:
                ways = np.random.default_rng(seed).normal(size=(u.shape[1], orders * SIGNS))
            bits = ((u @ ways) > 0).reshape(len(u), orders, SIGNS)
            codes = bits @ (1 << np.arange(SIGNS)[::-1])
            for t in range(orders):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(u), t, np.int32)),
                        pa.array(codes[:, t].astype(np.int64)),
                        batch.column(0),
                        batch.column(1),
                    ],
                    ["way", "code", "rid", "u"],
                )

    def slide(batches):
        held_way = np.zeros(0, np.int32)
        held_id = np.zeros(0, np.int64)
        held = None
        for batch in batches:
            u = matrix(batch.column(3)).astype(np.float32)
            way = np.concatenate([held_way, batch.column(0).to_numpy()])
            rid = np.concatenate([held_id, batch.column(2).to_numpy()])
            u = u if held is None else np.concatenate([held, u])
            a, b, s = [], [], []
            for step in range(1, min(reach, len(rid) - 1) + 1):
                ok = way[step:] == way[:-step]
                sim = np.einsum("ij,ij->i", u[step:], u[:-step])
                a += [rid[step:][ok], rid[:-step][ok]]
                b += [rid[:-step][ok], rid[step:][ok]]
                s += [sim[ok], sim[ok]]
            if a:
                a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
                order = np.lexsort((-s, a))
                a, b, s = a[order], b[order], s[order]
                first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
                nth = np.arange(len(a)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                few = nth < FIRST
                yield _pairs(a[few], b[few], s[few])
            held_way, held_id, held = way[-reach:], rid[-reach:], u[-reach:]

    keyed = vectors.select("rid", "u").mapInArrow(code, "way int, code long, rid long, u array<float>")
    order = ["way", "code", "rid"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(slide, _PAIRS)


def _local_join(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """Pairs that share a neighbour and are nearer than the end of one's list: ``a, b, sim``."""
    floor = graph.groupBy("a").agg(
        F.when(F.count("*") >= LIST, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor")
    )
    back = _nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), REVERSE)
    around = graph.select("a", "b").union(back.select("a", "b")).distinct()
    members = around.select(F.col("a").alias("hub"), F.col("b").alias("rid"))
    members = members.union(floor.select("a", "a"))
    rows = members.join(vectors.join(floor, vectors["rid"] == floor["a"]).select("rid", "u", "floor"), "rid")
    rows = rows.select("hub", "rid", "u", "floor")

    def meet(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            hub = left.column("hub").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(hub[1:] != hub[:-1]) + 1])
            if len(cuts) > 1:  # the last hub may go on in the next batch
                yield from compare(left.slice(0, int(cuts[-1])), cuts[:-1])
                left = left.slice(int(cuts[-1])).combine_chunks()
        if left is not None and left.num_rows:
            hub = left.column("hub").to_numpy()
            yield from compare(left, np.concatenate([[0], np.flatnonzero(hub[1:] != hub[:-1]) + 1]))

    def compare(rows, cuts):
        u = matrix(rows.column("u")).astype(np.float32)
        rid, floor = rows.column("rid").to_numpy(), rows.column("floor").to_numpy()
        a, b, s = [], [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(rid)]):
            sim = u[lo:hi] @ u[lo:hi].T
            np.fill_diagonal(sim, -3)
            x, y = np.nonzero(sim > floor[lo:hi, None])
            a.append(rid[lo + x])
            b.append(rid[lo + y])
            s.append(sim[x, y])
        yield _pairs(np.concatenate(a), np.concatenate(b), np.concatenate(s))

    return rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(meet, _PAIRS)


def _links(graph: DataFrame, threshold: float) -> int:
    return graph.where(F.col("sim") >= threshold).count()


def graph_of(vectors: DataFrame, threshold: float, seed: int, known: DataFrame | None = None) -> DataFrame:
    """A written neighbour graph ``a, b, sim``: the ``LIST`` nearest found of every vector."""
    start = _orders(vectors, seed)
    start = start if known is None else start.union(known)
    graph = materialize(_nearest(start, LIST).drop("place"), "neighbours")
    links = _links(graph, threshold)
    while True:
        better = graph.union(_local_join(vectors, graph))
        graph = materialize(_nearest(better, LIST).drop("place"), "neighbours")
        now = _links(graph, threshold)
        if now <= links:
            return graph
        links = now


def _verified(vectors: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` with ``a < b``: pairs at or above the threshold in double precision."""
    once = pairs.where(F.col("sim") >= threshold - 1e-3).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    one = vectors.select(F.col("rid").alias("a"), F.col("v").alias("va"))
    two = vectors.select(F.col("rid").alias("b"), F.col("v").alias("vb"))
    both = once.join(one, "a").join(two, "b").select("a", "b", "va", "vb")

    def test(batches):
        for batch in batches:
            sim = np.einsum("ij,ij->i", unit(matrix(batch.column(2))), unit(matrix(batch.column(3))))
            yield batch.select([0, 1]).filter(pa.array(sim >= threshold))

    return both.mapInArrow(test, "a long, b long")


def _enlarged(members: DataFrame, threshold: float) -> DataFrame:
    """``rid, links``: links of every vector of the given components, counted in blocks.

    ``members`` has ``component, rid, v, n`` (``n`` copies). A component of m vectors is cut into
    m / BLOCK parts by a hash, and each pair of parts is one group.
    """
    size = members.groupBy("component").agg(F.count("*").alias("m"))
    cut = members.join(size, "component").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    sent = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select(
        "component",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        "part",
        "rid",
        "n",
        "v",
    )

    def count(table: pa.Table) -> pa.Table:
        part, rid, n = (table.column(c).to_numpy() for c in ("part", "rid", "n"))
        u = unit(matrix(table.column("v")))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near = (u[one] @ u[two].T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            ids, links = rid[one], near @ n[one]
        else:
            ids = np.concatenate([rid[one], rid[two]])
            links = np.concatenate([near @ n[two], near.T @ n[one]])
        return pa.table({"rid": pa.array(ids), "links": pa.array(links.astype(np.int64))})

    counted = sent.groupBy("component", "i", "j").applyInArrow(count, "rid long, links long")
    return counted.groupBy("rid").agg(F.sum("links").alias("links"))


def _sample(vectors: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """``rid, v`` of ``AUDIT_ROWS`` vectors at most: half of them near the threshold, by class."""
    draw = F.xxhash64(F.lit("audit"), "rid")
    held = F.sum((F.col("sim") >= threshold).cast("int"))
    near = graph.groupBy(F.col("a").alias("rid")).agg(F.max("sim").alias("best"), held.alias("held"))
    near = near.where(F.col("best") >= threshold - MARGIN).withColumn(
        "kind", F.when(F.col("held") < 2, F.col("held")).when(F.col("held") < LIST, 2).otherwise(3)
    )
    near = materialize(near, "near-threshold")
    ids = vectors.select("rid").orderBy(draw, "rid").limit(AUDIT_ROWS // 2)
    for kind in range(CLASSES):
        one = near.where(F.col("kind") == kind).select("rid")
        ids = ids.union(one.orderBy(draw, "rid").limit(AUDIT_ROWS // (2 * CLASSES)))
    return vectors.select("rid", "v").join(F.broadcast(ids.distinct()), "rid")


def _true_links(vectors: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """``rid, truth``: links of a bounded sample, by comparing it with every row in blocks."""
    sample = _sample(vectors, graph, threshold).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "rid long, truth long")
    ids = np.array([r["rid"] for r in sample], np.int64)
    mine = unit(np.array([r["v"] for r in sample], np.float64))

    def count(batches):
        for batch in batches:
            rid, v, n = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
            near = ((mine @ unit(v).T) >= threshold) & (ids[:, None] != rid[None])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near @ n).astype(np.int64))], ["rid", "truth"])

    found = vectors.select("rid", "v", "n").mapInArrow(count, "rid long, truth long")
    return materialize(found.groupBy("rid").agg(F.sum("truth").alias("truth")), "audit")


def _blocks(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``rid, links, to``: links of every vector across the given pairs of blocks, counted, and the least id they reach.

    ``rows`` has ``block, rid, v, n`` and ``pairs`` has ``i, j``; with ``i = j`` a block meets itself.
    """
    here = rows.join(pairs.withColumn("block", F.col("i")), "block")
    there = rows.join(pairs.where("i != j").withColumn("block", F.col("j")), "block")
    sent = here.union(there).select("i", "j", "block", "rid", "v", "n")

    def count(table: pa.Table) -> pa.Table:
        block, rid, n = (table.column(c).to_numpy() for c in ("block", "rid", "n"))
        u = unit(matrix(table.column("v")))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (u[one] @ u[two].T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        last = np.iinfo(np.int64).max
        label, before = rid.copy(), None
        while before is None or (label != before).any():  # the least id that these links reach
            before = label.copy()
            low = np.where(near, label[two][None], last).min(1, initial=last)
            label[one] = np.minimum(label[one], low)
            low = np.where(near, label[one][:, None], last).min(0, initial=last)
            label[two] = np.minimum(label[two], low)
        found = []
        for mine, others, hit in [(one, two, near), (two, one, near.T)][: 1 + (i != j)]:
            some = hit.any(1)
            found.append((rid[mine][some], (hit @ n[others])[some], label[mine][some]))
        a, links, to = (np.concatenate(x) for x in zip(*found))
        return pa.table({"rid": pa.array(a), "links": pa.array(links.astype(np.int64)), "to": pa.array(to)})

    return sent.groupBy("i", "j").applyInArrow(count, "rid long, links long, to long")


def _meetings(blocks: DataFrame) -> DataFrame:
    """``i, j``: every pair of ``blocks`` once, each with itself too."""
    one, two = blocks.select(F.col("block").alias("i")), blocks.select(F.col("block").alias("j"))
    return one.crossJoin(two).where(F.col("i") <= F.col("j"))


def _between(vectors: DataFrame, edges: DataFrame, reach: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that join components. A link that no list holds is one of two full lists, so the
    vectors with full lists are compared across components, in blocks.

    Blocks are parts of one component. Two are compared if their middles are no further apart than
    their radii and the angle of a link, which leaves out none.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = both.groupBy("a").agg(F.count("*").alias("entries")).where(F.col("entries") >= LIST)
    full = full.select(F.col("a").alias("rid")).join(reach.withColumnRenamed("id", "rid"), "rid")
    size = full.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = full.join(size, "component").join(vectors.select("rid", "v", "n"), "rid")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    rows = rows.withColumn("block", F.concat_ws(":", "component", "part"))
    rows = materialize(rows.select("block", "component", "rid", "v", "n"), "full-lists")

    def middle(table: pa.Table) -> pa.Table:
        u = unit(matrix(table.column("v")))
        mid = u.sum(0)
        mid = unit(mid[None])[0] if np.abs(mid).max() > 0 else u[0]
        radius = float(np.arccos(np.clip(u @ mid, -1, 1)).max())
        return table.slice(0, 1).select(["block", "component"]).append_column(
            "mid", lists(mid[None])
        ).append_column("radius", pa.array([radius]))

    mids = rows.groupBy("block").applyInArrow(middle, "block string, component long, mid array<double>, radius double")
    mids = materialize(mids, "middles")
    cut = mids.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-mids.count() // BLOCK)))).cast("int"))
    cut = materialize(cut, "middles-in-parts")
    parts = _meetings(cut.select(F.col("part").alias("block")).distinct())
    here = cut.join(parts.withColumn("part", F.col("i")), "part")
    there = cut.join(parts.where("i != j").withColumn("part", F.col("j")), "part")

    def close(table: pa.Table) -> pa.Table:
        part, component, radius = (table.column(c).to_numpy() for c in ("part", "component", "radius"))
        name, u = np.array(table.column("block").to_pylist(), object), matrix(table.column("mid"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
        angle = np.arccos(np.clip(u[one] @ u[two].T, -1, 1))
        most = radius[one][:, None] + radius[two][None] + np.arccos(threshold) + 1e-6
        ok = (angle <= most) & (component[one][:, None] != component[two][None])
        x, y = np.nonzero(ok)
        a, b = name[one[x]], name[two[y]]
        once = a < b if i == j else np.ones(len(a), bool)
        return pa.table({"i": pa.array(a[once], pa.string()), "j": pa.array(b[once], pa.string())})

    near = here.unionByName(there).groupBy("i", "j").applyInArrow(close, "i string, j string")
    near = materialize(near, "blocks-in-reach")
    found = _blocks(rows, near, threshold)
    found = found.select(F.least("rid", "to").alias("a"), F.greatest("rid", "to").alias("b")).where("a != b").distinct()
    return found.join(edges, ["a", "b"], "left_anti")


def _exact(vectors: DataFrame, threshold: float) -> DataFrame:
    """What ``_judge`` returns, by comparing all with all in blocks."""
    parts = max(1, -(-vectors.count() // (4 * BLOCK)))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    pairs = _meetings(rows.select("block").distinct())
    found = materialize(_blocks(rows.select("block", "rid", "v", "n"), pairs, threshold), "counted")
    reach = components(found.select(F.least("rid", "to").alias("a"), F.greatest("rid", "to").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    return materialize(
        links.join(reach.withColumnRenamed("id", "rid"), "rid").select("rid", "component", "links"), "judged"
    )


def _shares(truth: DataFrame, judged: DataFrame) -> DataFrame:
    """``kind, n, whole``: per class of their number of links, sampled vectors with a link and those with all found."""
    whole = F.coalesce("links", F.lit(0)) >= F.col("truth")
    kind = F.when(F.col("truth") < 2, 1).when(F.col("truth") < LIST, 2).otherwise(3)
    shares = truth.where("truth > 0").join(judged, "rid", "left").groupBy(kind.alias("kind"))
    return shares.agg(F.count("*").alias("n"), F.sum(whole.cast("long")).alias("whole"))


def _met(truth: DataFrame, judged: DataFrame) -> bool:
    """Whether ``TARGET`` of the sampled vectors have all their links, in each class of their number."""
    return all(r["whole"] >= TARGET * r["n"] for r in _shares(truth, judged).collect())


def _surely(whole: int, n: int) -> float:
    """Lower end of Wilson's interval for a share, at 95 % confidence on this side."""
    z, share = 1.645, whole / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _judge(vectors: DataFrame, graph: DataFrame, threshold: float, seed: int) -> DataFrame:
    """``rid, component, links``: written, for the vectors with a link."""
    edges = materialize(_verified(vectors, graph, threshold), "links")
    reach = materialize(components(edges), "components")
    more = materialize(_between(vectors, edges, reach, threshold), "more-links")
    if more.count():
        edges = materialize(edges.union(more), "links")
        reach = materialize(components(edges), "components")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = vectors.select(F.col("rid").alias("b"), "n")
    listed = both.join(weight, "b").groupBy("a").agg(
        F.sum("n").alias("links"), F.count("*").alias("entries")
    )
    listed = materialize(
        listed.withColumnRenamed("a", "rid").join(reach.withColumnRenamed("id", "rid"), "rid"), "listed"
    )
    full = listed.where(F.col("entries") >= LIST).select("component").distinct()
    full = materialize(full, "saturated")
    members = listed.select("rid", "component").join(full, "component")
    members = members.join(vectors.select("rid", "v", "n"), "rid").select("component", "rid", "v", "n")
    larger = _enlarged(members, threshold).withColumnRenamed("links", "all_links")
    out = listed.join(larger, "rid", "left")
    return materialize(
        out.select("rid", "component", F.coalesce("all_links", "links").alias("links")), "judged"
    )


def near_duplicates(
    table: DataFrame, threshold: float = 0.9, vector: str = "embedding", row_id: str = "vec_id", seed: int = 5
) -> DataFrame:
    """One row per id: ``row_id, n_links, component_id, kept``."""
    everyone, rows, vectors = _distinct(table, vector, row_id)
    _, judged = _found(vectors, threshold, seed)
    member = rows.join(vectors.select("v", "rid", "n"), "v").select("id", "rid", "n")
    out = member.join(judged, "rid", "left").select(
        "id",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "rid").alias("component"),
    )
    out = everyone.join(out, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(row_id),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def measured(
    table: DataFrame, threshold: float = 0.9, vector: str = "embedding", row_id: str = "vec_id", seed: int = 5
) -> dict[int, tuple[int, float, float]]:
    """What the audit finds: per class of vectors (1: with one link, 2: with fewer than a list holds, 3: with
    more) how many were sampled, the share of them with all their links, and a lower bound of it."""
    truth, judged = _found(_distinct(table, vector, row_id)[2], threshold, seed)
    return {r["kind"]: (r["n"], r["whole"] / r["n"], _surely(r["whole"], r["n"])) for r in _shares(truth, judged).collect()}


def _distinct(table: DataFrame, vector: str, row_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All ids; ``id, v`` of the rows that take part; and their distinct vectors."""
    everyone = table.select(F.col(row_id).cast("long").alias("id")).distinct()
    rows = table.where(usable(vector) & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    rows = same_length(rows, "v").groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows, "vectors")
    distinct = rows.groupBy("v").agg(F.min("id").alias("rid"), F.count("*").alias("n"))

    def shrink(batches):
        for batch in batches:
            u = lists(unit(matrix(batch.column(0))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(0), u], ["rid", "n", "v", "u"]
            )

    distinct = distinct.select("v", "rid", "n").mapInArrow(
        shrink, "rid long, n long, v array<double>, u array<float>"
    )
    vectors = materialize(distinct, "distinct-vectors")
    return everyone, rows, vectors


def _found(vectors: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The audit's ``rid, truth``, and ``rid, component, links`` that meet it."""
    graph = truth = None
    for extra in range(1 + EXTRA):
        graph = graph_of(vectors, threshold, seed + 100 * extra, graph)
        if truth is None:
            truth = _true_links(vectors, graph, threshold)
        judged = _judge(vectors, graph, threshold, seed)
        if _met(truth, judged):
            return truth, judged
    return truth, _exact(vectors, threshold)
