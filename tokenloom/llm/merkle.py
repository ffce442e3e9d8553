"""Operator 11: a Merkle manifest of a dataset, with an inclusion proof for every row.

Every node carries the interval ``[lo, hi)`` of leaf ranks it covers, so no pointers are kept: an
ancestor of a leaf is a node whose interval holds the leaf's rank, and the siblings on the way are
the parts of the parent's interval outside the child's. Nodes lie in bands of ``BAND`` levels, and in
buckets of ``ARITY ** BAND`` nodes inside a band. A bucket's rows meet in one task: they become the
band's nodes, and a containment join gives each subject (a node at the band's foot) its ancestors
there. Proofs of a band end where those of the next one start, so a leaf's proof is that of its
bucket with a few steps in front, and the long part is made once per bucket.

A leaf's rank within its tree comes from a range sort that is written down: place in the partition
plus the rows of the tree in earlier partitions. A tree with a third of all rows is spread like any.

Defined results: null values hash as ``-``, any other value as its UTF-8 byte count, ``:`` and the
value. Rows without an id come first and are never tampered with; rows with one id are ordered by
leaf; equal rows are leaves of their own, side by side. The null source is a tree like any other, the first. A tree of
one leaf has that leaf as its subroot; one source's subroot is the root. An empty table has no rows
and no root. Empty and very long texts are hashed whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import join_checked, materialize

ARITY = 3
BAND = 4  # levels whose nodes meet in one task: buckets of 3 ** 4 nodes
ROWS_PER_TASK = 200_000  # narrow rows of one sorted partition
PLACE = (1 << 33) - 1  # bits of monotonically_increasing_id that count rows within a partition


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(name: str) -> Column:
    value = F.col(f"`{name}`").cast("string")
    length = F.octet_length(value).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), value), F.lit("-"))


def leaf(fields: list[str]) -> Column:
    """The digest of a row: each value with its length in front, so no two rows spell the same."""
    return digest(F.concat(*[field(f) for f in fields]))


def _inside(rank: Column, lo: Column, hi: Column) -> Column:
    return (lo <= rank) & (rank < hi)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``lo``, the rank within ``tree`` by ``order``, and ``leaves``, the tree's size."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, rows.count() // ROWS_PER_TASK + 1)
    laid = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    laid = laid.withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(PLACE)}
    )
    laid = materialize(laid, "leaves-sorted")
    runs = laid.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "tree",
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(tree).alias("leaves"),
    )
    runs = materialize(runs, "leaf-runs")  # a row per partition, and one more per tree
    joined = join_checked(laid, runs, ["tree", "part"])
    return joined.withColumn("lo", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def band(feet: DataFrame, width: int) -> DataFrame:
    """All nodes above ``feet`` (``tree, leaves, lo, hi, digest``; ``width`` leaves each) in a band.

    A level's node hashes the digests of up to ``ARITY`` nodes below it. A tree that has come down
    to one node keeps it as it is (``real`` is false): its digest is the top of the tree.
    """
    reach = width * ARITY**BAND
    nodes = feet.withColumn("bucket", F.expr(f"lo div {reach}")).repartition("tree", "bucket")
    levels = []
    for step in range(BAND):
        below = width * ARITY**step
        child = F.struct("lo", "hi", "digest")
        families = nodes.groupBy("tree", "leaves", "bucket", F.expr(f"lo div {below * ARITY}").alias("at")).agg(
            F.array_sort(F.collect_list(child)).alias("children")
        )
        real = F.col("leaves") > below
        made = digest(F.array_join("children.digest", ""))
        nodes = families.select(
            "tree",
            "leaves",
            "bucket",
            F.array_min("children.lo").alias("lo"),
            F.array_max("children.hi").alias("hi"),
            F.when(real, made).otherwise(F.get("children.digest", F.lit(0))).alias("digest"),
            F.lit(step).alias("step"),
            real.alias("real"),
            "children",
        )
        levels.append(nodes)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def ancestors(subjects: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``subjects`` with ``bucket`` and ``steps``: per ancestor in this band, from below, the digests
    of the siblings to the left and to the right."""
    keyed = subjects.withColumn("bucket", F.expr(f"lo div {width * ARITY**BAND}"))
    above = nodes.where("real").select(
        "tree", "bucket", "step", F.col("lo").alias("from"), F.col("hi").alias("to"), "children"
    )
    met = keyed.alias("s").join(
        above.alias("n"),
        (F.col("s.tree") == F.col("n.tree"))
        & (F.col("s.bucket") == F.col("n.bucket"))
        & _inside(F.col("s.lo"), F.col("n.from"), F.col("n.to")),
        "left",
    )
    rank = F.col("s.lo")

    def beside(keep) -> Column:
        found = F.filter("children", lambda c: keep(c) & ~_inside(rank, c["lo"], c["hi"]))
        return F.array_join(F.transform(found, lambda c: c["digest"]), "")

    step = F.struct(
        "step", beside(lambda c: c["hi"] <= rank).alias("left"), beside(lambda c: c["lo"] > rank).alias("right")
    )
    others = [c for c in subjects.columns if c not in ("tree", "lo")]
    return met.groupBy("s.tree", "s.bucket", "s.lo").agg(
        *[F.first(F.col(f"s.{c}")).alias(c) for c in others],
        F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), step))).alias("steps"),
    )


STEPS = "array<struct<left:string,right:string>>"


def _plain(steps: str) -> Column:
    return F.transform(steps, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))


class Forest:
    """The trees over ``leaves`` (``tree, leaves, lo, digest``, and what else a leaf carries)."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves
        self.bands: list[tuple[int, DataFrame, DataFrame]] = []
        most = leaves.agg(F.max("leaves")).first()[0] or 0
        feet = leaves.select("tree", "leaves", "lo", (F.col("lo") + 1).alias("hi"), "digest")
        width = 1
        while width < most:
            nodes = materialize(band(feet, width), "tree-nodes")
            self.bands.append((width, feet, nodes))
            feet = nodes.where(F.col("step") == BAND - 1).select(*feet.columns)
            width *= ARITY**BAND
        self.tops = feet.select("tree", "digest")  # one node per tree is left

    def proofs(self, onward: DataFrame) -> DataFrame:
        """Each leaf with ``steps`` from it to the top of its tree and on.

        ``onward`` has one row per tree: ``tree``, ``steps`` above the top, and what else belongs to
        the tree; its columns are handed down to the leaves.
        """
        handed = [c for c in onward.columns if c not in ("tree", "steps")]
        above = onward.withColumn("at", F.lit(0).cast("long"))
        for width, feet, nodes in reversed(self.bands[1:]):
            own = ancestors(feet.select("tree", "lo"), nodes, width)
            below = width  # a foot is the only end of the bucket of its number in the band below
            above = self._joined(own, above, handed).select(
                "tree", F.expr(f"lo div {below}").alias("at"), "steps", *handed
            )
            above = materialize(above, "tree-proofs")
        if not self.bands:
            return self.leaves.join(above.drop("at"), "tree")
        width, _, nodes = self.bands[0]
        return self._joined(ancestors(self.leaves, nodes, width), above, handed)

    @staticmethod
    def _joined(own: DataFrame, above: DataFrame, handed: list[str]) -> DataFrame:
        upper = above.withColumnRenamed("steps", "upper").withColumnRenamed("at", "bucket")
        rows = own.join(upper, ["tree", "bucket"])
        return rows.withColumn("steps", F.concat(_plain("steps"), "upper")).drop("upper", "bucket")


def fold(start: Column, steps: str) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def proof_digest(steps: str) -> Column:
    """One digest of all siblings on the way, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, fields: list[str], row_id: str, source: str, altered: dict[str, Column]) -> DataFrame:
    """Proofs of all rows: ``row_id, leaf, changed, subroot, root, steps``.

    ``fields`` are hashed, in this order. ``altered`` gives other values for some of them;
    ``changed`` is the leaf with those. Trees are per ``source``, and one more is over their tops.
    """
    chosen = docs.select(*dict.fromkeys([row_id, source, *fields]))
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    leaves = chosen.select(
        F.col(row_id), key.alias("tree"), leaf(fields).alias("digest"), chosen_leaf(chosen, fields, altered)
    ).select(F.struct(row_id, "changed").alias("own"), "tree", "digest")
    leaves = materialize(leaves.withColumn("id", F.col("own")[row_id]), "leaves")
    trees = Forest(materialize(ranked(leaves, ["id", "digest"]).drop("id"), "leaf-ranks"))
    tops = trees.tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source_key"))
    upper = Forest(materialize(ranked(materialize(tops, "subroots"), ["source_key"]), "subroot-ranks"))
    no_steps = F.array().cast(STEPS)
    root = upper.tops.select("tree", no_steps.alias("steps"), F.col("digest").alias("root"))
    onward = upper.proofs(root).select(
        F.col("source_key").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"
    )
    proofs = trees.proofs(materialize(onward, "source-proofs"))
    return proofs.select(
        F.col("own")[row_id].alias(row_id),
        F.col("digest").alias("leaf"),
        F.col("own")["changed"].alias("changed"),
        "subroot",
        "root",
        "steps",
    )


def chosen_leaf(rows: DataFrame, fields: list[str], altered: dict[str, Column]) -> Column:
    """The leaf with the altered values, null where they change nothing."""
    def spelled(name: str) -> Column:
        value = altered[name].cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    whole = digest(F.concat(*[spelled(f) if f in altered else field(f) for f in fields]))
    same = F.lit(True)
    for name, value in altered.items():
        same = same & value.eqNullSafe(F.col(name))
    return F.when(~same, whole).alias("changed")


def verified(docs: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Proof of every row, and whether a copy that lost its line ends is still proved by it.

    The copies of rows whose id has an even unsigned CRC-32 (as decimal text) lose all ``\\n``.
    """
    fields = [row_id, source, "lang", "n_chars", text]
    even = F.crc32(F.col(row_id).cast("string").cast("binary")) % 2 == 0
    bare = F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    found = manifest(docs, fields, row_id, source, {text: bare})
    return found.select(
        row_id,
        "leaf",
        "subroot",
        "root",
        proof_digest("steps").alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), "steps").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
