"""Operator 1: mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key, so equal key ranges of a source are equal shares of it. Sizes are
summed per source and key range, range sums are accumulated in two levels, and the range where a
source's budget runs out is the only one whose rows are put in order. What is left is one cut key
per source: taking a row or not is then a comparison, and texts are neither sorted nor moved.

A source whose budget is larger than itself is repeated: whole epochs first, then a partial one.

Defined results: null text has size 0; the null source is a source, the last in order; an empty
table gives an empty one; a source without words has target 0. Rows with the same id (or no id)
share one key and share the words at a cut in proportion to their size, rounded down. Extra columns
pass through ``apply_mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, join_checked, materialize

KEY_BITS = 60
RANGE_ROWS = 256  # rows of a key range, on average over all sources
RANGES_PER_BLOCK = 4096  # ranges whose sums one task accumulates


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row_id: str, seed: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    digits = F.substring(F.md5(named.cast("binary")), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_key(source: str) -> Column:
    """The source as a value that is never null, so that joins meet the null source too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Word targets per source: shares by weight, none above ``cap`` times its source.

    Sources at their cap give the excess to the others by weight. With sources ordered by the level
    at which they reach their cap, the level that spends everything has a closed form in running
    sums. ``sizes`` has one row per source (``skey, source, source_size``).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    reach = Window.orderBy("full_at", "skey")
    ranked = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place") + 1)
    )
    capped = ranked.withColumn("most", cap * F.col("source_size")).withColumn(
        "full_at", F.col("most") / F.col("weight")
    )
    upto = reach.rowsBetween(Window.unboundedPreceding, -1)
    onward = reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))
    return levels.withColumn("spent", F.min(fits).over(total)["level"]).select(
        "skey",
        "source_size",
        F.least(
            F.col("most"), F.coalesce(F.col("spent") * F.col("weight"), F.col("most"))
        ).alias("target"),
    )


def _ranges(n_rows: int) -> int:
    """Bits of a key range's number: about ``RANGE_ROWS`` rows of the whole table each."""
    return max(0, min(KEY_BITS - 1, (max(1, n_rows) // RANGE_ROWS).bit_length()))


def cuts(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: ``skey, source_size, target, epochs, cut, piece, weight_at_cut``.

    Rows with a key below ``cut`` are taken once more than ``epochs``; those at ``cut`` have
    ``piece`` words between them. ``sized`` is a written table of ``skey, source, key, size``.
    """
    bits = _ranges(sized.count())
    per = RANGES_PER_BLOCK.bit_length() - 1
    number = F.shiftrightunsigned("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")
    ranged = sized.withColumn("range", number)
    sums = materialize(
        ranged.groupBy("skey", "range")
        .agg(F.sum("size").alias("words"), F.first("source").alias("source"))
        .withColumn("block", F.shiftrightunsigned("range", per)),
        "range-sums",
    )
    sizes = sums.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("words").alias("source_size")
    )
    budget = (
        targets(sizes, weights, cap)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("epochs", F.coalesce(F.expr("words div source_size"), F.lit(0).cast("long")))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
        .drop("words")
    )
    budget = materialize(budget, "budgets")

    def crossing(rows: DataFrame, by: list[str], at: str) -> DataFrame:
        """The rows at which the running sum within ``by`` passes the rest of the budget."""
        before = F.sum("words").over(
            Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        )
        run = rows.withColumn("run", F.col("before") + F.coalesce(before, F.lit(0)))
        inside = (F.col("run") <= F.col("rest")) & (F.col("rest") < F.col("run") + F.col("words"))
        return run.where(inside).drop("before", "words").withColumnRenamed("run", "before")

    blocks = sums.groupBy("skey", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.join(budget.select("skey", "rest"), "skey").withColumn("before", F.lit(0))
    found = crossing(blocks, ["skey"], "block")
    found = sums.select("skey", "block", "range", "words").join(found, ["skey", "block"])
    found = materialize(crossing(found, ["skey"], "range").drop("block"), "crossed-ranges")
    rows = join_checked(ranged.select("skey", "range", "key", "size"), found, ["skey", "range"])
    rows = rows.groupBy("skey", "key").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    last = crossing(rows.withColumn("weight_at_cut", F.col("words")), ["skey"], "key").select(
        "skey",
        F.col("key").alias("cut"),
        (F.col("rest") - F.col("before")).alias("piece"),
        "weight_at_cut",
    )
    return materialize(budget.drop("rest").join(last, "skey", "left"), "cuts")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 17,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Words the mix takes of every row: ``row_id, size, source_size, target, taken``.

    A source's taken words are its target, rounded; at most one key per source is taken in part.
    """
    sized = materialize(
        docs.select(
            F.col(row_id).alias("row"),
            F.col(source).alias("source"),
            source_key(source).alias("skey"),
            random_key(row_id, seed).alias("key"),
            word_count(F.col(text)).alias("size"),
        ),
        "sized",
    )
    rows = join_checked(sized, cuts(sized, weights, cap), "skey")
    share = F.when(F.col("key") < F.col("cut"), F.col("size")).when(
        F.col("key") == F.col("cut"), F.expr("size * piece div weight_at_cut")
    )
    return rows.select(
        F.col("row").alias(row_id),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.coalesce(share, F.lit(0).cast("long"))).alias("taken"),
    )


def apply_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 17,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole: the row at a cut is taken if the
    cut leaves at least half of it. Columns are those of ``docs``."""
    sized = materialize(
        docs.select(
            F.col(source).alias("source"),
            source_key(source).alias("skey"),
            random_key(row_id, seed).alias("key"),
            word_count(F.col(text)).alias("size"),
        ),
        "sized",
    )
    most = F.when(2 * F.col("piece") >= F.col("weight_at_cut"), F.col("cut")).otherwise(F.col("cut") - 1)
    plan = cuts(sized, weights, cap).select(
        F.struct("epochs", F.coalesce(most, F.lit(-1)).alias("upto")).alias("_mix_plan"),
        F.col("skey").alias("_mix_source"),
    )
    plan = materialize(plan, "mix-plan")
    marked = docs.withColumn("_mix_source", source_key(source))
    marked = join_checked(marked, plan, "_mix_source")
    once_more = (random_key(row_id, seed) <= F.col("_mix_plan.upto")).cast("int")
    copies = F.col("_mix_plan.epochs").cast("int") + once_more
    again = marked.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
