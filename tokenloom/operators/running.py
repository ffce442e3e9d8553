"""Running totals over an ordered table without sending it through one task.

Input order is data here: budgets, first-wins and packing follow an order column. A window without
a partition key, or with one as coarse as the split, would put nearly all rows in one task. Instead
the order column is cut into chunks of similar row count, totals are taken per chunk (partial
aggregation, one small row per chunk), and only the small table of chunk totals is scanned in
order. A hot group spreads over as many chunks as its rows need.

Tables passed in should be narrow and stable: see :func:`tokenloom.session.materialize`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHUNKS = 4096
ROWS_PER_CHUNK = 1_000_000
SMALLEST_CHUNK = 256
BOUND_ROWS = 20_000_000
CHUNK = "_chunk"


def _literal(values: Sequence[float], kind: str) -> Column:
    """An array as one folded string literal: far cheaper to plan than thousands of literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def chunk_bounds(df: DataFrame, ord_col: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> list[int]:
    """Order values at which a new chunk starts, so that none has over twice ``rows_per_chunk`` rows.

    Reads the order column alone. Bounds decide how even the chunks are, never what they add up
    to, so a very long column is represented by a repeatable share of its values, like the sample
    behind a range partitioning; sketches of all values would pile up in the one final merge. A
    sample, and the ``MAX_CHUNKS`` of one such sketch, bound nothing on long columns: there chunks
    are counted, and those too large are cut again, each by a sketch of its own.
    """
    rows = df.count()
    if not rows:
        return []
    seen = df.select(ord_col)
    if rows > BOUND_ROWS:
        seen = seen.where(F.pmod(F.xxhash64(ord_col), F.lit(-(-rows // BOUND_ROWS))) == 0)
    grid = _literal([i / MAX_CHUNKS for i in range(1, MAX_CHUNKS)], "double")
    cuts = seen.agg(F.percentile_approx(ord_col, grid, 10 * MAX_CHUNKS)).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = min(cores, -(-rows // SMALLEST_CHUNK))
    wanted = max(1, spread, -(-rows // rows_per_chunk))
    chunks = min(MAX_CHUNKS, wanted)
    picked = [cuts[i * MAX_CHUNKS // chunks - 1] for i in range(1, chunks)] if cuts else []
    bounds = sorted(set(picked))
    if rows > BOUND_ROWS or wanted > MAX_CHUNKS:
        bounds = _cut_again(df.select(F.col(ord_col).alias("_at")), bounds, 2 * rows_per_chunk)
    return bounds


def _cut_again(order: DataFrame, bounds: list[int], most: int) -> list[int]:
    """``bounds`` and more of them, level by level, until no chunk of ``order`` (``_at``) has over
    ``most`` rows. A value that repeats more often than that stays whole, with its nearest neighbours."""
    while True:
        tagged = order.select("_at", chunk_of(F.col("_at"), bounds).alias(CHUNK))
        over = {r[CHUNK]: r["count"] for r in tagged.groupBy(CHUNK).count().where(F.col("count") > most).collect()}
        if not over:
            return bounds
        # Chunk numbers and counts, at most one for each ``most`` rows of the table.
        wide = order.sparkSession.createDataFrame(list(over), "int").withColumnRenamed("value", CHUNK)
        pieces = min(MAX_CHUNKS, -(-2 * max(over.values()) // most))
        grid = _literal([i / pieces for i in range(1, pieces)], "double")
        cuts = F.percentile_approx("_at", grid, 10 * pieces)
        found = tagged.join(F.broadcast(wide), CHUNK).groupBy(CHUNK).agg(cuts.alias("cuts")).collect()
        finer = sorted({*bounds, *(at for r in found for at in r["cuts"])})
        if len(finer) == len(bounds):
            return bounds
        bounds = finer


def chunk_of(ord_col: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds at or below the order value, by binary search over the literal array."""
    if not bounds:
        return F.lit(0)
    top = 1 << (len(bounds).bit_length() - 1)
    steps = [top >> i for i in range(top.bit_length())]
    table = _literal(bounds, "bigint")
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= ord_col, at + step).otherwise(at),
    )


def _before(cols: Sequence[str], by: Sequence[str]) -> list[Column]:
    """Totals of all earlier chunks of the same group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    w = w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}_before") for c in cols]


def running_totals(
    df: DataFrame,
    ord_col: str,
    values: Mapping[str, Column | str],
    by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``df`` plus one inclusive running total per entry of ``values``, restarted per ``by``.

    The chunk number stays in column ``_chunk``. Order values must be unique within a group.
    """
    return totals_in_chunks(df, ord_col, values, chunk_bounds(df, ord_col, rows_per_chunk), by)


def totals_in_chunks(
    df: DataFrame,
    ord_col: str,
    values: Mapping[str, Column | str],
    bounds: Sequence[int],
    by: Sequence[str] = (),
) -> DataFrame:
    """:func:`running_totals` over chunks that are already known."""
    names = list(values)
    tagged = df.withColumns({n: F.expr(v) if isinstance(v, str) else v for n, v in values.items()})
    tagged = tagged.withColumn(CHUNK, chunk_of(F.col(ord_col), bounds))
    offsets = _chunk_totals(tagged, names, by).select(*by, CHUNK, *_before(names, by))
    if not by:
        offsets = F.broadcast(offsets)  # one row per chunk: a millionth of the rows
    inside = (
        Window.partitionBy(*by, CHUNK)
        .orderBy(ord_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.withColumns({n: F.sum(n).over(inside) for n in names})
    joined = local.join(offsets, [*by, CHUNK])
    return joined.select(
        *df.columns,
        CHUNK,
        *[(F.col(n) + F.col(f"_{n}_before")).cast("bigint").alias(n) for n in names],
    )


def _chunk_totals(tagged: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    return tagged.groupBy(*by, CHUNK).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    )


def first_crossings(
    df: DataFrame,
    ord_col: str,
    targets: Mapping[str, tuple[Column | str, int]],
    by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per group, the first order value at which each running total reaches its target.

    Gives ``<name>_at`` (null when never reached) and ``<name>_total`` (the total there). Only the
    one chunk per target in which the crossing falls is ever sorted; no row is shuffled for the
    chunks before or after it. Values must not be negative and targets must be positive.
    """
    names = list(targets)
    bounds = chunk_bounds(df, ord_col, rows_per_chunk)
    tagged = df.select(
        *by,
        ord_col,
        chunk_of(F.col(ord_col), bounds).alias(CHUNK),
        *[(F.expr(v) if isinstance(v, str) else v).alias(n) for n, (v, _) in targets.items()],
    )
    totals = _chunk_totals(tagged, names, by)
    hits = totals.select(*by, CHUNK, *names, *_before(names, by))
    hit = {
        n: (F.col(f"_{n}_before") < t) & (F.col(f"_{n}_before") + F.col(n) >= t)
        for n, (_, t) in targets.items()
    }
    hits = hits.select(
        *by, CHUNK, *[F.when(hit[n], F.col(f"_{n}_before")).alias(f"_{n}_base") for n in names]
    ).where(" or ".join(f"_{n}_base is not null" for n in names))
    if not by:
        hits = F.broadcast(hits)  # at most one row per target
    inside = (
        Window.partitionBy(*by, CHUNK)
        .orderBy(ord_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = tagged.join(hits, [*by, CHUNK]).select(
        *by,
        ord_col,
        *[(F.sum(n).over(inside) + F.col(f"_{n}_base")).alias(n) for n in names],
    )
    found = []
    for n, (_, t) in targets.items():
        reached = F.col(n) >= t
        found += [
            F.min(F.when(reached, F.col(ord_col))).alias(f"{n}_at"),
            F.min(F.when(reached, F.col(n))).cast("bigint").alias(f"{n}_total"),
        ]
    return rows.groupBy(*by).agg(*found)
