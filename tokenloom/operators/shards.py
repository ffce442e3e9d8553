"""Shard rolling with reset: a shard closes after the row that brings it to the limit.

The count restarts at zero, so the overshoot of each shard moves every later boundary:
``floor(total / limit)`` is not the same thing, and the chain of boundaries is sequential by
nature. It is resolved like a parallel prefix instead of a walk over all rows:

1. A shard that was open when a chunk began must close among the first ``limit`` tokens of the
   chunk. For each of those few possible closing rows, the chunk finds where its own chain of
   boundaries ends and how many shards that closes.
2. These small tables compose: a group of neighbouring chunks has such a table as well.
3. Going back down, each chunk learns the true start of the shard open at its first row.
4. Each chunk numbers its own rows.

No task sees more than one chunk of rows or ``FAN_OUT`` small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.running import (
    CHUNK,
    ROWS_PER_CHUNK,
    chunk_bounds,
    totals_in_chunks,
)
from tokenloom.session import materialize, ship_package

FAN_OUT = 64
GROUP_ROWS = 1_000_000  # rows of the small tables that meet in one group, in expectation
MAX_BOUNDS = 4_000_000  # shards whose first rows are sent to every task, 64 MB
SHARD_TOKENS = 64_000_000
CHAT_SHARD_TOKENS = 8_000_000


def _resolve(first_total, chain_total, closed, limit):
    """Follow each candidate's chain of boundaries to its last one inside the table.

    ``first_total`` ascending: running total at each candidate closing row; ``chain_total``: total
    at the last boundary known from there; ``closed``: shards closed on the way. Doubling takes
    log2(rows) vector steps.
    """
    n = len(first_total)
    jump = np.searchsorted(first_total, chain_total + limit, side="left")
    end, count = chain_total.copy(), closed.copy()
    while True:
        inside = jump < n
        if not inside.any():
            return end, count
        target = jump[inside]
        end2, count2, jump2 = end.copy(), count.copy(), jump.copy()
        end2[inside] = end[target]
        count2[inside] = count[inside] + count[target]
        jump2[inside] = jump[target]
        end, count, jump = end2, count2, jump2


def _candidates(limit: int, by: Sequence[str]):
    """Grouped step: table of possible closing rows of one chunk, or of one group of chunks."""

    def table(key, pdf):
        pdf = pdf.sort_values("first_total", kind="stable")
        end, closed = _resolve(
            pdf["first_total"].to_numpy(),
            pdf["chain_total"].to_numpy(),
            pdf["closed"].to_numpy(),
            limit,
        )
        out = pdf.assign(chain_total=end, closed=closed)
        near = out["before"] < out["before"].iloc[0] + limit
        out = out[near]
        for name, value in zip([*by, "node"], key):
            out[name] = value
        return out[[*by, "node", "before", "first_total", "chain_total", "closed"]]

    return table


def _descend(limit: int, by: Sequence[str]):
    """Grouped step: from the true state at the start of a group, the state at each child."""

    def walk(key, tables, state):
        start, shard = int(state["start"].iloc[0]), int(state["shard"].iloc[0])
        rows = []
        tables = tables.sort_values(["node", "first_total"], kind="stable")
        for node, child in tables.groupby("node", sort=True):
            rows.append((*key[:-1], node, start, shard))
            firsts = child["first_total"].to_numpy()
            at = int(np.searchsorted(firsts, start + limit, side="left"))
            if at < len(firsts):
                start = int(child["chain_total"].iloc[at])
                shard += int(child["closed"].iloc[at])
        return pd.DataFrame(rows, columns=[*by, "node", "start", "shard"])

    return walk


def _number(limit: int, columns: Sequence[str]):
    """Grouped step: shard number and offset of every row of one chunk."""

    def number(key, rows, state):
        rows = rows.sort_values("total", kind="stable")
        total = rows["total"].to_numpy()
        start, shard = int(state["start"].iloc[0]), int(state["shard"].iloc[0])
        starts = np.empty(len(total), dtype="int64")
        shards = np.empty(len(total), dtype="int64")
        at = 0
        while at < len(total):
            close = int(np.searchsorted(total, start + limit, side="left"))
            starts[at : close + 1] = start
            shards[at : close + 1] = shard
            if close < len(total):
                start, shard = int(total[close]), shard + 1
            at = close + 1
        out = rows.assign(shard=shards)
        out["offset"] = total - rows["n_tokens"].to_numpy() - starts
        return out[list(columns)]

    return number


def roll_shards(
    lengths: DataFrame,
    ord_col: str,
    limit: int = SHARD_TOKENS,
    by: Sequence[str] = ("split",),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Place every row: ``by``, ``ord_col``, ``n_tokens``, ``shard`` and ``offset`` in the shard.

    ``lengths`` holds the kept rows, with ``n_tokens`` >= 1. Rows stay whole, so a shard can pass
    the limit by part of one row, and a row longer than the limit is a shard of its own.
    """
    ship_package(lengths.sparkSession)
    by = list(by)
    narrow = lengths.select(*by, ord_col, F.col("n_tokens").cast("bigint").alias("n_tokens"))
    bounds = chunk_bounds(narrow, ord_col, rows_per_chunk)
    totals = materialize(
        totals_in_chunks(narrow, ord_col, {"total": "n_tokens"}, bounds, by), "shard-totals"
    )
    # A table has the rows of one shard at most; fewer tables meet where shards hold many rows.
    mean = totals.agg(F.avg("n_tokens")).first()[0] or limit
    fan_out = max(2, min(fan_out, int(GROUP_ROWS * mean / limit)))
    types = dict(totals.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)
    table_schema = (
        f"{keys}, node int, before bigint, first_total bigint, chain_total bigint, closed bigint"
    )
    state_schema = f"{keys}, node int, start bigint, shard bigint"

    levels = [
        totals.select(
            *by,
            F.col(CHUNK).alias("node"),
            (F.col("total") - F.col("n_tokens")).alias("before"),
            F.col("total").alias("first_total"),
            F.col("total").alias("chain_total"),
            F.lit(1).cast("bigint").alias("closed"),
        )
        .groupBy(*by, "node")
        .applyInPandas(_candidates(limit, by), table_schema)
    ]
    nodes = len(bounds)
    while nodes >= fan_out:
        levels[-1] = materialize(levels[-1], "shard-tables")  # read going up and coming down
        above = (
            levels[-1]
            .withColumn("node", (F.col("node") / F.lit(fan_out)).cast("int"))
            .groupBy(*by, "node")
            .applyInPandas(_candidates(limit, by), table_schema)
        )
        levels.append(above)
        nodes //= fan_out

    zero = F.lit(0).cast("bigint")
    states = totals.select(*by).distinct().select(
        *by, F.lit(0).alias("node"), zero.alias("start"), zero.alias("shard")
    )
    for level in reversed(levels):
        parents = level.withColumn("_parent", (F.col("node") / F.lit(fan_out)).cast("int"))
        states = (
            parents.groupBy(*by, "_parent")
            .cogroup(states.withColumnRenamed("node", "_parent").groupBy(*by, "_parent"))
            .applyInPandas(_descend(limit, by), state_schema)
        )

    out_columns = [*by, ord_col, "n_tokens", "shard", "offset"]
    schema = f"{keys}, {ord_col} {types[ord_col]}, n_tokens bigint, shard bigint, offset bigint"
    return (
        totals.groupBy(*by, CHUNK)
        .cogroup(states.withColumnRenamed("node", CHUNK).groupBy(*by, CHUNK))
        .applyInPandas(_number(limit, out_columns), schema)
    )


def assign_shards(
    rows: DataFrame, placed: DataFrame, ord_col: str, by: Sequence[str] = ("split",)
) -> DataFrame:
    """``rows`` with their ``shard``, and the order value as ``offset``, without moving them.

    A shard is a run of the order, so its first row is enough to know it by: one small entry per
    shard goes to every task, and a row finds its shard by binary search. Wide rows then move once,
    to their shard. Beyond ``MAX_BOUNDS`` shards the rows are joined with ``placed`` instead.
    """
    by = list(by)
    firsts = materialize(placed.groupBy(*by, "shard").agg(F.min(ord_col).alias("_first")), "shard-firsts")
    if firsts.count() > MAX_BOUNDS:
        where = placed.select(*by, ord_col, "shard", F.col(ord_col).alias("offset"))
        return rows.join(where, [*by, ord_col])
    key = F.concat_ws("\0", *by)
    found: dict[str, list] = {}
    for r in firsts.select(key.alias("key"), "_first", "shard").orderBy("key", "_first").toLocalIterator():
        found.setdefault(r["key"], []).append((r["_first"], r["shard"]))
    table = {k: tuple(np.array(x, "int64") for x in zip(*v)) for k, v in found.items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("bigint")
    def shard_of(keys: pa.Array, order: pa.Array) -> pa.Array:
        names = keys.dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        values = order.to_numpy(zero_copy_only=False)
        out = np.full(len(values), -1, "int64")
        for i, name in enumerate(names.dictionary.to_pylist()):
            if name in shared.value:
                first, shard = shared.value[name]
                mine = code == i
                at = np.searchsorted(first, values[mine], "right") - 1
                out[mine] = np.where(at >= 0, shard[at], -1)
        return pa.array(out)

    return rows.withColumn("shard", shard_of(key, F.col(ord_col))).withColumn("offset", F.col(ord_col))


def roll_equal_rows(
    ranked: DataFrame, rank_col: str, row_tokens: int, limit: int = CHAT_SHARD_TOKENS
) -> DataFrame:
    """Shard rolling when every row has the same size: a plain division, no chain.

    ``rank_col`` counts the rows of a split from 0.
    """
    rows = max(1, -(-limit // row_tokens))
    return ranked.withColumn("shard", F.floor(F.col(rank_col) / F.lit(rows)).cast("bigint")).withColumn(
        "offset", (F.pmod(F.col(rank_col), F.lit(rows)) * row_tokens).cast("bigint")
    )


def shard_table(placed: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """One row per shard: how many rows and tokens it holds."""
    return placed.groupBy(*by, "shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").cast("bigint").alias("tokens")
    )


def shard_file(split: Column, shard: Column, prefix: str | Column = "") -> Column:
    """``<prefix><split>-<5 digits>.bin``"""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string("%s%s-%05d.bin", prefix, split, shard)
