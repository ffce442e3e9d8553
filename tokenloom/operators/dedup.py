"""First row per key, without gathering the rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(
    rows: DataFrame, keys: Sequence[str], ord_col: str, by: Sequence[str] = ()
) -> DataFrame:
    """``by`` and order value of the first row of each key, one scope per ``by`` group.

    A minimum combines before the shuffle, so a key that holds a third of all rows costs one row
    per map task. A ``row_number`` window would sort all of its rows in a single task.
    """
    firsts = rows.groupBy(*by, *keys).agg(F.min(ord_col).alias(ord_col))
    return firsts.select(*by, ord_col)


def mark_first(
    rows: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    by: Sequence[str] = (),
    flag: str = "is_first",
) -> DataFrame:
    """``rows`` plus a boolean ``flag``. The join runs on the unique order value, never on the key."""
    winners = first_per_key(rows, keys, ord_col, by).withColumn(flag, F.lit(True))
    return rows.join(winners, [*by, ord_col], "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )
