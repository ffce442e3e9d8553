"""Training run logs: append-only JSON lines, with train and validation records mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "step bigint, tokens bigint, supervised_tokens bigint, loss double, lr double, "
    "grad_norm double, tokens_per_second double, train_epoch double, "
    "val_loss double, val_blocks bigint, data_fingerprint string"
)
# Fixed value: the share of a rented hour that is spent training.
USABLE_SHARE = 0.85


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def append_run_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def train_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("loss").isNotNull())


def validation_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("val_loss").isNotNull())


def rates_between(records: DataFrame, time_col: str) -> DataFrame:
    """Tokens per second since the previous record, for logs that carry a time in seconds.

    One run logs a record every some updates, so a run's log is small; runs are kept apart.
    """
    w = Window.partitionBy("run").orderBy("step")
    spent = F.col(time_col) - F.lag(time_col).over(w)
    gained = F.col("tokens") - F.lag("tokens").over(w)
    return records.withColumn("rate", gained / F.greatest(F.lit(1e-6), spent))


def best_run(results: DataFrame) -> DataFrame:
    """Fastest candidate that did not fail."""
    row = F.struct(*results.columns)
    return (
        results.where(~F.col("failed"))
        .agg(F.max_by(row, "tokens_per_second").alias("best"))
        .select("best.*")
    )


def tokens_per_dollar(rate: Column, price_per_hour: Column) -> Column:
    return rate * 3600 / price_per_hour


def affordable_tokens(rate: Column, price_per_hour: Column, dollars: Column) -> Column:
    """Tokens a sum of money pays for, leaving the unusable share of the time out."""
    return F.floor(rate * (dollars / price_per_hour * 3600) * USABLE_SHARE).cast("bigint")
