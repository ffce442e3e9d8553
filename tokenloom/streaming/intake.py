"""Incremental intake with Structured Streaming.

The column functions are those of the batch jobs; only what must remember earlier rows differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions import text
from tokenloom.operators.budget import Totals
from tokenloom.operators.vocab import Vocabulary
from tokenloom.plans.documents import DocumentPack, pack_documents
from tokenloom.sources import files
from tokenloom.sources.runlog import SCHEMA as LOG_SCHEMA


def stream_documents(
    spark: SparkSession, folder: str, schema: str, field: str = "text", fmt: str = "parquet"
) -> DataFrame:
    """New files of a folder as documents with ``split``: filtered, neutralized, stateless."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    t = F.col(field)
    others = [c for c in rows.columns if c != field]
    return rows.where(text.is_long_enough(t)).select(
        *others, text.split_of(t).alias("split"), text.neutralize(t).alias("text")
    )


def write_parts(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    each: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """One part per micro-batch, in a folder named after its batch id.

    A batch that is replayed after a failure overwrites its own part only, so parts are exactly
    once; reading ``out`` gives the union with a ``part`` column.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if each is None:
            rows.write.mode("overwrite").parquet(f"{out}/part={batch}")
            return
        rows = rows.persist()  # ``each`` may use them more than once; the source is read once
        try:
            each(rows, batch).write.mode("overwrite").parquet(f"{out}/part={batch}")
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pack_stream(
    stream: DataFrame,
    vocabulary: Vocabulary,
    tokenizer_sha256: str,
    out: str,
    checkpoint: str,
    options: DocumentPack = DocumentPack(),
) -> StreamingQuery:
    """One packed part and its manifest per micro-batch of documents, for a merge.

    Budgets are those of the whole stream: a batch goes on from the totals that the manifest of the
    batch before it records, and once the stream's budget is met, later parts are empty. Documents
    within a batch are taken in their order, batches as they come. The manifest is a batch's last
    file: a batch that is replayed after it was written does nothing, and one that was interrupted
    before writes its shards again, from the same totals.
    """

    def manifest(batch: int) -> str:
        return f"{out}/manifest.b{batch:06d}.json"

    def write(rows: DataFrame, batch: int) -> None:
        if files.exists(manifest(batch)):
            return
        before = Totals()
        if batch:
            before = Totals(**files.read_json(manifest(batch - 1))["source"]["totals"])
        rows = rows.persist()
        try:
            named = replace(options, tag=f"b{batch:06d}")
            pack_documents(rows, vocabulary, tokenizer_sha256, out, named, {"batch": batch}, before)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_disk_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which need not fit in memory."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)  # a query takes its settings when it starts
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def first_prompts(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    ord_col: str = "conv_id",
    by: Sequence[str] = (),
) -> StreamingQuery:
    """``by``, ``ord_col`` and key digest of the rows whose prompt key was not seen before, in this
    batch or in any earlier one.

    ``stream`` has ``prompt``. State per key is the time of the batch that met it first, which all
    rows of a batch share and a replay repeats, and the lowest order value in that batch. The
    minimum combines before the shuffle, so a hot key costs a row per task, and a batch looks up its
    own keys only, however many came before. Keys are never forgotten, as in a batch run.
    """
    by = list(by)
    key = F.sha2(text.collapse(F.coalesce("prompt", F.lit(""))), 256)
    met = F.struct(F.current_timestamp().alias("at"), F.col(ord_col).alias("ord"))
    keyed = stream.select(*by, key.alias("key"), met.alias("met"))
    firsts = keyed.groupBy(*by, "key").agg(F.min("met").alias("met"))
    fresh = firsts.where(F.col("met.at") == F.current_timestamp())
    with on_disk_state(stream.sparkSession):
        rows = fresh.select(*by, "key", F.col("met.ord").alias(ord_col))
        return write_parts(rows, out, checkpoint, mode="update")


def distinct_prompts(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """State-store variant: keeps one arbitrary row per key of a batch, never forgets a key."""
    prompt = F.coalesce("prompt", F.lit(""))
    keyed = stream.withColumn("key", F.sha2(text.collapse(prompt), 256))
    return keyed.dropDuplicates([*by, "key"])


def follow_run_log(
    spark: SparkSession, folder: str, checkpoint: str, use: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand new records of a run log folder to ``use`` as they arrive."""
    return (
        spark.readStream.schema(LOG_SCHEMA)
        .json(folder)
        .writeStream.foreachBatch(use)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
