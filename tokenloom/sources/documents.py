"""Document and conversation intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import materialize

SMALL_BYTES = 64 << 20
MOST_PLACES = 1_000_000  # files or splits, two numbers each, that are sent to every executor
ROW_BITS = 40  # of a place: up to a trillion rows in each of eight million files
MESSAGES = "array<struct<role:string,content:string>>"


def read_documents(
    spark: SparkSession, path, field: str = "text", ord_col: str = "doc_id", also: tuple = ()
) -> DataFrame:
    """Parquet documents as ``ord_col``, ``text`` and the columns in ``also``; nothing else is read."""
    paths = [path] if isinstance(path, str) else list(path)
    table = spark.read.parquet(*paths)
    require_text(table, field)
    return spread(table.select(ord_col, F.col(field).alias("text"), *also), ord_col)


def read_ordered(
    spark: SparkSession, path, field: str = "content", ord_col: str = "doc_id", fmt: str = "parquet", kind: str = "string"
) -> DataFrame:
    """Rows of files that have no order column, with their place as ``ord_col``: files by name, rows
    as they stand. ``fmt`` is ``parquet`` or ``json`` (lines); ``kind`` is the type of ``field``.

    A place is the file's number and, below it, a row's number in the file. Parquet knows a row's
    number. Lines are numbered within each split, and splits by counts of the ones before; that
    numbering is written once, because it must not change from one reading to the next. Rows know
    their file or split by a hash and find one number under it, so text is not moved for its place.
    """
    paths = [path] if isinstance(path, str) else list(path)
    file = F.col("_metadata.file_path").alias("_file")
    if fmt == "parquet":
        table = spark.read.parquet(*paths)
        if kind == "string":
            require_text(table, field)
        rows = table.select(field, known_by("_metadata.file_path").alias("_key"), F.col("_metadata.row_index").alias("_nth"))
        starts = table.select(file, known_by("_metadata.file_path").alias("_key")).distinct().withColumn("_shift", F.lit(0))
    else:
        read = spark.read.schema(f"`{field}` {kind}").option("mode", "FAILFAST").json(paths)
        block = F.col("_metadata.file_block_start").alias("_block")
        rows = read.select(field, file, block, F.monotonically_increasing_id().alias("_nth"))
        rows = materialize(rows, "lines").withColumn("_key", known_by("_file", "_block"))
        splits = rows.groupBy("_file", "_block", "_key").agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))
        order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(order), F.lit(0))
        starts = splits.select("_file", "_key", (before - F.col("_first")).alias("_shift"))
    number = F.dense_rank().over(Window.orderBy("_file")).cast("bigint") - 1
    base = starts.select("_key", (F.shiftleft(number, ROW_BITS) + F.col("_shift")).alias("_base"))
    placed = by_key(rows, materialize(base, "places"))
    return placed.select(
        (F.col("_base") + F.col("_nth")).alias(ord_col), F.col(field).alias("text" if kind == "string" else field)
    )


def known_by(*place: str) -> Column:
    """A file, or a split of one, as a long that rows carry instead of a path."""
    return F.xxhash64(*place)


def by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with what ``table``, a written table of one small row per file or split, says under
    their ``_key``. Beyond ``MOST_PLACES`` of those the rows are shuffled, with the same result."""
    entries, keys = table.agg(F.count("*"), F.count_distinct("_key")).first()
    if entries != keys:
        raise ValueError("Two files or splits share a hash")
    return rows.join(F.broadcast(table) if entries <= MOST_PLACES else table, "_key").drop("_key")


def spread(table: DataFrame, ord_col: str) -> DataFrame:
    """Use all cores for a small file in fewer splits than there are cores.

    Row groups cannot be split, so a small file would leave most cores idle. Nothing above
    ``SMALL_BYTES`` is ever moved for it, on however many cores.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    stored = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored > SMALL_BYTES or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, ord_col)


def read_jsonl(
    spark: SparkSession, path, field: str = "content", ord_col: str = "doc_id", messages: bool = False
) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line is an error."""
    kind = T.ArrayType(
        T.StructType().add("role", T.StringType()).add("content", T.StringType())
    ) if messages else T.StringType()
    schema = T.StructType().add(ord_col, T.LongType()).add(field, kind)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def require_text(table: DataFrame, field: str) -> None:
    types = dict(table.dtypes)
    if types.get(field) != "string":
        raise ValueError(f"{field!r} is no text column of {sorted(types)}")


def require_no_null_text(docs: DataFrame, text_col: str = "text") -> None:
    """Sampling path: a document without text is an error there, while packing just counts it.

    The null test reaches the Parquet scan, where row groups without nulls are skipped unread.
    """
    if docs.where(F.col(text_col).isNull()).take(1):
        raise ValueError(f"{text_col!r} is null in a document to learn from")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path``, ``dir``, ``file``, ``bytes`` of files below ``root``; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("bytes"))
    )
    return found.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"),
        "bytes",
    )


def resolve_directory(
    files: DataFrame, split: str = "en", subset: str | None = None, source_dir: str | None = None
) -> str:
    """The one directory that holds a split: named, or ending in ``_<split>``."""
    dirs = files.select("dir").distinct()
    if source_dir:
        fits = (F.col("dir") == source_dir) | F.col("dir").endswith("/" + source_dir)
    else:
        name = F.regexp_extract("dir", "([^/]*)$", 1)
        fits = name.endswith("_" + split)
        if subset:
            fits = fits & F.contains("dir", F.lit(subset))
    found = [r["dir"] for r in dirs.where(fits).orderBy("dir").limit(20).collect()]
    if len(found) != 1:
        raise ValueError(f"Not one directory for {split!r} but {len(found)}: {found}")
    return found[0]


def slice_of(index: Column, total: Column, slices: int) -> Column:
    """Which of ``slices`` near-equal runs of a sorted list an index falls into."""
    return (F.floor(((index + 1) * slices - 1) / total)).cast("int")


def file_slices(files: DataFrame, slices: int, name: str = "path") -> DataFrame:
    """A file listing with ``index`` in sorted order and ``slice``. Listings are metadata-sized."""
    indexed = files.withColumn(
        "index", F.row_number().over(Window.partitionBy().orderBy(name)) - F.lit(1)
    ).withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy()))
    return indexed.withColumn("slice", slice_of(F.col("index"), F.col("_total"), slices)).drop("_total")


def select_files(
    files: DataFrame, index: int = 0, slices: int = 1, start: int = 0, end: int = 0
) -> list[str]:
    """Sorted file names of one slice, or of ``[start, end)`` with 0 for "to the end"."""
    numbered = file_slices(files, max(1, slices))
    if slices > 1:
        numbered = numbered.where(F.col("slice") == index)
    else:
        numbered = numbered.where(F.col("index") >= start)
        if end:
            numbered = numbered.where(F.col("index") < end)
    names = [r["path"] for r in numbered.orderBy("path").select("path").collect()]
    if not names:
        raise ValueError(f"No file in slice {index} of {slices}, or in [{start}, {end})")
    return names


def seeded_order(ord_col: str, seed: int = 42) -> Column:
    """A full shuffle key: SHA-256 of seed and order value, stable over engines and retries."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ord_col).cast("string")), 256)


def shuffled(rows: DataFrame, ord_col: str, seed: int = 42) -> DataFrame:
    """``rows`` with the order column replaced by their place in seeded order, as a long.

    The place is the start of :func:`seeded_order`, so every rule that follows an order column, a
    budget or a pack, then reads in seeded order.
    """
    digits = F.substring(seeded_order(ord_col, seed), 1, 15)
    return rows.withColumn(ord_col, F.conv(digits, 16, 10).cast("long"))
