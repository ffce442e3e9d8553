"""Session helpers: where durable intermediate tables go, and how to write one."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session that names none
    gets a temporary folder of its own; on a cluster a machine-local folder would not survive the
    loss of an executor, so that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
    return sc.getCheckpointDir().rstrip("/")


_open = threading.local()  # the scratch() blocks of each thread
_left: list[tuple[SparkSession, str]] = []  # tables of lazy results, removed when the application ends


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _remove_left() -> None:
    """A lazy result may read its tables until the end, so they go when the driver exits."""
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            try:
                _remove(spark, [path])
            except Exception:  # the JVM is gone already; the folder is the cluster's to clean
                return


@contextmanager
def scratch(spark: SparkSession):
    """Remove the intermediate tables this thread writes inside, once the job's output is in place.

    Only for jobs that end in files: a DataFrame that outlives the block may still read its tables.
    """
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        _remove(spark, blocks.pop())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed like the tables of :func:`materialize`."""
    path = f"{durable_dir(spark)}/tokenloom/{name}-{uuid.uuid4().hex}"
    blocks = _open.__dict__.get("blocks")
    if blocks:
        blocks[-1].append(path)
    else:
        _left.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where several later passes need the same rows: the text is then scanned once, the lineage
    ends at committed files, and columns a later pass does not ask for are never read again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, wherever they run. Once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tokenloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tokenloom-"), "tokenloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)  # Spark copies it to every executor
    sc._tokenloom_shipped = True
