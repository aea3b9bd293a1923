"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow tables (ids and counts) up to which one side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[int, str]] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """The session with Arrow batches of few rows: texts are long, and a batch is held by the JVM and by Python at once. Results don't depend on it."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, str(rows))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quernel-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
    # the table takes the place of the shuffles that led to it, so their files can go
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    if not _written:
        atexit.register(_delete_all, spark)
    _written.append((threading.get_ident(), path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The tables that ``materialize`` has written for this thread and that are still there."""
    return {path for thread, path in _written if thread == threading.get_ident()}


def free(spark: SparkSession, before: set[str]) -> None:
    """Deletes the tables that this thread has written but for those ``before`` and the last one: for a caller that has used them up."""
    for path in [p for t, p in _written if t == threading.get_ident() and p not in before][:-1]:
        _written.remove((threading.get_ident(), path))
        _delete(spark, path)


def _delete_all(spark: SparkSession) -> None:
    while _written:
        _delete(spark, _written.pop()[1])


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, AttributeError, ConnectionError):  # the session has ended; the cluster clears its own checkpoint folder
        pass


def small(table: DataFrame) -> DataFrame:
    """``table``, which is materialized, marked for broadcasting if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names clash whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
