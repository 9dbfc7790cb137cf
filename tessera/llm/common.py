"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    session runs on one machine, a folder of that machine stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


_open: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _open[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables and archives made inside are deleted at the end.

    Operators return frames that still read such tables, so whoever consumes a result opens this
    around both and closes it when the result is written; without it the tables stay until the
    shared folder is cleared.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_scratch(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts lineage, so a lost executor costs a re-read rather than a recomputation,
    and keeps range partitioning's sampling pass from running the input twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written, without the intermediate tables that it took."""
    path = scratch_path(spark, tag)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows up to this number are sent to all executors, if they take no more than so many bytes.
MOST_BROADCAST, MOST_BYTES = 1_000_000, 64 << 20


def row_key(text: str | Column = "text") -> Column:
    """Tells apart rows that share a doc_id, or have none, by a hash of their text."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, row_key) names; a null doc_id is one like any other.

    ``gone`` is written first and counted: a few rows are broadcast and the texts stay where
    they are; more are hashed after a shuffle, so that texts needn't be sorted.
    """
    gone = materialize(gone.select(F.col("doc_id").alias("__gone_id"), F.col("row_key").alias("__gone_key")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone.hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone_id"]) & (row_key(docs["text"]) == gone["__gone_key"]), "left_anti")


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as it takes for no column to be called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ddl_of(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of corpora are whole texts, of which Spark's 10,000 a batch take tens of megabytes in each
    JVM and Python worker. A session that hasn't chosen a number gets this one."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (one row at least).

    Whole-buffer NumPy work takes a multiple of the text's size, so this bounds the
    memory of a Python worker whatever the size of an Arrow batch.
    """
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a task, at whose end Arrow gives back what it holds but doesn't use: Python workers live on and take tasks of other kinds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array in one buffer and the offsets of its rows (null: empty)."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if values is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]], at - at[0]
