"""What the operators share: the scratch folder, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken from Arrow batches in pieces of about this many bytes, so that the
#: numpy arrays of eight bytes a character stay near 4 MB each.
PIECE_BYTES = 512 << 10
#: Rows of an Arrow batch between Spark and Python; with long texts the default 10,000
#: would fill a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: A table in few files has this many for each core, or one for so many shuffle partitions if that is more.
TASKS_PER_CORE, PARTITIONS_PER_TASK = 4, 8
_made: list[str] = []


def arrow_limits(spark: SparkSession) -> None:
    """Sets the rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES, if they are larger.

    The session keeps these settings: Spark reads them when a plan runs, which is after the
    operator has returned it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share.

    It is deleted when the driver ends. Without the setting a local session gets a
    temporary folder; a cluster raises, as its machines share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            base = found
        elif spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="quarryloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _made.append(path)
    return path


def written(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """The rows of df from a table written in the shared folder: cuts lineage and survives lost executors.

    few: by few_tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    (few_tasks(df) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame) -> DataFrame:
    """df with fewer partitions, for tables that would else be written as very many small files.

    Their number grows with that of the shuffle partitions, so a task's share doesn't grow
    with the input. Partitions are taken one after another: a task needs no more memory.
    """
    spark = df.sparkSession
    return df.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, partitions(spark) // PARTITIONS_PER_TASK))


def made() -> list[str]:
    """The folders that scratch has named so far."""
    return list(_made)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that no table in use needs any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _made:
            _made.remove(folder)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def text_pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about limit bytes of text; a longer text comes alone."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_lengths(array: pa.Array):
    """Bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype("int64")


def as_rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(row, id, text): the kept columns but the text as a struct, so that no name clashes with a working column."""
    held = [F.col(f"`{c}`") for c in keep if c != text_col] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*held).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def changed_texts(done: DataFrame, docs: DataFrame, text_col: str, new: str, n_chars: str = "n_chars") -> DataFrame:
    """The columns of docs from (row, new), with the text replaced and its length, if docs has it, counted again."""
    cols = [F.col(new).alias(c) if c == text_col else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*cols)


def map_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow under the batch limits of this module; a task gives its free memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        give_back()

    arrow_limits(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, so that workers kept for later tasks stay small."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
