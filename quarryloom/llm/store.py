"""Files that executors write to the shared folder, known by a written list of finished ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

from quarryloom.llm import shared


def put(folder: str, name: str, data: bytes) -> str:
    """Writes a file of a name of its own and returns that name. A repeated task leaves a file that no list names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def made(spark: SparkSession, folder: str) -> None:
    """Makes the folder, which then can be read even if no task writes a file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def finished(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """The listed files with their bytes as content; listed has a column name.

    Names alone are dealt to tasks, each of which opens its files one after another: the
    folder is never listed, and no file's bytes are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                with system.open_input_file(f"{path}/{one.column('name')[0].as_py()}") as file:
                    content = pa.array([file.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([*one.columns, content], [*one.schema.names, "content"])

    dealt = listed.repartition(shared.partitions(spark), "name")
    return shared.map_arrow(dealt, run, StructType([*listed.schema.fields, StructField("content", BinaryType())]))
