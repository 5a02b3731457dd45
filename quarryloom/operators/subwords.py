"""Subword ids of texts by a public vocabulary file, whose path is a parameter, and texts from ids.

The sentencepiece library does the work, a batch at a time; nothing is trained here.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quarryloom.operators import tasks
from quarryloom.operators.columns import as_row, column, from_row

#: Most ids of a text, and the id before them.
LIMIT, BOS = 1024, 1


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoded(df: DataFrame, text: str, path: str, name: str = "ids", limit: int | None = LIMIT, bos: int | None = BOS) -> DataFrame:
    """df with the ids of each text: bos, if given, and the first limit ids. A null text has null ids, an empty one bos alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _processor(path).encode
        for batch in batches:
            first = [] if bos is None else [bos]
            # one text's ids at a time, of which no more than limit stay
            found = [None if t is None else array("i", first + encode(t)[:limit]) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int32()))], ["row", "ids"])

    tasks.small_batches(df.sparkSession)
    rows = df.select(as_row(df, name), column(text).cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("ids array<int>")])
    return rows.mapInArrow(run, schema).select(*from_row(df.columns), column("ids").alias(name))


def decoded(df: DataFrame, ids: str, path: str, name: str = "text") -> DataFrame:
    """df with the text of each row's ids; control ids have none, bytes of one character are joined. Null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _processor(path).decode
        for batch in batches:
            found = [None if x is None else decode([int(i) for i in x]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "text"])

    tasks.small_batches(df.sparkSession)
    rows = df.select(as_row(df, name), column(ids).cast("array<int>").alias("ids"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("text string")])
    return rows.mapInArrow(run, schema).select(*from_row(df.columns), column("text").alias(name))
