"""Writers: text lines, JSON lines, CSV tables, project summaries and archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.functions.text import yes_no

# The columns of the methods, outcome and coverage files.
METHODS = (
    "id", "project", "version", "number_method_by_version", "modified_class", "focal_class", "path_focal_class_in_project", "test_class",
    "path_test_class_scaffolding", "package_focal_class", "imports_focal_class", "src_fm_fc_ms_ff", "src_fm_fc_dctx", "src_fm_fc_dctx_priv",
)
OUTCOMES = ("name", "project", "version", "test_id", "correct_syntax", "compilable", "executable", "passing_test", "correct_test")
COVERAGE = ("name", "project", "version", "test_id", "lines_total", "lines_covered", "line_rate", "branches_total", "branches_covered", "branch_rate")


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, by: str | None = None) -> None:
    """UTF-8 CSV with a header and doubled quotes, columns in the given order; by: a folder for each value of this column."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite").options(header=True, quote='"', escape='"', encoding="UTF-8")
    (out.partitionBy(by) if by else out).csv(path)


def write_outcomes(df: DataFrame, path: str) -> None:
    write_csv(df.withColumns({c: yes_no(F.col(c)) for c in OUTCOMES[4:]}), path, OUTCOMES)


def write_coverage(df: DataFrame, path: str) -> None:
    write_csv(df.withColumns({c: F.format_string("%.2f", c) for c in ("line_rate", "branch_rate")}), path, COVERAGE)


def write_methods(df: DataFrame, path: str) -> None:
    """The methods table with its columns in their order."""
    write_csv(df, path, METHODS)


def write_string(spark: SparkSession, content: str, path: str) -> None:
    """One text as one UTF-8 file, in place of an older one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def _files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content"), strict=True):
                target = f"{base.rstrip('/')}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                # a repeated task writes the same bytes again
                with system.open_output_stream(target) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return run


def write_files(df: DataFrame, folder: str) -> int:
    """A file below folder for each row (path, content): edited sources, archives. Returns their number."""
    rows = df.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(_files(folder), "path string").count()


def write_summary(df: DataFrame, path: str, append: bool = False) -> None:
    """One folder for each project; a project written again takes the place of its old rows, or with append follows them."""
    if append:
        df.write.mode("append").option("header", True).partitionBy("project").csv(path)
        return
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("project").csv(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loads = []
        for files in batch.column("files").to_pylist():
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w:bz2") as tar:
                for f in sorted(files, key=lambda x: x["member"]):
                    info = tarfile.TarInfo(f["member"])
                    info.size = len(f["content"])
                    tar.addfile(info, io.BytesIO(f["content"]))
            loads.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(loads, pa.binary())], ["name", "content"])


def archives(files: DataFrame) -> DataFrame:
    """(name, content): a tar.bz2 of the files (name, member, content) of each name."""
    grouped = files.groupBy("name").agg(F.collect_list(F.struct("member", "content")).alias("files"))
    return grouped.mapInArrow(_packed, "name string, content binary")
