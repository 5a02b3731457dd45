"""Readers for line, CSV, JSON, log and archive files."""

from __future__ import annotations

import bz2
import hashlib
import io
import re
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How archives are named, and the compiler's log lines.
ARCHIVE = r"^([^-]+)-(\d+[bf])-([^.]+)\.(\d+)?\.tar\.bz2$"
ARCHIVE_OF_K = r"^([^-]+)-(\d+[bf])-([^.]+)\.(\d+)\.(\d+)\.tar\.bz2$"
NOISE = r"javac.*warning:|javac.*It is recommended that the compiler be upgraded"
ERROR = r"javac\S*\s*(\S*?([^/\s]+(?:/[^/\s]+)*)\.java):(\d+):.*?error:.([^.]+)"


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each line, blank lines included, as column text."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def csv_table(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Quoted UTF-8 CSV with a header; fields may hold line breaks and doubled quotes.

    Because of the line breaks a file is read by one task: large tables belong in many files.
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_splits(spark: SparkSession, paths: dict[str, str], schema: str | None = None) -> DataFrame:
    """One table of named files, with the name as column split."""
    parts = [csv_table(spark, path, schema).withColumn("split", F.lit(name)) for name, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) from 0, in the order of files and their lines.

    Spark numbers the lines of a block upwards, with gaps between blocks; what counts is
    a line's number less its block's first one. Only a row for each block meets in one place.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(block.alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    blocks = lines.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, "block").select((F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "line")


def paired_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line_no, left, right) of two files of equally many lines; raises otherwise."""
    from quarryloom.operators.joins import same_place

    return same_place(numbered_text(spark, left).withColumnRenamed("line", "left"), numbered_text(spark, right).withColumnRenamed("line", "right"))


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """Method documents ``<version>/methods/<n>/corpus.json``, with version and number_method_by_version from the path."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "corpus.json").json(path)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/methods/(\d+)/corpus\.json$", k)
    return rows.select("*", part(1).alias("version"), part(2).cast("int").alias("number_method_by_version"))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct class names, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("class_name")).where("class_name <> ''").distinct()


def class_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(project, classes) from a JSON array; line ends after a class go."""
    rows = spark.read.option("multiLine", True).schema("project string, classes array<string>").json(path)
    return rows.withColumn("classes", F.transform("classes", lambda x: F.regexp_replace(x, r"\s+$", "")))


def archive_parts(name: Column, of_k: bool = False) -> list[Column]:
    """pid, vid, vid_num, tid (and sid) of an archive's name; a name of another form gives a null pid."""
    pattern = ARCHIVE_OF_K if of_k else ARCHIVE
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k))
    number = lambda k: F.when(part(k) != "", part(k)).cast("int")
    out = [part(1).alias("pid"), part(2).alias("vid"), F.regexp_replace(part(2), "[^0-9]", "").cast("int").alias("vid_num"), F.when(name.rlike(pattern), F.lit("generated_tests")).alias("src"), number(4).alias("tid")]
    return [*out, number(5).alias("sid")] if of_k else out


def archive_listing(spark: SparkSession, folder: str, of_k: bool = False) -> DataFrame:
    """Archives of a folder by name, ordered by version and test."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.bz2").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.select("name", *archive_parts(F.col("name"), of_k)).where("pid is not null").orderBy("vid_num", "tid", *(["sid"] if of_k else []))


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
            found = []
            with tarfile.open(fileobj=io.BytesIO(bz2.decompress(data.as_py()))) as tar:
                for member in tar:
                    if member.isfile():
                        found.append((name, member.name, tar.extractfile(member).read()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["name", "member", "content"])


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """(name, member, content) of every file in the tar.bz2 archives of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.bz2").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(members_of, "name string, member string, content binary")


def java_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, lines) of the Java files below a folder but scaffoldings."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    return rows.where(~F.endswith("path", F.lit("scaffolding.java")))


def of_test_class(df: DataFrame, path: str, test_class: Column) -> DataFrame:
    """The rows of df whose file's name, without .java, begins with its test class, taken literally."""
    name = F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.java$", "")
    return df.where(F.startswith(name, test_class))


def fingerprint(df: DataFrame, **parameters) -> str:
    """A digest of what df is made from: its normalised plan, its input files with sizes and times of change, and parameters.

    Two plans that differ in the numbers that Spark gives columns alone are the same.
    """
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?|\bplan_id=\d+|\[id=#?\d+\]", "", df._jdf.queryExecution().optimizedPlan().canonicalized().treeString())
    conf, known = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        known.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr((plan, known, sorted(parameters.items()))).encode()).hexdigest()


def cached_by_content(folder: str, df: DataFrame, **parameters) -> DataFrame:
    """The rows of df, from the table that an earlier call with the same plan, inputs and parameters wrote below folder; else written now.

    A changed input, plan or parameter has another fingerprint, so an old table is never
    taken for it. Two runs at once write the same table; the later one takes the place of the first.
    """
    return cached(f"{folder.rstrip('/')}/{fingerprint(df, **parameters)}", lambda: df, df.sparkSession)


def cached(path: str, make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table written at path; made and written first where it isn't there whole."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without_noise(lines: DataFrame, column: str = "text") -> DataFrame:
    """Compiler log lines but warnings and upgrade advice."""
    return lines.where(~F.col(column).rlike(NOISE))


def compile_error(line: Column) -> list[Column]:
    """file, class, line and message of a compiler error's line."""
    part = lambda k: F.when(line.rlike(ERROR), F.regexp_extract(line, ERROR, k))
    return [part(1).alias("file"), F.translate(part(2), "/", ".").alias("class"), part(3).cast("int").alias("line"), part(4).alias("message")]
