"""tar.bz2 archives as a data source: members come as they are unpacked, and files appear when the job commits.

Reading opens one archive after another and never holds more than a member. Writing streams the
rows of a name into one archive below a folder of its own; a committed job moves its archives
into place, a failed one deletes them. Files are reached through pyarrow's file systems; for
a store that only Spark reads there is ``files.archive_members``, which takes whole archives.
"""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "tar_bz2"
SUFFIX = ".tar.bz2"
#: Archives of a partition hold about this many bytes, or are one larger archive.
PARTITION_BYTES = 32 << 20
_PENDING = "_pending"


def _system(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


@dataclass
class Archives(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        system, path = _system(self.folder)
        found = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX))
        parts, size = [], PARTITION_BYTES
        for name, n in found:
            if size + n > PARTITION_BYTES:
                parts.append(Archives([]))
                size = 0
            parts[-1].names.append(name)
            size += n
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, path = _system(self.folder)
        for name in partition.names:
            with system.open_input_stream(f"{path}/{name}", compression=None) as stream, tarfile.open(fileobj=stream, mode="r|bz2") as tar:
                for member in tar:
                    if member.isfile():
                        yield name, member.name, tar.extractfile(member).read()


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """Rows come by name: each archive is written as they come."""
        system, path = _system(self.folder)
        own = f"{_PENDING}/{self.job}/{uuid.uuid4().hex}"
        names, stream, tar = [], None, None

        def close() -> None:
            if tar:
                tar.close()
                stream.close()

        for row in rows:
            if not names or row["name"] != names[-1]:
                close()
                if row["name"] in names:
                    raise ValueError(f"rows of {row['name']} do not follow one another")
                names.append(row["name"])
                target = f"{path}/{own}/{row['name']}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(target, compression=None)
                tar = tarfile.open(fileobj=stream, mode="w|bz2")
            info = tarfile.TarInfo(row["member"])
            info.size = len(row["content"] or b"")
            tar.addfile(info, BytesIO(row["content"] or b""))
        close()
        return Written(names, own)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _system(self.folder)
        done = [(name, m.folder) for m in messages if m for name in m.names]
        if len({name for name, _ in done}) < len(done):
            self.abort(messages)
            raise ValueError("an archive was written by two tasks: deal the rows by name")
        for name, own in done:
            system.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
            system.move(f"{path}/{own}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what this job has written and not moved."""
        from pyarrow import fs

        system, path = _system(self.folder)
        for gone in (f"{path}/{_PENDING}/{self.job}", f"{path}/{_PENDING}"):
            info = system.get_file_info(gone)
            if info.type == fs.FileType.Directory and (gone.endswith(self.job) or not system.get_file_info(fs.FileSelector(gone))):
                system.delete_dir(gone)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, member string, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(name, member, content) of every file in the tar.bz2 archives of a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).load(folder)


def write_archives(files: DataFrame, folder: str) -> None:
    """An archive for each name of the rows (name, member, content), members in order. A null content is empty; a null name or member raises."""
    spark = files.sparkSession
    spark.dataSource.register(ArchiveSource)
    rows = files.selectExpr("name", "member", "cast(content as binary) as content")
    checked = rows.selectExpr("coalesce(name, cast(raise_error('an archive needs a name') as string)) as name", "coalesce(member, cast(raise_error('a member needs a name') as string)) as member", "content")
    checked.repartition("name").sortWithinPartitions("name", "member").write.format(FORMAT).mode("append").save(folder)
