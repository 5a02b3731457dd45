"""Token-ID output by bit-plane shuffling.

A file holds the ids of consecutive documents in chunks of a fixed number of ids. Each
chunk is transposed into bit (or byte) planes, each plane compressed with zstandard; a
plane of zeros takes no bytes. The chunk index at the end has the planes' sizes, so one
chunk can be read alone.

File: magic, planes of each chunk, index, 8 bytes with the index's size, magic.
Index (zstandard): JSON line with counts, then int64 columns: sizes of planes, document
ids, whether an id is null, and ids of each document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm import shared, store, tokens

MAGIC = b"QLPLANE1"
CHUNK_IDS = 1 << 16
#: Ids of one file, unless the texts that are encoded at once have more.
FILE_IDS = 8 << 20
LEVEL = 1


_STEPS = [(np.uint64(7), np.uint64(0x00AA00AA00AA00AA)), (np.uint64(14), np.uint64(0x0000CCCC0000CCCC)), (np.uint64(28), np.uint64(0x00000000F0F0F0F0))]


def turned(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number as eight rows of eight bits, with rows and columns exchanged; twice gives x again."""
    for shift, mask in _STEPS:
        t = (x ^ (x >> shift)) & mask
        x = x ^ t ^ (t << shift)
    return x


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids, lowest first, up to the highest that isn't all zeros.

    Bit planes hold eight ids a byte, the first in the lowest bit.
    """
    width = int(ids.max(initial=0)).bit_length()
    size = -(-width // 8)
    pad = -len(ids) % 8 if mode == "bit" else 0
    whole = np.r_[ids, np.zeros(pad, ids.dtype)].astype("<u4") if pad else ids.astype("<u4")
    low = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 4)[:, :size].T)
    if mode == "byte":
        return [row.tobytes() for row in low]
    out = []
    for k, row in enumerate(low):
        planes = np.ascontiguousarray(turned(row.view("<u8")).view(np.uint8).reshape(-1, 8).T)
        out += [plane.tobytes() for plane in planes[: max(0, width - 8 * k)]]
    return out


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    padded = n if mode == "byte" else -(-n // 8) * 8
    out = np.zeros((padded, 4), np.uint8)
    if mode == "byte":
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k in range(0, len(planes), 8):
            rows = np.zeros((8, padded // 8), np.uint8)
            for j, plane in enumerate(planes[k : k + 8]):
                rows[j] = np.frombuffer(plane, np.uint8)
            out[:, k // 8] = turned(np.ascontiguousarray(rows.T).reshape(-1).view("<u8")).view(np.uint8)
    return out.reshape(-1).view("<u4")[:n]


class Writer:
    """A file in the making. Chunks are compressed as soon as they are full."""

    def __init__(self, mode: str = "bit", chunk: int = CHUNK_IDS):
        self.mode, self.size = mode, chunk
        self.press = zstandard.ZstdCompressor(level=LEVEL).compress
        self.body, self.sizes, self.rest, self.ids = [MAGIC], [], np.zeros(0, np.uint32), 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: list[int]) -> None:
        """Documents one after another: their ids, and how many each has."""
        self.doc_ids += doc_ids
        self.lengths += lengths
        self.ids += len(ids)
        self.rest = np.append(self.rest, ids)
        whole = len(self.rest) // self.size * self.size
        for a in range(0, whole, self.size):
            self._chunk(self.rest[a : a + self.size])
        self.rest = self.rest[whole:].copy()

    def _chunk(self, ids: np.ndarray) -> None:
        found = [self.press(x) if x.count(0) < len(x) else b"" for x in to_planes(ids, self.mode)]
        self.sizes += [len(found), *map(len, found)]
        self.body += found

    def data(self) -> bytes:
        if len(self.rest):
            self._chunk(self.rest)
        head = json.dumps({"mode": self.mode, "chunk": self.size, "ids": self.ids, "sizes": len(self.sizes), "documents": len(self.doc_ids)}).encode()
        columns = [self.sizes, [x or 0 for x in self.doc_ids], [int(x is None) for x in self.doc_ids], self.lengths]
        index = self.press(head + b"\n" + b"".join(np.array(x, "<i8").tobytes() for x in columns))
        return b"".join([*self.body, index, len(index).to_bytes(8, "little"), MAGIC])


class Reader:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a file of token id planes")
        self.data, self.open = data, zstandard.ZstdDecompressor()
        size = int.from_bytes(data[-16:-8], "little")
        head, _, rest = self.open.decompress(data[-16 - size : -16]).partition(b"\n")
        self.head = json.loads(head)
        n, d = self.head["sizes"], self.head["documents"]
        numbers = np.frombuffer(rest, "<i8")
        self.doc_ids = [None if no else int(x) for x, no in zip(numbers[n : n + d], numbers[n + d : n + 2 * d], strict=True)]
        self.lengths = numbers[n + 2 * d :]
        self.chunks, at, k = [], len(MAGIC), 0  # of each chunk its planes' places
        while k < n:
            sizes = numbers[k + 1 : k + 1 + numbers[k]].tolist()
            self.chunks.append([(at + sum(sizes[:j]), s) for j, s in enumerate(sizes)])
            at += sum(sizes)
            k += 1 + len(sizes)

    def chunk(self, k: int) -> np.ndarray:
        size = self.head["chunk"]
        n = min(size, self.head["ids"] - k * size)
        empty = bytes(n if self.head["mode"] == "byte" else -(-n // 8))
        planes = [self.open.decompress(self.data[a : a + s]) if s else empty for a, s in self.chunks[k]]
        return from_planes(planes, n, self.head["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids), chunk by chunk."""
        held, at, k = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    parts.append(self.chunk(k))
                    have += len(parts[-1])
                    k += 1
                held, at = np.concatenate(parts), 0
            yield doc_id, held[at : at + n]
            at += n


def _write(folder: str, path: str, end: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = tokens.encoder(path).encode
        made, names, n_ids, n_docs = Writer(mode), [], [], []

        def close() -> None:
            names.append(store.put(folder, f"ids-{part:06d}-{len(names):06d}", made.data()))
            n_ids.append(made.ids)
            n_docs.append(len(made.doc_ids))

        for piece in shared.text_pieces(batches):
            ids, at = tokens.with_end(*encode(piece.column("text")), end)
            if made.ids and made.ids + len(ids) > FILE_IDS:
                close()
                made = Writer(mode)
            made.add(piece.column("id").to_pylist(), ids, np.diff(at).tolist())
        if made.doc_ids:
            close()
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(n_ids, pa.int64()), pa.array(n_docs, pa.int64())], ["name", "part", "file", "n_ids", "n_docs"])

    return run


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 0, mode: str = "bit") -> DataFrame:
    """Writes the ids of all texts, each with the id end, in ascending order of the document's id.

    Returns the list of files: name, part, file, n_ids, n_docs and start, the ids in
    all files before. A null text is empty; null ids come first; rows of one id follow
    one another in the order of their texts. No rows give no file.
    """
    store.made(docs.sparkSession, folder)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = ("id", F.xxhash64("text"))  # also of rows that share an id, so that they can be dealt to several tasks
    dealt = rows.repartitionByRange(shared.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    listed = shared.written(shared.map_arrow(dealt, _write(folder, path or tokens.vocabulary(), end, mode), "name string, part int, file int, n_ids long, n_docs long"), "files")
    # a row for each file: small, and summed in one place
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                rows: list[list] = [[], [], [], []]

                def made() -> pa.RecordBatch:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())]
                    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])  # noqa: B023

                for doc_id, ids in Reader(content.as_py()).documents():
                    for column, x in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids), strict=True):
                        column.append(x)
                    start += len(ids)
                    if len(rows[0]) >= shared.BATCH_ROWS:
                        yield made()
                        rows = [[], [], [], []]
                yield made()

    return run


def read_ids(spark: SparkSession, folder: str, files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the listed files; with digest ids_crc32 in place of ids."""
    found = store.finished(spark, folder, files.select("name", "start")).select("content", "start")
    return shared.map_arrow(found, _read(digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")
