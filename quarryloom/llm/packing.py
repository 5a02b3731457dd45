"""Best-fit packing: bounded-space online best-fit over the pieces of documents.

A packer holds a fixed number of open sequences in a bitset keyed by free space. Each
piece goes to the open sequence with the least free space that is enough; where none is,
a new one opens; when too many are open, the fullest closes first. Lengths alone are
dealt to packers, and each sees its own longest first; token ids never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarryloom.llm import shared, tokens

CAPACITY = 1024
#: Open sequences of one packer, about a quarter of its pieces: more would not pack tighter.
OPEN_BINS = 1 << 14
#: Pieces of one packer.
PACKER_PIECES = 60_000


class Packer:
    """Places one length after another."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = 0  # bit f is set if some open sequence has f places left
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit in {self.capacity}")
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            self.at[left].append(sequence)
            self.free |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        return sequence, self.capacity - space

    def _take(self, space: int) -> int:
        sequence = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return sequence


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of documents of these sizes: the document's index, the piece's number, start and length. All but a first piece are full."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (sizes - (n - 1) * capacity)[row]
    return row, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for part in shared.text_pieces(batches):
            ids, at = tokens.with_end(*encode(part.column("text")), end)
            row, piece, start, length = cuts(np.diff(at), capacity)
            data, first = memoryview(ids).cast("B"), 4 * (at[row] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            columns = [part.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for the ids of each text and the id end.

    Ids of more than capacity are cut so that all pieces but the first are full. A null or
    empty text has the id end alone. Equal rows give equal pieces, a null id stays null.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return shared.map_arrow(rows, _pieces(path or tokens.vocabulary(), end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            found = [packer.place(x) for x in batch.column("length").to_pylist()]
            sequence, offset = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["row", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most capacity, gapless from 0.

    A length of null, of less than 1 or of more than capacity raises. Pieces are dealt
    evenly, whatever their documents, to as many packers as packer_pieces asks for. Pieces
    with a column sequence_id or offset raise.
    """
    if taken := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"pieces have columns of the new names {', '.join(sorted(taken))}")
    pieces = shared.written(pieces, "pieces")
    packers = max(1, -(-pieces.count() // packer_pieces))
    dealt = pieces.repartition(packers).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    rows = dealt.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), "length")
    schema = StructType([rows.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    done = shared.map_arrow(rows, _pack(capacity, open_bins), schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in pieces.columns], "sequence_id", "offset")


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces, packed."""
    return pack(token_pieces(docs, id_col, text_col, path, end, capacity), capacity)
