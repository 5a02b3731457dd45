"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A first pass counts windows by their anchors: how many shards there are, and which anchors
are dealt to several of them, follows from these counts. A second pass hashes every window. Within a block of some thousand documents only the
smallest document of a window is left open; the other documents of the block are decided
there and then, so a window of a third of all documents reaches the shuffle once a block.
Open windows go as packed arrays to a shard, where the smallest document of each is found.
The shard is that of the window's anchor, the least hash of three words in it: equal windows
meet, and neighbouring windows mostly share it, so a repeated passage comes back in a few
rows. Where one anchor has far more windows than others, its windows are dealt by their own hash.
Decided windows return to their documents, which a last pass cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import shared, words

WINDOW = 13
#: Windows of a map task that are held, made unique and sent on at once.
BLOCK_WINDOWS = 1_000_000
#: Most windows of a shard, as counted by the first pass; fewer while there are fewer shards than SHARDS_PER_PARTITION asks for.
SHARD_WINDOWS, SHARDS_PER_PARTITION = 500_000, 16
#: Anchors are counted in 2**BIN_BITS bins, and these in chunks.
BIN_BITS, CHUNKS = 20, 256
#: A bin with so many times the windows of the mean one holds a frequent anchor.
FREQUENT = 4
#: Words of the runs whose least hash in a window names the window's shard.
ANCHOR = 3


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(*columns: np.ndarray) -> bytes:
    c = zstandard.ZstdCompressor(level=1)
    parts = [c.compress(planes(x)) for x in columns]
    return np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out, d = np.frombuffer(data, "<u4", len(kinds)), 4 * len(kinds), [], zstandard.ZstdDecompressor()
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(numbers(d.decompress(data[at : at + size]), kind))
        at += int(size)
    return out


def anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window, from hashes of words and the windows' first words."""
    size = min(ANCHOR, width)
    n = len(hashes) - size + 1
    runs = hashes[:n].copy()
    for j in range(1, size):
        runs *= words.SHINGLE_BASE
        runs += hashes[j : j + n]
    return words.mixed(words.sliding_min(words.mixed(runs), width - size + 1)[first])


@dataclass
class Dealing:
    """The shards of each bin of anchors: the first, how many, and whether the windows' own hashes choose among them."""

    first: np.ndarray
    parts: np.ndarray
    frequent: np.ndarray
    shards: int

    @staticmethod
    def of(counts: np.ndarray, most: int) -> Dealing:
        """Bins share shards of about most windows; a bin of more has several of its own."""
        parts = np.maximum(1, -(-counts // most))
        held = np.where(parts > 1, 0, counts)
        shared_ = (np.cumsum(held) - held) // most
        many = int(shared_[-1]) + 1
        first = np.where(parts > 1, many + np.cumsum(np.where(parts > 1, parts, 0)) - parts, shared_)
        frequent = counts > FREQUENT * counts.mean()
        return Dealing(first.astype(np.int32), parts.astype(np.int32), frequent, many + int(parts[parts > 1].sum()))

    def shard(self, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        at = bins(anchor)
        chosen = np.where(self.frequent[at], windows, words.mixed(anchor)) >> np.uint64(32)
        return self.first[at] + (chosen * self.parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int32)


def bins(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BIN_BITS, np.uint32)
        for piece in shared.text_pieces(batches):
            w = words.split(piece.column("text"))
            hashes = w.hashes()
            first = words.window_starts(w.at, width)
            if len(first):
                np.add.at(total, bins(anchors(hashes, first, width)), np.uint32(1))
        press = zstandard.ZstdCompressor(level=1).compress
        loads = [press(planes(x)) for x in total.reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(loads, pa.binary())], ["chunk", "load"])

    return run


def _sum_chunks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << BIN_BITS) // CHUNKS, np.int64)
    for batch in batches:
        for load in batch.column("load"):
            total += numbers(zstandard.decompress(load.as_py()), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "load"])


def dealing(rows: DataFrame, width: int) -> Dealing:
    """From the counts of all windows: 2**BIN_BITS numbers reach the driver, however many windows there are."""
    spark = rows.sparkSession
    counted = shared.map_arrow(rows.select("text"), _count(width), "chunk int, load binary")
    chunks = counted.groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, load binary").collect()
    counts = np.zeros((CHUNKS, (1 << BIN_BITS) // CHUNKS), np.int64)
    for row in chunks:
        counts[row["chunk"]] = np.frombuffer(row["load"], np.int64)
    wanted = int(counts.sum()) // (SHARDS_PER_PARTITION * shared.partitions(spark)) + 1
    return Dealing.of(counts.ravel(), min(SHARD_WINDOWS, wanted))


def later(h: np.ndarray, d: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """h, d (and more) sorted by (hash, document), and which of them have the hash of a smaller document."""
    order = np.lexsort((d, h))
    h, d, *more = (x[order] for x in (h, d, *more))
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    return h, d, *more, d > least


def hit_rows(h: np.ndarray, d: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One row for each document: its id and the hashes of its decided windows."""
    if not len(d):
        return [], []
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    return d[cut].tolist(), [x.tobytes() for x in np.split(h, cut[1:])]


def _blocks(width: int, handle):
    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, d, shard, known = later(*(np.concatenate(x) for x in zip(*held, strict=True)))
        docs, found = hit_rows(h[known], d[known])
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        keep = ~known & ~same
        order = np.argsort(shard[keep], kind="stable")
        h, d, shard = (x[keep][order] for x in (h, d, shard))
        cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)] if len(shard) else np.zeros(1, int)
        keys, loads = shard[cuts[:-1]].tolist(), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            used, local = np.unique(d[a:b], return_inverse=True)
            loads.append(packed(h[a:b], local.astype(np.uint32), used.astype(np.int64)))
        # decided windows pass through the same shuffle, dealt by document
        keys += [int(x % handle.value.shards) for x in docs]
        loads += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([None] * (len(keys) - len(docs)) + docs, pa.int64()), pa.array(loads, pa.binary())], ["shard", "doc", "load"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in shared.text_pieces(batches):
            ids = piece.column("id").to_numpy(zero_copy_only=False)
            w = words.split(piece.column("text"))
            hashes = w.hashes()
            first, h = words.windows(hashes, w.at, width)
            if not len(h):
                continue
            held.append((h, ids[np.searchsorted(w.at, first, side="right") - 1], handle.value.shard(h, anchors(hashes, first, width))))
            size += len(h)
            if size >= BLOCK_WINDOWS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _decide(table: pa.Table) -> pa.Table:
    hs, ds, docs, loads = [], [], [], []
    for doc, load in zip(table.column("doc").to_pylist(), table.column("load"), strict=True):
        if doc is None:
            h, local, ids = unpacked(load.as_py(), np.uint64, np.uint32, np.int64)
            hs.append(h)
            ds.append(ids[local])
        else:
            docs.append(doc)
            loads.append(load.as_py())
    if hs:
        h, d, known = later(np.concatenate(hs), np.concatenate(ds))
        more, found = hit_rows(h[known], d[known])
        docs, loads = docs + more, loads + found
    return pa.table({"doc": pa.array(docs, pa.int64()), "load": pa.array(loads, pa.binary())})


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc, loads): for each document with windows that also start in a document of a smaller id, their hashes.

    Rows with a null id or text take no part. Rows of one id count as one document.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    handle = docs.sparkSession.sparkContext.broadcast(dealing(rows, width))
    blocks = shared.map_arrow(rows, _blocks(width, handle), "shard int, doc long, load binary")
    hits = blocks.groupBy("shard").applyInArrow(_decide, "doc long, load binary")
    return hits.groupBy("doc").agg(F.collect_list("load").alias("loads"))


def _cut(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in shared.text_pieces(batches):
            texts = piece.column("text")
            w = words.split(texts)
            first, h = words.windows(w.hashes(), w.at, width)
            at = np.searchsorted(first, w.at)
            gone = np.zeros(len(w.starts), bool)
            for i, loads in enumerate(piece.column("loads").to_pylist()):
                if loads and at[i + 1] > at[i]:
                    known = np.frombuffer(b"".join(loads), np.uint64)
                    mine = slice(at[i], at[i + 1])
                    gone[w.at[i] : w.at[i + 1]] = words.covered(int(w.at[i + 1] - w.at[i]), first[mine][np.isin(h[mine], known)] - w.at[i], width)
            removed = np.diff(np.r_[0, np.cumsum(gone)][w.at])
            data, (_, base) = w.raw.tobytes(), words.buffers(texts)
            out = []
            for i in range(piece.num_rows):
                a, b = w.at[i], w.at[i + 1]
                if digest:
                    keep = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join([data[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])
                    out.append(hashlib.sha256(kept).hexdigest())
                elif not removed[i]:
                    out.append(texts[i].as_py())
                else:
                    edges = np.flatnonzero(np.diff(np.r_[0, gone[a:b].astype(np.int8), 0])) + a
                    parts, done = [], int(base[i])
                    for first_gone, after in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        parts.append(data[done : w.starts[first_gone]])
                        done = int(w.ends[after - 1])
                    out.append(b"".join([*parts, data[done : base[i + 1]]]).decode())
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(np.diff(w.at), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return run


def with_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, digest: bool = False) -> DataFrame:
    """The rows of docs (but the text; with digest only the id) as struct row, with n_words, n_removed and kept.

    A window is width consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. Each word is
    removed that a window covers whose words also start in a document of a smaller id,
    judged on the input. kept: the text without its removed runs of words, all else
    unchanged to the byte; with digest, the lowercase hex SHA-256 of the kept words joined
    by one space. A null text has no words; a row with a null id loses none; a text of fewer than width
    words has no window. Windows are compared by 64-bit hashes.
    """
    hits = repeated_windows(docs, id_col, text_col, width)
    rows = shared.as_rows(docs, id_col, text_col, [id_col] if digest else docs.columns)
    joined = rows.join(hits, rows["id"] == hits["doc"], "left").select("row", "text", "loads")
    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return shared.map_arrow(joined, _cut(width, digest), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut from the texts; other texts stay as they are, to the byte."""
    return shared.changed_texts(with_removals(docs, id_col, text_col, width), docs, text_col, "kept")
