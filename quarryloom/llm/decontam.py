"""Benchmark decontamination: an FM-index for each shard of training texts.

A shard is some megabytes of texts. Its words become symbols: a word of the phrases has
its number there, any other ends a run; runs shorter than the shortest phrase can hold no
occurrence and are left out, which changes no answer. Over the runs stand a suffix array,
its Burrows-Wheeler transform in a wavelet matrix and sampled suffix positions. Phrases
are searched backwards, all at once; occurrences are located by stepping to the next
sample, and the words they cover merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarryloom.llm import shared, words

WINDOW = 10
#: Text of one shard, in bytes.
SHARD_BYTES = 8 << 20
#: Words of the phrases that are broadcast at once; more phrases go over the texts in further passes.
PHRASE_WORDS = 250_000
#: One suffix position in so many is kept.
SAMPLE = 16


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        self.words = np.packbits(np.r_[bits, np.zeros(64 - n % 64, bool)], bitorder="little").view("<u8")
        self.sums = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.sums[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: symbols by their bits from the highest, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.depth = max(1, int(largest).bit_length())
        self.levels, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i."""
        a, b = np.zeros_like(i), i
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            ra, rb = bits.rank(a), bits.rank(b)
            a, b = np.where(one, zeros + ra, a - ra), np.where(one, zeros + rb, b - rb)
        return b - a

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, r = bits.get(i), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + r, i - r)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros end runs: each sorts before all others by its own place, so no comparison passes one."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + ends.sum() - 1)
    h = 1
    while True:
        key = rank * (n + int(symbols.max(initial=0)) + 2)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        h *= 2
        if rank[order[-1]] == n - 1 or h >= n:
            return order


class FMIndex:
    """Over symbols from 1, in runs that each end with a 0."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # of the first suffix the last symbol, a 0
        self.tree = Wavelet(before, largest)
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=largest + 1))]
        kept = (order % sample == 0) | (before == 0)  # the start of a run is kept, so no step crosses one
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase; row i of phrases holds sizes[i] symbols."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.less[-1], np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((sizes > j) & (lo < hi))
            if len(on):
                c = phrases[on, j].astype(np.int64)
                lo[on], hi[on] = self.less[c] + self.tree.rank(c, lo[on]), self.less[c] + self.tree.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes."""
        out, steps, rows = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.kept.get(rows[open_])
            done = open_[found]
            out[done] = self.places[self.kept.rank(rows[done])] + steps[done]
            open_ = open_[~found]
            at = rows[open_]
            c = self.tree.get(at)
            rows[open_] = self.less[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted hashes of words; number k has the symbol k + 1
    windows: np.ndarray  # symbols, 0 beyond the window's size
    sizes: np.ndarray
    item: np.ndarray  # of each window
    ids: list[str | None]


def phrases(ids: list[str | None], texts: list[str | None], width: int = WINDOW) -> Phrases:
    """Every width consecutive words of each item; an item of fewer words is one window, one without words is none."""
    w = words.split(pa.array(texts, pa.string()), "alnum", True)
    h = w.hashes()
    vocabulary = np.unique(h)
    symbols = np.append(np.searchsorted(vocabulary, h) + 1, 0).astype(np.int32)
    n = np.diff(w.at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(n)), count)
    sizes = np.minimum(n[item], width)
    first = w.at[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    steps = np.arange(width)
    windows = np.where(steps < sizes[:, None], symbols[np.minimum(first[:, None] + steps, len(h))], 0)
    return Phrases(vocabulary, windows.astype(np.int32), sizes, item, list(ids))


def blocks(bench: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> Iterator[Phrases]:
    """The items in blocks of about limit words, one at a time on the driver; at least one block."""
    rows = bench.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids, texts, size, made = [], [], 0, False
    for row in rows.where("text is not null").toLocalIterator():
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"]) // 4 + 1
        if size >= limit:
            yield phrases(ids, texts, width)
            ids, texts, size, made = [], [], 0, True
    if ids or not made:
        yield phrases(ids, texts, width)


def symbols_of(p: Phrases, w: words.Words) -> np.ndarray:
    """The symbol of each word, 0 for one that no phrase has."""
    if not len(p.vocabulary):
        return np.zeros(len(w.starts), np.int32)
    h = w.hashes()
    near = np.searchsorted(p.vocabulary, h)
    near[near == len(p.vocabulary)] = 0
    return np.where(p.vocabulary[near] == h, near + 1, 0).astype(np.int32)


def occurrences(p: Phrases, symbols: np.ndarray, at: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in a shard, whose text i has the symbols [at[i], at[i+1]): the first word's index, and the window's number."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs of known words within one text that are long enough for the shortest window
    known = symbols > 0
    if not len(p.sizes) or not known.any():
        return none
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    first = at[:-1][at[:-1] < len(known)]
    begins[first] = known[first]
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=int(begins.sum()))
    keep = np.flatnonzero(known)
    keep = keep[sizes[run[keep]] >= p.sizes.min()]
    if not len(keep):
        return none
    ends = np.r_[np.flatnonzero(run[keep][1:] != run[keep][:-1]) + 1, len(keep)]
    sequence = np.insert(symbols[keep], ends, 0)
    places = np.insert(keep, ends, -1)
    index = FMIndex(sequence, len(p.vocabulary), sample)
    lo, hi = index.search(p.windows, p.sizes)
    count = hi - lo
    window = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(window))
    return places[index.locate(rows)], window


SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<first:int,last:int,begin:long,end:long>>"


@dataclass
class Part:
    """Some texts of a shard with the symbols of their words; the arrays of their bytes are gone again."""

    batch: pa.RecordBatch
    symbols: np.ndarray
    at: np.ndarray

    def found(self, hit: np.ndarray, items: list[set], last: bool, cut: bool) -> pa.RecordBatch:
        """The output rows: hit tells of each word whether it is covered, items names each text's new items."""
        batch, at = self.batch, self.at
        texts, spans, names, clean = batch.column("text"), [], [], []
        n_hit = np.diff(np.r_[0, np.cumsum(hit)][at])
        for i, (old, known) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
            mine = hit[at[i] : at[i + 1]]
            if old:
                mine = mine.copy()
                for s in old:
                    mine[s["first"] : s["last"] + 1] = True
            spans.append(_spans(texts.slice(i, 1), mine) if old or n_hit[i] else [])
            names.append(sorted(items[i] | set(known or ())))
            if cut and spans[-1]:
                text, parts, done = texts[i].as_py().encode(), [], 0
                for s in spans[-1]:
                    parts.append(text[done : s["begin"]])
                    done = s["end"]
                clean.append(b"".join([*parts, text[done:]]).decode())
            elif cut:
                clean.append(texts[i].as_py())
        columns = [batch.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(spans, pa.list_(SPAN)), pa.array(names, pa.list_(pa.string()))]
        kept = ["row", "n_words", "spans", "items"]
        if not last:
            return pa.RecordBatch.from_arrays([*columns, texts], [*kept, "text"])
        return pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string())], [*kept, "clean"]) if cut else pa.RecordBatch.from_arrays(columns, kept)


def _spans(text: pa.Array, hit: np.ndarray) -> list[dict]:
    """The merged runs of hit words of one text, with their places in its bytes."""
    w = words.split(text, "alnum", True)
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [{"first": f, "last": t - 1, "begin": int(w.starts[f]), "end": int(w.ends[t - 1])} for f, t in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _search(handle, last: bool, cut: bool):
    def shards(batches: Iterator[pa.RecordBatch], p: Phrases) -> Iterator[list[Part]]:
        held, size = [], 0
        for piece in shared.text_pieces(batches):
            n = int(shared.byte_lengths(piece.column("text")).sum())
            if held and size + n > SHARD_BYTES:
                yield held
                held, size = [], 0
            w = words.split(piece.column("text"), "alnum", True)
            held.append(Part(piece, symbols_of(p, w), w.at))
            size += n
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = handle.value
        for held in shards(batches, p):
            texts = np.cumsum([0, *(len(x.at) - 1 for x in held)])
            base = np.cumsum([0, *(len(x.symbols) for x in held)])
            at = np.concatenate([[0], *(x.at[1:] + b for x, b in zip(held, base, strict=False))])
            places, window = occurrences(p, np.concatenate([x.symbols for x in held]), at)
            hit = words.covered(int(base[-1]), places, p.sizes[window])
            items: list[set] = [set() for _ in range(int(texts[-1]))]
            pairs = np.unique((np.searchsorted(at, places, side="right") - 1) * len(p.ids) + p.item[window])
            for doc, item in zip((pairs // max(1, len(p.ids))).tolist(), (pairs % max(1, len(p.ids))).tolist(), strict=True):
                if p.ids[item] is not None:
                    items[doc].add(p.ids[item])
            for k, part in enumerate(held):
                yield part.found(hit[base[k] : base[k + 1]], items[texts[k] : texts[k + 1]], last, cut)

    return run


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, cut: bool = False, keep: list[str] | None = None, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """For each row of docs: row, n_words, spans, items and with cut clean.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
    width consecutive words of an item, or the whole of a shorter item. spans: the merged
    runs of words inside any occurrence, with byte places in the UTF-8 text. items: the
    ids, as sorted strings, of items with an occurring window; an item with a null id is
    searched but not named. clean: the text without the bytes of its spans. A null text
    has no words and stays null; no items or items without words hit nothing. Repeated
    rows and null ids are rows like any other.

    The items are broadcast in blocks of about phrase_words words. Of several blocks one
    is held at a time: what its pass found is written before the next begins.
    """
    spark = docs.sparkSession
    rows = shared.as_rows(docs, id_col, text_col, keep or docs.columns).select("row", "text", F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = rows.select("row").schema.add("n_words", "long").add(rows.schema["spans"]).add(rows.schema["items"])
    parts = blocks(bench, item_col, item_text, width, phrase_words)
    part = next(parts)
    while part:
        after = next(parts, None)
        handle = spark.sparkContext.broadcast(part)
        last, part = after is None, after
        more = [] if last and not cut else [StructField("clean" if last else "text", StringType())]
        rows = shared.map_arrow(rows, _search(handle, last, cut and last), StructType([*schema, *more]))
        if not last:
            rows = shared.written(rows, "hits")
            handle.destroy()
    return rows


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with every hit span cut out of the texts; other texts stay as they are."""
    return shared.changed_texts(contamination(docs, bench, id_col, text_col, width=width, cut=True), docs, text_col, "clean")
