"""LM scoring: prediction by partial matching over bytes, pretrained on the training documents.

Training counts every run of ORDER + 1 bytes; shorter contexts follow by dropping leading
bytes, so the counts are a whole context trie. A symbol's probability comes from the
longest context that has it; each context on the way down pays the escape estimate of
method D (half a count of each distinct symbol goes to the escape), and symbols of longer
contexts are excluded from shorter ones.

The trie is broadcast whole if it has no more than TRIE_RUNS runs. Beyond, the most
frequent runs are broadcast with their probabilities; the other runs that texts have are
joined with the counts, order by order, down to the longest order that fits in memory.
No count is left out either way.

A unigram score of words stands beside it. Counts of frequent words, a bounded number,
are broadcast; the other words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from quarryloom.llm import shared, words

ORDER = 5
#: Most runs that are broadcast; beyond, half for the most frequent runs and half for a trie of lower order, the others are joined.
TRIE_RUNS = 4_000_000
#: Most words whose counts are broadcast.
HEAD_WORDS = 1_000_000
#: Symbols of UTF-8 text: 254 bytes, as FE and FF do not occur, and the end of a text.
SYMBOLS = 255
START, END = 0xFE, 0xFF
#: Distinct keys that a map task holds before it sends them on.
HELD_KEYS = 1_000_000
#: Text scored at once, in bytes.
SCORED_BYTES = 1 << 20


def runs(w: words.Words, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol with the order bytes before it, for all texts and their ends; and each text's first place."""
    n = len(offsets) - 1
    stream = np.insert(w.data, np.repeat(offsets[1:], order + 1), np.tile(np.r_[np.uint8(END), np.full(order, START, np.uint8)], n))
    stream = np.r_[np.full(order, START, np.uint8), stream]
    size = len(stream) - order
    code = np.zeros(size, np.uint64)
    for j in range(order + 1):
        code <<= np.uint64(8)
        code |= stream[j : j + size]
    real = np.flatnonzero(stream[order:] != START)
    return code[real], np.r_[0, np.cumsum(np.diff(offsets) + 1)]


class Counts:
    """Counts of keys, merged when many are held."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size >= HELD_KEYS:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(self.counts), len(keys)).astype(np.int64)
            self.keys, self.counts, self.size = [keys], [counts], len(keys)


def _learn(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (Counts(), Counts())
        docs = 0

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            held = kinds[kind]
            held.merge()
            if held.size:
                keys, counts = held.keys[0].view(np.int64), held.counts[0]
                for a in range(0, len(keys), 100_000):
                    k, c = keys[a : a + 100_000], counts[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c.astype(np.int64))], ["kind", "key", "n"])
            kinds[kind].__init__()

        for piece in shared.text_pieces(batches):
            w = words.split(piece.column("text"), "space", True)
            docs += piece.num_rows
            kinds[0].add(runs(w, words.buffers(piece.column("text"))[1], order)[0])
            kinds[1].add(w.hashes())
            for kind in (0, 1):
                if kinds[kind].size >= HELD_KEYS:
                    yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])

    return run


#: Counts are told apart by their first so many bits, which bounds the steps that the driver sees.
STEP_BITS = 10


def at_least(counts: DataFrame, most: int) -> int:
    """A number n so that at most `most` keys have a count of n or more: the least among steps of a thousandth.

    Keys of the largest step that don't fit all stay below it: then n is more than every count.
    """
    bits = F.greatest(F.length(F.bin("n")) - F.lit(STEP_BITS), F.lit(0))
    steps = counts.withColumn("bits", bits).groupBy("bits", F.expr("shiftright(n, bits)").alias("step")).agg(F.count("*").alias("keys"))
    found = sorted(((r["step"] << r["bits"], r["bits"], r["keys"]) for r in steps.collect()), reverse=True)
    total, least = 0, found[0][0] + (1 << found[0][1]) if found else 1
    for low, _, keys in found:
        total += keys
        if total > most:
            return least
        least = low
    return 1


@dataclass
class Level:
    """Contexts of one length: sorted runs and counts; of each context total, distinct symbols and the total of these symbols one level down."""

    run: np.ndarray
    n: np.ndarray
    context: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[i] == x, i, -1)


class Slots:
    """A hash table from 64-bit keys to their index."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = keys
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _first(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._first(x)
        found = self.slot[at]
        same = (found >= 0) & (self.keys[found] == x)
        out[same] = found[same]
        left = np.flatnonzero((found >= 0) & ~same)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.slot[at[left]]
            same = (found >= 0) & (self.keys[found] == x[left])
            out[left[same]] = found[same]
            left = left[(found >= 0) & ~same]
        return out


class Trie:
    def __init__(self, run: np.ndarray, n: np.ndarray, order: int = ORDER, whole: bool = True):
        """run, n: codes of order + 1 bytes and their counts. Not whole: the lower orders of a longer trie, of which only ``escaped`` is asked."""
        self.order, self.levels = order, [None] * (order + 1)
        sort = np.argsort(run)
        run, n = run[sort], n[sort]
        for k in range(order, -1, -1):
            if k < order:
                run, inverse = np.unique(run & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(inverse, n, len(run)).astype(np.int64)
            context, inverse = np.unique(run >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, n, len(context)).astype(np.int64)
            self.levels[k] = Level(run, n, context, total, np.bincount(inverse, minlength=len(context)), np.zeros(len(context), np.int64))
        for k in range(1, order + 1):
            level, lower = self.levels[k], self.levels[k - 1]
            shorter = lower.n[find(lower.run, level.run & np.uint64((1 << 8 * k) - 1))] if len(level.run) else level.n
            level.below = np.bincount(find(level.context, level.run >> np.uint64(8)), shorter, len(level.context)).astype(np.int64) if len(level.run) else level.below
        if not whole:
            return
        top = self.levels[order]
        at = find(top.context, top.run >> np.uint64(8))
        self.known = (np.log10((top.n - 0.5) / top.total[at]) if len(top.run) else np.zeros(0)).astype(np.float32)
        self.slots = Slots(top.run)
        top.run = top.n = top.run[:0]  # the slots have them

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each run after the others."""
        at = self.slots.find(code)
        out = np.zeros(len(code))
        hit = at >= 0
        out[hit] = self.known[at[hit]]
        left = np.flatnonzero(~hit)
        if len(left):
            part, inverse = np.unique(code[left], return_inverse=True)
            none = np.zeros(len(part), np.int64)
            out[left] = self.escaped(part, np.zeros(len(part)), none, none.copy())[inverse]
        return out

    def escaped(self, code: np.ndarray, out: np.ndarray, gone: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """out with the price from this order down; gone, kinds: total and number of excluded symbols in the context at hand."""
        left = np.arange(len(code))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            part = code[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = find(level.context, part >> np.uint64(8))
            here = at >= 0
            spot, rows = at[here], left[here]
            total, distinct = level.total[spot] - gone[rows], level.distinct[spot] - kinds[rows]
            run = find(level.run, part[here])
            n = np.where(run >= 0, level.n[run] if len(level.n) else 0, 0)
            paid = np.where(n > 0, n - 0.5, 0.5 * distinct)
            some = paid > 0  # a context all of whose symbols are excluded is passed without a price
            out[rows[some]] += np.log10(paid[some] / total[some])
            gone[rows], kinds[rows] = level.below[spot], level.distinct[spot]
            left = left[~np.isin(left, rows[n > 0])]
            if not len(left):
                return out
        root = self.levels[0]
        out[left] -= np.log10(SYMBOLS - (int(root.distinct[0]) if len(root.distinct) else 0))
        return out


class Head:
    """The most frequent runs of a trie too large to broadcast, with their log10 probabilities."""

    def __init__(self, run: np.ndarray, known: np.ndarray):
        self.slots, self.known = Slots(run), known.astype(np.float32)

    def score(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Trie.score, 0 for the runs that are not here; and where these are."""
        at = self.slots.find(code)
        hit = at >= 0
        out = np.zeros(len(code))
        out[hit] = self.known[at[hit]]
        return out, np.flatnonzero(~hit)


@dataclass
class Scorer:
    """What tasks need, built once on the driver: of bounded size, whatever the corpus."""

    trie: Trie | Head
    head: Slots
    logs: np.ndarray
    end: float
    end_known: bool


@dataclass
class Model:
    trie: DataFrame
    runs: int
    vocabulary: DataFrame  # key, n
    tokens: int
    distinct: int
    docs: int


def learn(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts of byte runs and of words over all rows of docs. A null text counts as empty."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = shared.map_arrow(rows, _learn(order), "kind int, key long, n long")
    counts = shared.written(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    trie, vocabulary = (counts.where(F.col("kind") == k).select("key", "n") for k in (0, 1))
    sums = {r["kind"]: (r["keys"], r["n"]) for r in counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    distinct, total = sums.get(1, (0, 0))
    n_docs = sums.get(2, (0, 0))[1]
    return Model(trie, sums.get(0, (0, 0))[0], vocabulary, total + n_docs, distinct + (n_docs > 0), n_docs)


def _numbers(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = df.select("key", "n").toArrow()
    return found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()


def _last(code: Column | str, size: int) -> Column:
    """The last size bytes of a code."""
    return F.col(code) if size >= 8 else F.col(code).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


@dataclass
class Long:
    """The orders of a trie that are joined, longest first, and the trie below them."""

    orders: list[tuple[DataFrame, DataFrame]]  # runs: key, n; contexts: context, total, distinct, below
    lower: Trie

    @staticmethod
    def of(trie: DataFrame, order: int, most: int) -> Long:
        """Orders are joined until one has no more than most runs. Each is counted from all runs of the longer one."""
        orders, runs, k = [], trie, order
        while True:
            shorter = shared.written(runs.groupBy(_last("key", k).alias("key")).agg(F.sum("n").alias("n")), "runs")
            below = shorter.select(F.col("key").alias("suffix"), F.col("n").alias("n_below"))
            spread = runs.select(F.shiftrightunsigned("key", 8).alias("context"), _last("key", k).alias("suffix"), "n").join(below, "suffix")
            contexts = spread.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("n_below").alias("below"))
            orders.append((runs, shared.written(contexts, "contexts")))
            runs, k = shorter, k - 1
            if k == 0 or runs.count() <= most:
                return Long(orders, Trie(*_numbers(runs), k, whole=False))

    def head(self, most: int) -> Head:
        runs, contexts = self.orders[0]
        often = runs.where(F.col("n") >= at_least(runs, most)).withColumn("context", F.shiftrightunsigned("key", 8))
        found = often.join(contexts, "context").select("key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("n"))
        return Head(*_numbers(found))

    def priced(self, codes: DataFrame, order: int) -> DataFrame:
        """(code, price) for a table of different codes: the log10 probabilities that the whole trie gives."""
        spark = codes.sparkSession
        todo = codes.select("code", F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("kinds"))
        done = []
        for k, (runs, contexts) in zip(range(order, 0, -1), self.orders, strict=False):
            rows = todo.withColumn("key", _last("code", k + 1)).withColumn("context", F.shiftrightunsigned("key", 8))
            rows = rows.join(contexts, "context", "left").join(runs, "key", "left")
            paid = F.coalesce(F.col("n") - 0.5, 0.5 * (F.col("distinct") - F.col("kinds")))
            rows = rows.select(
                "code", (F.col("price") + F.when(paid > 0, F.log10(paid / (F.col("total") - F.col("gone")))).otherwise(0.0)).alias("price"),
                F.coalesce("below", "gone").alias("gone"), F.coalesce("distinct", "kinds").alias("kinds"), F.col("n").isNotNull().alias("found"),
            )
            rows = shared.written(rows, "prices")
            done.append(rows.where("found").select("code", "price"))
            todo = rows.where("not found").drop("found")
        handle = spark.sparkContext.broadcast(self.lower)

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, price, gone, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                price = handle.value.escaped(code.view(np.uint64), price.copy(), gone.copy(), kinds.copy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(price)], ["code", "price"])

        out = shared.map_arrow(todo, rest, "code long, price double")
        for part in done:
            out = out.unionByName(part)
        return out


def _score(handle, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Scorer = handle.value
        trie, head, logs = model.trie, model.head, model.logs
        key = TaskContext.get().partitionId() << 40
        for piece in shared.text_pieces(batches, limit=SCORED_BYTES):
            m = piece.num_rows
            w = words.split(piece.column("text"), "space", True)
            code, at = runs(w, words.buffers(piece.column("text"))[1], order)
            symbols, left = trie.score(code) if isinstance(trie, Head) else (trie.score(code), np.zeros(0, np.int64))
            score = np.add.reduceat(symbols, at[:-1])
            deep = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, at), pa.int32()), pa.array(code[left].view(np.int64)))
            h = w.hashes()
            found = head.find(h)
            known = found >= 0
            doc = w.text_of()
            base = np.bincount(doc[known], logs[found[known]], m) + model.end
            n_known = np.bincount(doc[known], minlength=m) + model.end_known
            rare, whose = h[~known].view(np.int64), doc[~known]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(m + 1)), pa.int32()), pa.array(rare))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + m)), piece.column("row"), pa.array(np.diff(w.at) + 1), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), lists, deep], ["key", "row", "n_tokens", "n_known", "base", "score", "rare", "deep"])
            key += m

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, order: int = ORDER, trie_runs: int = TRIE_RUNS, head_words: int = HEAD_WORDS) -> DataFrame:
    """For each row of docs: row, n_tokens, n_known, base_score and score.

    Texts are lower-cased in A-Z. score: log10 probability of the bytes and the end of
    the text under the trie. base_score: sum over the words ``[^\\x20\\x09-\\x0D]+`` and
    one end of log10((c + 0.1) / (N + 0.1 (V + 1))). A null text is empty; a model of no
    documents gives each symbol the same chance. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    least = at_least(model.vocabulary, head_words)
    scale = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    long = Long.of(model.trie, order, trie_runs // 2) if model.runs > trie_runs and order else None
    trie = long.head(trie_runs // 2) if long else Trie(*_numbers(model.trie), order)
    keys, n = _numbers(model.vocabulary.where(F.col("n") >= least))
    scorer = Scorer(trie, Slots(keys), np.log10(n + 0.1) - scale, float(np.log10(model.docs + 0.1)) - scale, model.docs > 0)
    handle = spark.sparkContext.broadcast(scorer)
    del scorer, trie
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType().add("key", "long").add(rows.schema["row"])
    for name, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("base", DoubleType()), ("score", DoubleType()), ("rare", ArrayType(LongType())), ("deep", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    done = shared.written(shared.map_arrow(rows, _score(handle, order), schema), "scores")
    rest = done.select("key", F.explode("rare").alias("word"))
    counts = model.vocabulary.where(F.col("n") < least).select(F.col("key").alias("word"), "n")
    more = rest.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1) - F.lit(scale)).alias("more"), F.count("n").alias("more_known")
    )
    done, score = done.join(more, "key", "left"), F.col("score")
    if long:
        codes = done.select("key", F.explode("deep").alias("code"))
        prices = codes.join(long.priced(codes.select("code").distinct(), order), "code").groupBy("key").agg(F.sum("price").alias("more_score"))
        done, score = done.join(prices, "key", "left"), score + F.coalesce("more_score", F.lit(0.0))
    return done.select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score")
    )


def held_out(id_col: Column) -> Column:
    """A tenth of the ids by crc32; a null id counts as held out."""
    return F.coalesce(shared.fold(id_col, 10) == 0, F.lit(True))
