"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Each labeller calls a text bad or good, or abstains. Expectation-maximisation over the
counts of vote patterns of all documents estimates each labeller's accuracies, without any
label. The posterior of a document's pattern is its soft label; a logistic scorer over
hashed words and word shapes learns from the soft labels of a bounded hash sample.

Form says nothing of insults: given a table of toxicity labels, words that mostly stand in
toxic texts are learned from a bounded sample of its rows and scored beside the quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from quarryloom.llm import shared, words

ABSTAIN, BAD, GOOD = 0, 1, 2
#: Documents that the linear scorer is fitted on, about, drawn by a hash of id and text, and
#: the most buckets of one of them, its most frequent: together they bound what the driver gets.
TRAIN_DOCS, TRAIN_BUCKETS = 10_000, 2048
BUCKETS = 1 << 16
ROUNDS, PASSES = 200, 300
#: Added to a text's number of features (three a word), so that a few words alone decide little.
SMOOTH = 60

#: Labelled ids that toxic words are learned from, about, drawn by a hash. A word marks toxic texts if the lower bound of
#: its share of them, at MARK_ERRORS standard errors (Wilson's interval), is above a half; the surest MARK_WORDS are used.
#: A text is toxic from a score of TOXIC on: one sure word or several less sure ones.
TOXIC_DOCS, MARK_ERRORS, MARK_WORDS, TOXIC = 10_000, 2.0, 10_000, 0.8

_symbol = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_upper = np.array([65 <= b <= 90 for b in range(256)])
_shape = np.array([1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint64)
LABELLERS = ("symbols", "capitals", "bare symbols", "stutter", "repeated runs", "variety", "short words", "shouting", "line ends")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][at])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(1, whole)


def _vote(good: np.ndarray, bad: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(~known, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts by labellers), hashed features of all words one after another, and each text's places among them."""
    w = words.split(texts)
    data, base = words.buffers(texts)
    n = np.diff(w.at)
    h = w.hashes()
    doc = w.text_of()
    solid = _sums(words.KINDS["space"][data], base)
    symbols = _share(_sums(_symbol[data], base), solid)
    alpha = _sums(_letter[data], base)
    capitals = _share(_sums(_upper[data], base), alpha)
    marks = np.r_[0, np.cumsum(_symbol[data], dtype=np.int64)]
    bare = _share(_sums(marks[w.ends] - marks[w.starts] == w.ends - w.starts, w.at), n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stutter = _share(_sums(same, w.at), n)
    first, runs = words.windows(h, w.at, 5)
    cut, distinct, again = np.searchsorted(first, w.at), np.zeros(len(n), np.int64), np.zeros(len(n))
    for i in range(len(n)):
        distinct[i] = len(np.unique(h[w.at[i] : w.at[i + 1]]))
        m = cut[i + 1] - cut[i]
        again[i] = 1 - len(np.unique(runs[cut[i] : cut[i + 1]])) / m if m else 0
    variety = np.log(np.maximum(2, distinct)) / np.log(np.maximum(2, n))
    short = _share(_sums(w.ends - w.starts <= 3, w.at), n)
    last, next_ = data[w.ends - 1], data[np.maximum(w.ends - 2, 0)]
    shouting = _share(_sums((last == 33) & (next_ == 33) & (w.ends - w.starts > 1), w.at), n)
    breaks = np.zeros(len(h), bool)  # words that end a line
    if len(h):
        lines = np.r_[0, np.cumsum(data == 10)]
        breaks[:-1] = (lines[w.starts[1:]] > lines[w.ends[:-1]]) | (doc[1:] != doc[:-1])
        breaks[-1] = True
    ended = _share(_sums(breaks & np.isin(last, [33, 46, 63]), w.at), _sums(breaks, w.at))
    many = n >= 20
    votes = np.stack([
        _vote(symbols <= 0.06, symbols >= 0.09, many), _vote(capitals <= 0.1, capitals >= 0.3, alpha >= 60), _vote(bare <= 0.02, bare >= 0.1, many),
        _vote(stutter <= 0.02, stutter >= 0.1, many), _vote(again <= 0.1, again >= 0.3, many), _vote(variety >= 0.85, variety <= 0.7, many),
        _vote((short >= 0.12) & (short <= 0.5), short <= 0.05, many), _vote(shouting <= 0.02, shouting >= 0.1, many), _vote(ended >= 0.9, ended <= 0.5, many),
    ], axis=1)
    shape = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        shape = shape << np.uint64(8) | np.where(at >= w.starts, _shape[data[np.maximum(at, 0)]], np.uint64(0))
    shape = shape << np.uint64(8) | _shape[data[w.starts]]
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    parts = [h >> top, words.mixed(shape + np.uint64(0x51ED270B)) >> top, words.mixed(same + np.uint64(0x2545F491)) >> top]
    return votes, np.stack(parts, axis=1).astype(np.int64).ravel(), 3 * w.at


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


@dataclass
class LabelModel:
    good: float  # share of good documents
    chance: np.ndarray  # class (bad, good) by labeller by vote, given that it votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that each row is good."""
        log = np.log([1 - self.good, self.good]) + np.stack([np.log(self.chance[y][np.arange(votes.shape[1]), votes]).sum(axis=1) for y in (0, 1)], axis=1)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation from vote patterns and their counts; it starts from the majority of votes."""
    m = votes.shape[1]
    for_good, for_bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    p = (for_good + 1) / (for_good + for_bad + 2)
    model = LabelModel(0.5, np.ones((2, m, 3)))
    for _ in range(rounds):
        weights = (counts * (1 - p), counts * p)
        # half a count for each vote keeps every chance above 0; to abstain says nothing
        chance = np.array([[[weight[votes[:, j] == v].sum() + 1 / 2 for v in (ABSTAIN, BAD, GOOD)] for j in range(m)] for weight in weights])
        chance /= chance[:, :, 1:].sum(axis=2, keepdims=True)
        chance[:, :, ABSTAIN] = 1
        model = LabelModel(float((weights[1].sum() + 1) / (counts.sum() + 2)), chance)
        p, old = model.posterior(votes), p
        if np.abs(p - old).max(initial=0) < 1e-9:
            break
    return model


def fit_scorer(index: np.ndarray, share: np.ndarray, row: np.ndarray, soft: np.ndarray, passes: int = PASSES, rate: float = 0.1, ridge: float = 1e-5) -> np.ndarray:
    """Weights by bucket and a last one for all, by Adam on the logistic loss of soft labels."""
    weights, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    weight = 1 / max(1, len(soft))
    for k in range(1, passes + 1):
        z = np.bincount(row, weights[index] * share, len(soft)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - soft) * weight
        slope = np.append(np.bincount(index, error[row] * share, BUCKETS), error.sum()) + ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        weights -= rate * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return weights


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for piece in shared.text_pieces(batches):
        total += np.bincount(pattern(features(piece.column("text"))[0]), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in shared.text_pieces(batches):
        votes, index, at = features(piece.column("text"))
        loads = []
        for i in range(len(votes)):
            found, n = np.unique(index[at[i] : at[i + 1]], return_counts=True)
            if len(found) > TRAIN_BUCKETS:
                most = np.sort(np.argsort(-n, kind="stable")[:TRAIN_BUCKETS])
                found, n = found[most], n[most]
            loads.append(found.astype("<u4").tobytes() + (n / (SMOOTH + n.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pattern(votes)), pa.array(loads, pa.binary())], ["pattern", "load"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text, with its least hash of five words, which most near copies share, and its label."""
    for piece in shared.text_pieces(batches):
        w = words.split(piece.column("text"), "alnum", lower=True)
        h, doc = w.hashes(), w.text_of()
        first, runs = words.windows(h, w.at, 5)
        key, alone = (np.full(piece.num_rows, np.iinfo(np.uint64).max) for _ in range(2))
        np.minimum.at(key, doc[first], runs)
        np.minimum.at(alone, doc, h)
        key = np.where(np.diff(w.at) < 5, alone, key)
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (h[order][1:] != h[order][:-1])
        at = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(key[doc[at]].view(np.int64)), piece.column("toxic").take(pa.array(doc[at]))], ["word", "key", "toxic"])


def toxic_words(rows: DataFrame, labels: DataFrame, label_docs: int = TOXIC_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that mark toxic texts, ascending, and the lower bounds of their shares.

    rows: (id, text); labels: (id, toxic). Null ids and labels take no part; an id with both labels is toxic. Texts of a
    label that share their least hash of five words count once, so that copies of one text teach no word of it.
    """
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    part = min(1 << 30, (label_docs << 30) // max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)  # label_docs rows, about: few enough to send
    held = shared.map_arrow(rows.join(F.broadcast(drawn), "id").select("text", "toxic"), _held, "word long, key long, toxic boolean")
    n, z = F.col("n"), MARK_ERRORS
    share = F.col("n_toxic") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    counts = held.distinct().groupBy("word").agg(F.count("*").alias("n"), F.count_if("toxic").alias("n_toxic"))
    found = counts.select("word", low.alias("low")).where("low > 0.5").orderBy(F.desc("low"), "word").limit(MARK_WORDS).toPandas()
    marks = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(marks)
    return marks[order], found["low"].to_numpy(np.float64)[order]


def toxicity(texts: pa.Array, marks: np.ndarray, low: np.ndarray) -> np.ndarray:
    """1 less the product of 1 - low over the different marks that a text holds; 0 without any."""
    w = words.split(texts, "alnum", lower=True)
    if not len(marks) or not len(w.starts):
        return np.zeros(len(texts))
    h = w.hashes()
    at = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
    hit = np.flatnonzero(marks[at] == h)
    pairs = np.unique(w.text_of()[hit] * len(marks) + at[hit])
    return 1 - np.exp(np.bincount(pairs // len(marks), np.log1p(-low)[pairs % len(marks)], len(texts)))


def _score(label: LabelModel, handle, marks=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in shared.text_pieces(batches):
            votes, index, at = features(piece.column("text"))
            weights = handle.value
            n = np.diff(at)
            z = np.bincount(np.repeat(np.arange(len(n)), n), weights[index], len(n)) / (SMOOTH + n) + weights[-1]
            score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
            columns = [piece.column("row"), pa.array((votes != ABSTAIN).sum(axis=1).astype(np.int64)), pa.array(label.posterior(votes)), pa.array(score)]
            names = ["row", "n_votes", "weak_score", "score"]
            if marks:
                columns.append(pa.array(toxicity(piece.column("text"), *marks.value)))
                names.append("toxic_score")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def classified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, train_docs: int = TRAIN_DOCS,
    labels: DataFrame | None = None, label_id: str = "doc_id", label_col: str = "toxic",
) -> DataFrame:
    """For each row of docs: row, n_votes, weak_score, score and keep; with labels also toxic_score and toxic.

    weak_score: the posterior that the text is good, from its labellers' votes. score: the
    linear scorer's, from 0 to 1; keep: it is at least one half. A null text and one
    without words score 0. The scorer is fitted on about train_docs rows, those whose hash of
    id and text is lowest, each different one once; label counts cover all rows.

    labels: label_col is above 0 for a toxic text of the id label_id. toxic_score is that of
    toxicity, by words that toxic_words learns; toxic: it is at least TOXIC. Quality says
    nothing of it: who wants neither takes the rows with keep and without toxic. Without
    labelled texts nothing is toxic, nor is a null text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = shared.map_arrow(rows.select("text"), _patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    label = fit_labels(unpacked(counts["pattern"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    total = int(counts["n"].sum())
    part = min(1 << 30, (train_docs << 30) // max(1, total))
    drawn = rows.select("text", F.xxhash64("id", "text").alias("hash")).where(F.pmod("hash", F.lit(1 << 30)) < part)
    sample = drawn.dropDuplicates(["hash"]).select("text")
    found = shared.map_arrow(sample, _examples, "pattern long, load binary").toArrow()
    loads = [x.as_py() for x in found.column("load")]
    sizes = np.array([len(x) // 8 for x in loads], np.int64)
    index = np.frombuffer(b"".join(x[: len(x) // 2] for x in loads), "<u4").astype(np.int64)
    share = np.frombuffer(b"".join(x[len(x) // 2 :] for x in loads), "<f4").astype(np.float64)
    soft = label.posterior(unpacked(found.column("pattern").to_numpy().astype(np.int64)))
    handle = spark.sparkContext.broadcast(fit_scorer(index, share, np.repeat(np.arange(len(loads)), sizes), soft))
    schema = StructType().add(rows.schema["row"]).add("n_votes", LongType()).add("weak_score", DoubleType()).add("score", DoubleType())
    marks = None
    if labels is not None:
        given = labels.select(F.col(f"`{label_id}`").cast("string").alias("id"), (F.col(f"`{label_col}`").cast("int") > 0).alias("toxic"))
        marks = spark.sparkContext.broadcast(toxic_words(rows.select("id", "text"), given))
        schema = schema.add("toxic_score", DoubleType())
    done = shared.map_arrow(rows.select("row", "text"), _score(label, handle, marks), schema).withColumn("keep", F.col("score") >= 0.5)
    return done.withColumn("toxic", F.col("toxic_score") >= TOXIC) if marks else done
