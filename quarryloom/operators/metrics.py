"""Corpus similarity scores: BLEU, weighted BLEU and CodeBLEU over pairs of a candidate and its reference.

N-grams are counted and clipped within a pair, whose two texts are in one row, so only a few
sums for each pair are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryloom.operators import tasks
from quarryloom.operators.columns import column

ORDERS = 4
#: Weight of a token that has none of its own.
LIGHT = 0.2
#: Words that are counted at once: about twenty arrays of eight bytes each.
WORDS = 100_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and the place of one of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]), order[first]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most WORDS words, or one row."""
    for batch in batches:
        sizes = sum(np.nan_to_num(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for c in ("c", "r"))
        a, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > a and held + n > WORDS:
                yield batch.slice(a, i - a)
                a, held = i, 0
            held += n
        if batch.num_rows > a:
            yield batch.slice(a)


def _sums(weights: Mapping[str, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = batch.num_rows
            sides = [batch.column(c) for c in ("c", "r")]
            lengths = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for x in sides]
            words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False)
            weight = np.array([weights.get(w, LIGHT) for w in words.dictionary.to_pylist()] or [0.0])[code] if weights is not None else None
            ids = _mixed((code.astype(np.uint64) + np.uint64(1)) * _MIX)
            owner = np.concatenate([np.repeat(np.arange(rows), n) for n in lengths])
            left = np.concatenate([np.repeat(np.cumsum(n), n) for n in lengths])
            left[: lengths[0].sum()] -= np.arange(lengths[0].sum())
            left[lengths[0].sum() :] -= np.arange(lengths[1].sum())  # words from here to the text's end
            cut, columns, gram = int(lengths[0].sum()), [], ids.copy()
            for n in range(1, ORDERS + 1):
                if n > 1:
                    gram[: len(gram) - n + 1] = _mixed(gram[: len(gram) - n + 1] * _STEP + ids[n - 1 :])
                whole = left >= n
                key = _mixed(gram ^ (owner.astype(np.uint64) + np.uint64(1)) * _MIX)
                mine, theirs = np.flatnonzero(whole[:cut]), np.flatnonzero(whole[cut:]) + cut
                (k, have, at), (want_k, want, _) = _runs(key[mine]), _runs(key[theirs])
                place = np.minimum(np.searchsorted(want_k, k), max(0, len(want_k) - 1))
                hit = np.where(want_k[place] == k, np.minimum(have, want[place]), 0) if len(want_k) else np.zeros(len(k), np.int64)
                w = weight[mine[at]] if n == 1 and weight is not None else 1.0
                who = owner[mine[at]]
                columns += [np.bincount(who, hit * w, rows), np.bincount(who, have * w, rows)]
            yield pa.RecordBatch.from_arrays([batch.column("by"), *map(pa.array, columns), *map(pa.array, lengths)], ["by", *[f"{x}{n}" for n in range(1, ORDERS + 1) for x in ("hit", "all")], "nc", "nr"])

    return run


def corpus_bleu(pairs: DataFrame, candidate: str, reference: str, weights: Mapping[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of by: bleu, p1..p4 and length_ratio over pairs of token arrays.

    Counts of n-grams are clipped to the reference's within a pair. Any precision of 0
    makes the score 0, as do no pairs. weights, if given, weigh unigrams; others have LIGHT.
    A null array is empty. N-grams are compared by 64-bit hashes.
    """
    tasks.small_batches(pairs.sparkSession)
    rows = pairs.select(F.struct(*[column(c) for c in by] or [F.lit(0).alias("_all")]).alias("by"), column(candidate).alias("c"), column(reference).alias("r"))
    sums = [f"{x}{n}" for n in range(1, ORDERS + 1) for x in ("hit", "all")]
    schema = StructType([rows.schema["by"], *StructType.fromDDL(", ".join([*[f"{x} double" for x in sums], "nc bigint", "nr bigint"]))])
    each = rows.mapInArrow(_sums(dict(weights) if weights is not None else None), schema)
    row = each.groupBy(*[F.col("by")[c].alias(c) for c in by]).agg(*[F.sum(x).alias(x) for x in (*sums, "nc", "nr")])
    p = [F.coalesce(F.try_divide(f"hit{n}", f"all{n}"), F.lit(0.0)) for n in range(1, ORDERS + 1)]
    mean = F.exp(reduce(lambda a, b: a + b, [F.log(x) for x in p]) / ORDERS)
    short = F.when(F.col("nc") >= F.col("nr"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.col("nr").cast("double"), F.col("nc"))))
    score = F.when(F.least(*p) > 0, F.coalesce(short, F.lit(0.0)) * mean).otherwise(F.lit(0.0))
    return row.select(*by, score.alias("bleu"), *[x.alias(f"p{n}") for n, x in enumerate(p, 1)], F.try_divide(F.col("nc").cast("double"), F.col("nr")).alias("length_ratio"))


def code_bleu(ngrams: DataFrame, weighted: DataFrame, syntax: DataFrame, flow: DataFrame, by: str, parts: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """(by, bleu, weighted_bleu, syntax, data_flow, codebleu) from the two BLEU scores and from matched and total of subtrees and of data-flow edges.

    No reference edges at all count as no match, as do no subtrees.
    """
    share = lambda df, name: df.select(by, F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("total")), F.lit(0.0)).alias(name))
    rows = ngrams.select(by, "bleu").join(weighted.select(by, F.col("bleu").alias("weighted_bleu")), by)
    rows = rows.join(share(syntax, "syntax"), by, "left").join(share(flow, "data_flow"), by, "left").na.fill(0.0, ["syntax", "data_flow"])
    names = ("bleu", "weighted_bleu", "syntax", "data_flow")
    return rows.select(by, *names, reduce(lambda a, b: a + b, [F.col(n) * w for n, w in zip(names, parts, strict=True)]).alias("codebleu"))
