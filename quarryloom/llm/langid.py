"""Language ID by rank-order profiles.

A profile lists the most frequent n-grams of a language, or of a document, by rank. The
out-of-place distance adds up how far each n-gram of the document stands from its place in
the language's profile; one that is not there counts as farthest away.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarryloom.llm import shared

PROFILE = 300
SIZES = (1, 2, 3)
#: Most languages whose profiles are broadcast: 40 MB; those of more are joined.
LANGUAGES = 4096
#: Distinct n-grams that a map task holds before it sends them on.
HELD = 1_000_000
#: A document whose score is lower is rejected: it resembles no learned language.
LEAST_SCORE = 0.05
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each character its number plus 2, or 1 if it is no letter."""
    if not _letters:
        n = sys.maxunicode + 1
        isalpha = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
        _letters.append(np.where(isalpha, np.arange(2, n + 2), 1).astype(np.uint64))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size the codes of n-grams (0 where one would cross texts), and the texts' places.

    Letters are lower-cased; any other characters between letters are one space, as is
    each end of a text. A code holds 21 bits a character.
    """
    low = [(t or "").lower() for t in texts]
    chars = letters()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([0, *map(len, low)])
    # a 0 before each text, then a space on either side of it
    codes = np.insert(chars, np.repeat(ends[:-1], 2), np.tile(np.array([0, 1], np.uint64), len(low)))
    codes = np.insert(codes, ends[1:] + 2 * np.arange(1, len(low) + 1), np.uint64(1)) if len(low) else codes
    keep = codes != 1
    keep[1:] |= codes[:-1] != 1
    codes = codes[keep]
    at = np.r_[np.flatnonzero(codes == 0), len(codes)]
    out = []
    for size in SIZES:
        n = max(0, len(codes) - size + 1)
        code, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(size):
            code = code << np.uint64(21) | codes[j : j + n]
            ok &= codes[j : j + n] != 0
        code[~ok | (code == 1)] = 0
        out.append(code)
    return out, at


def _of_text(grams: list[np.ndarray], a: int, b: int) -> np.ndarray:
    found = np.concatenate([g[a : min(b, len(g))] for g in grams])
    return found[found > 1]


def _profile(found: np.ndarray, size: int) -> np.ndarray:
    """Codes by falling count, then rising code."""
    codes, counts = np.unique(found, return_counts=True)
    return codes[np.lexsort((codes, -counts))[:size]]


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge() -> int:
            for lang, parts in held.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                held[lang] = [(codes, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64))]
            return sum(len(parts[0][0]) for parts in held.values())

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, [(codes, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for piece in shared.text_pieces(batches):
            names = piece.column("lang").to_pylist()
            grams, at = ngrams(piece.column("text").to_pylist())
            parts: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(names):
                parts.setdefault(lang, []).append(_of_text(grams, at[i], at[i + 1]))
            for lang, found in parts.items():
                codes, n = np.unique(np.concatenate(found), return_counts=True)
                held.setdefault(lang, []).append((codes, n))
                size += len(codes)
            if size > HELD:
                size = merge()
                if size > HELD // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, code, rank): the profile of each language over all rows of docs with a text and a language."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = shared.map_arrow(rows, _count(), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # filtered as it is, so that every task keeps its own first n-grams of a language alone before they meet
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= profile).select("lang", "code", (F.col("nth") - 1).alias("rank"))


@dataclass
class Profiles:
    """For each n-gram of any profile, in order, the languages that have it and its ranks there: codes[i] has the entries from starts[i] to starts[i + 1]."""

    names: list[str]
    codes: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Profiles:
        named = rows.column("lang").combine_chunks().dictionary_encode()
        names = named.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        langs, code = place[named.indices.to_numpy()] if names else np.zeros(0, np.int64), rows.column("code").to_numpy().view(np.uint64)
        sort = np.argsort(code, kind="stable")
        codes, first = np.unique(code[sort], return_index=True)
        return Profiles([names[i] for i in order], codes, np.r_[first, len(code)], langs[sort], rows.column("rank").to_numpy()[sort].astype(np.int64))

    def nearness(self, mine: np.ndarray, profile: int) -> np.ndarray:
        """By how much each language is nearer to the n-grams than one that has none of them."""
        spot = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[spot] == mine)
        low, n = self.starts[spot[place]], np.diff(self.starts)[spot[place]]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = np.maximum(profile - np.abs(self.ranks[at] - np.repeat(place, n)), 0)
        return np.bincount(self.langs[at], near, len(self.names)).astype(np.int64)


def _ranked(profile: int, with_text: bool):
    """Each text with its most frequent n-grams in order and a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for piece in shared.text_pieces(batches):
            grams, at = ngrams(piece.column("text").to_pylist())
            mine = [_profile(_of_text(grams, at[i], at[i + 1]), profile).view(np.int64) for i in range(piece.num_rows)]
            kept = ["row", "text"] if with_text else ["row"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(range(key, key + len(mine)), pa.int64()), pa.array(mine, pa.list_(pa.int64()))], [*kept, "key", "codes"])
            key += len(mine)

    return run


def _joined(rows: DataFrame, profiles: DataFrame, profile: int, kept: list[str]) -> DataFrame:
    """predict's rows for more languages than are broadcast: n-grams meet the profiles that have them in joins."""
    schema = StructType([*[rows.schema[c] for c in kept], *StructType.fromDDL("key bigint, codes array<bigint>")])
    ranked = shared.written(shared.map_arrow(rows, _ranked(profile, "text" in kept), schema), "ranked")
    each = ranked.select("key", F.posexplode("codes").alias("place", "code")).join(profiles, "code")
    near = each.groupBy("key", "lang").agg(F.sum(F.greatest(F.lit(profile) - F.abs(F.col("rank") - F.col("place")), F.lit(0))).alias("near"))
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("near"), "lang")).alias("best"))
    first, n = F.lit(profiles.agg(F.min("lang")).first()[0]), F.size("codes")
    found = ranked.join(best, "key", "left")
    lang = F.when(n == 0, F.lit("und")).otherwise(F.when(F.coalesce(F.col("best.near"), F.lit(0)) < 0, F.col("best.lang")).otherwise(first))
    score = F.when(n == 0, F.lit(0.0)).otherwise(-F.coalesce(F.col("best.near"), F.lit(0)) / (F.lit(float(profile)) * n))
    return found.select(*kept, lang.alias("lang_pred"), score.alias("score"))


def _predict(handle, profile: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = handle.value
        for piece in shared.text_pieces(batches):
            grams, at = ngrams(piece.column("text").to_pylist())
            langs, scores = [], []
            for i in range(piece.num_rows):
                mine = _profile(_of_text(grams, at[i], at[i + 1]), profile)
                if not len(mine) or not profiles.names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                near = profiles.nearness(mine, profile)
                best = int(np.argmax(near))
                langs.append(profiles.names[best])
                scores.append(float(near[best]) / (profile * len(mine)))
            kept = ["row", "text"] if with_text else ["row"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", keep: list[str] | None = None, profile: int = PROFILE, languages: int = LANGUAGES) -> DataFrame:
    """For each row of docs: row (its kept columns but the text), the text if it is kept, lang_pred and score.

    score is 1 less the distance to the nearest profile over the largest possible one; of
    equally near languages the first by name is taken. A text that is null or has no
    letter is ``und`` with score 0, as is every text if no language was learned. The
    profiles of at most `languages` languages, some hundred rows each, are broadcast; those of more are joined.
    """
    keep = keep or docs.columns
    rows = shared.as_rows(docs, text_col, text_col, keep).select("row", "text")
    kept = ["row", "text"] if text_col in keep else ["row"]
    profiles = shared.written(profiles, "profiles", few=True)
    if profiles.select("lang").distinct().count() > languages:
        return _joined(rows, profiles, profile, kept)
    handle = docs.sparkSession.sparkContext.broadcast(Profiles.of(profiles.select("lang", "code", "rank").toArrow()))
    schema = rows.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return shared.map_arrow(rows, _predict(handle, profile, text_col in keep), schema)


def held_out(id_col: Column) -> Column:
    """A fifth of the ids by crc32; a null id counts as held out."""
    return F.coalesce(shared.fold(id_col, 5) == 0, F.lit(True))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """predict with profiles learned from the rows that are not held out."""
    return predict(docs, learn(docs.where(~held_out(F.col(f"`{id_col}`"))), text_col, lang_col), text_col, keep)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs in one of the learned languages: those with letters and a score of at least `least`."""
    found = identified(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return shared.changed_texts(found, docs, "text", "text", n_chars="")
