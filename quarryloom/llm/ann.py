"""Approximate nearest neighbours: a permutation index.

Each vector is represented by its nearest pivots in order. Within a shard, every pivot
has a posting list of the vectors that have it among their nearest, with its rank there.
A query visits the lists of its own nearest pivots alone and adds up how far the ranks lie
apart (footrule distance; a pivot that is not listed counts as LISTED ranks away), and the
best share of a shard is ranked again: in single precision, and all that this can't tell from
the nearest by the exact cosine. Every vector is posted once. Queries
stream past each shard in batches, so a task holds one shard of bounded size, however
many queries there are. Equal vectors are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm import shared

PIVOTS = 256
#: Nearest pivots that are posted and searched: an eighth of all, so a query meets an eighth of the postings.
LISTED = 32
#: Share of a shard that is ranked again, and the least number.
RERANK, RERANK_LEAST = 0.3, 1024
#: Most vectors of a shard; fewer while there are fewer shards than shuffle partitions, but not less than SHARD_LEAST.
SHARD_VECTORS, SHARD_LEAST = 32_768, 4096
#: Rows among which pivots are sought.
PIVOT_SAMPLE = 2048
K = 5


def usable(vector: Column) -> Column:
    """Not null, not all zeros, no component null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    out = np.zeros((len(vectors), listed), np.int16)
    for a in range(0, len(vectors), SHARD_LEAST):
        out[a : a + SHARD_LEAST] = np.argsort(-(vectors[a : a + SHARD_LEAST] @ pivots.T), axis=1, kind="stable")[:, :listed]
    return out


class Postings:
    """The inverted file of a shard: for each pivot the vectors that have it among their nearest, with its rank there."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, listed: int = LISTED):
        self.pivots, self.listed, self.n = pivots, min(listed, len(pivots)), len(vectors)
        order = nearest_pivots(vectors, pivots, self.listed)
        pivot = order.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.starts = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
        self.rows = (by_pivot // self.listed).astype(np.int32)
        self.ranks = (by_pivot % self.listed).astype(np.int16)

    def best(self, query: np.ndarray, most: int) -> np.ndarray:
        """Rows by rising footrule distance over the query's pivots; only the lists of these are visited."""
        if most >= self.n:
            return np.arange(self.n)
        nearer = np.zeros(self.n, np.float32)
        for k, p in enumerate(nearest_pivots(query[None], self.pivots, self.listed)[0]):
            some = slice(self.starts[p], self.starts[p + 1])
            nearer[self.rows[some]] += self.listed - np.abs(self.ranks[some] - k)
        return np.argpartition(-nearer, most - 1)[:most]


class Shard:
    def __init__(self, batches: list[pa.RecordBatch], pivots: np.ndarray, listed: int):
        self.members = pa.chunked_array([x.column("members") for x in batches]).combine_chunks()
        self.first = self.members.values.to_numpy()[self.members.offsets.to_numpy()[:-1]]
        self.vectors = unit(np.concatenate([matrix(x.column("vector")) for x in batches]))
        self.rough = self.vectors.astype(np.float32)
        #: Twice what single precision is off by at most.
        self.margin = 4 * (self.vectors.shape[1] + 2) * float(np.finfo(np.float32).eps)
        self.postings = Postings(self.vectors, pivots, listed)
        self.most = min(len(self.vectors), max(RERANK_LEAST, int(np.ceil(RERANK * len(self.vectors)))))

    def answers(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k + 1 best entries for each query: its own may be among them."""
        found, scores, n = [], [], []
        for query in unit(matrix(queries.column("vector"))):
            rows = self.postings.best(query, self.most)
            near = self.rough[rows] @ query.astype(np.float32)
            if len(rows) > k + 1:
                rows = rows[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - self.margin]
            score = np.einsum("ij,j->i", self.vectors[rows], query)
            top = np.lexsort((self.first[rows], -score))[: k + 1]
            found.append(rows[top])
            scores.append(score[top])
            n.append(len(top))
        ids = queries.column("members").flatten().to_numpy()
        columns = [pa.array(np.repeat(ids, n)), self.members.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "members", "score"])


def _search(handle, k: int, listed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard first its vectors come, then the queries."""
        at, held, index = None, [], None
        for batch in batches:
            shard, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "query"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (query[1:] != query[:-1])) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
                if a == b:
                    continue
                if shard[a] != at:
                    at, held, index = shard[a], [], None
                part = batch.slice(a, b - a)
                if not query[a]:
                    held.append(part)
                    continue
                if held:
                    index, held = Shard(held, handle.value, listed), []
                if index:
                    yield index.answers(part, k)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, pivots: int = PIVOTS, listed: int = LISTED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each row of queries, but those of its own id.

    Nearness is the cosine in double precision; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do those of
    another size than most, nor rows with a null id. A query with no candidate has no row.
    Rows of one id are candidates each with its own vector, and queries as well.
    """
    spark = vectors.sparkSession

    def good(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        return rows.where(usable(F.col("vector")) & F.col("id").isNotNull())

    rows = good(vectors)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size, n = (size["size"], size["n"]) if size else (0, 0)
    rows = rows.where(F.size("vector") == size)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vector").toArrow().column("vector")
    _, distinct = np.unique(matrix(sample), axis=0, return_index=True)
    handle = spark.sparkContext.broadcast(unit(matrix(sample)[np.sort(distinct)[:pivots]]))

    # equal vectors: the k + 1 smallest ids can stand among the nearest, no others
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("members"))
    asked = good(queries).where(F.size("vector") == size).select(F.array("id").alias("members"), "vector").distinct()
    shards = max(1, -(-n // SHARD_VECTORS), min(shared.partitions(spark), -(-n // SHARD_LEAST)))
    posted = entries.select(F.pmod(F.xxhash64("members"), F.lit(shards)).alias("shard"), F.lit(False).alias("query"), "members", "vector")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    dealt = posted.union(asked.select(every.alias("shard"), F.lit(True).alias("query"), "members", "vector")).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = shared.map_arrow(dealt, _search(handle, k, listed), "query_id long, members array<long>, score double")
    each = found.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
