"""Embedding near-dedup: every pair of vectors by int8 tile products, with error bounds.

A unit vector x is kept as s q + t r + rest: q and r are int8, and the norms of what q
alone and of what both leave out are kept with it, so both errors are known, not estimated. Vectors
are dealt to shards, and each pair of shards is one group. A tile's products q . q' are
integers, which single precision holds exactly up to EXACT dimensions; with the errors
they say of nearly all pairs on which side of the threshold they lie. The second plane narrows
what is left; only pairs that stay open are computed from the original vectors, in double.

A group returns sums, the edges of a spanning forest and its open pairs, never its links.
Equal vectors are one class, so copies are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import ann, components, shared

THRESHOLD = 0.9
#: Bytes of codes in a shard at most, and the fewest vectors that are worth a shard.
SHARD_BYTES, SHARD_LEAST = 8 << 20, 1024
#: Vectors on the two sides of a tile.
TILE = (512, 2048)
#: Dimensions whose products of int8 numbers add up to less than 2**24.
EXACT = 1024
#: What rounding adds to an error at most.
ROUNDING = 1e-12
#: Pairs narrowed at once hold about so many numbers.
NARROWED = 1 << 21


def _plane(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, their scale for each row, and what they leave out."""
    scale = np.abs(rest).max(axis=1) / 127
    q = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return q, scale, rest - scale[:, None] * q


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of non-zero rows: both planes side by side, and (scale, scale of the second, error, error of both)."""
    x = vectors / np.abs(vectors).max(axis=1)[:, None]
    x = ann.unit(x)
    q, s, rest = _plane(x)
    r, t, left = _plane(rest)
    error = lambda y: np.sqrt(np.einsum("ij,ij->i", y, y)) * (1 + 1e-9) + ROUNDING
    return np.hstack([q, r]), np.stack([s, t, error(rest), error(left)], axis=1)


def _encode(batches):
    for batch in batches:
        size = batch.column("size").to_numpy()
        for d in np.unique(size):
            part = batch.filter(pa.array(size == d))
            codes, numbers = quantised(ann.matrix(part.column("vector")))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * int(d)), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            columns = [part.column("cls"), part.column("n"), part.column("size"), data, *[pa.array(numbers[:, k]) for k in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "size", "codes", "s", "t", "e", "f"])


class Side:
    """The vectors of a shard."""

    def __init__(self, rows: pa.Table, size: int):
        self.cls, self.n = (rows.column(c).to_numpy() for c in ("cls", "n"))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int8).reshape(len(self.cls), 2, size)
        self.q, self.r = codes[:, 0], codes[:, 1]
        self.s, self.t, self.e, self.f = (rows.column(c).to_numpy() for c in "stef")

    def nearly(self, rows: np.ndarray) -> np.ndarray:
        return self.s[rows, None] * self.q[rows] + self.t[rows, None] * self.r[rows]


def _bound(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """How far the product of two unit vectors is at most from that of their codes, which leave out e and f."""
    return e + (1 + e) * f + ROUNDING


def decided(a: Side, b: Side, same: bool, threshold: float):
    """For each tile: rows of a and of b that are linked, and rows that stay open. Of a shard with itself each pair comes once."""
    size = a.q.shape[1]
    for i in range(0, len(a.cls), TILE[0]):
        qa = a.q[i : i + TILE[0]].astype(np.float32)
        sa, ea = a.s[i : i + TILE[0]], a.e[i : i + TILE[0]]
        for j in range(i if same else 0, len(b.cls), TILE[1]):
            qb = b.q[j : j + TILE[1]].astype(np.float32)
            sb, eb = b.s[j : j + TILE[1]], b.e[j : j + TILE[1]]
            dots = qa[:, :EXACT] @ qb[:, :EXACT].T
            if size > EXACT:
                dots = dots.astype(np.float64)
                for k in range(EXACT, size, EXACT):
                    dots += qa[:, k : k + EXACT] @ qb[:, k : k + EXACT].T
            # of a row, the least product that may reach the threshold with the largest error of the tile
            least = ((threshold - _bound(ea, eb.max())) / sa * (1 - 1e-6)).astype(np.float32)
            x, y = np.nonzero(dots * sb.astype(np.float32) >= least[:, None])
            if same:
                once = x + i < y + j
                x, y = x[once], y[once]
            if not len(x):
                continue
            product = dots[x, y].astype(np.float64) * sa[x] * sb[y]
            bound = _bound(ea[x], eb[y])
            sure, maybe = product - bound >= threshold, product + bound >= threshold
            left = np.flatnonzero(maybe & ~sure)
            x, y = x + i, y + j
            step = max(1, NARROWED // size)
            for k in range(0, len(left), step):
                at = left[k : k + step]
                narrow = np.einsum("ij,ij->i", a.nearly(x[at]), b.nearly(y[at]))
                bound = _bound(a.f[x[at]], b.f[y[at]])
                sure[at], maybe[at] = narrow - bound >= threshold, narrow + bound >= threshold
            open_ = maybe & ~sure
            yield x[sure], y[sure], x[open_], y[open_]


def least_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the labels in place so that nodes joined by the edges a, b share their least one."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label[:] = next_


def _compare(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        i, j, size = (rows.column(c)[0].as_py() for c in ("i", "j", "size"))
        shard = rows.column("shard").to_numpy()
        a = Side(rows.filter(pa.array(shard == i)), size)
        b = a if i == j else Side(rows.filter(pa.array(shard == j)), size)
        shift = 0 if i == j else len(a.cls)
        cls = a.cls if i == j else np.r_[a.cls, b.cls]
        label, links, opened = np.arange(len(cls)), np.zeros(len(cls), np.int64), []
        for x, y, ox, oy in decided(a, b, i == j, threshold):
            np.add.at(links, x, b.n[y])
            np.add.at(links, y + shift, a.n[x])
            least_labels(label, x, y + shift)
            if len(ox):
                opened.append((a.cls[ox], b.cls[oy]))
        some = np.flatnonzero(links)
        oa, ob = (np.concatenate([o[k] for o in opened]) if opened else np.zeros(0, np.int64) for k in (0, 1))
        columns = [np.r_[cls[some], oa], np.r_[cls[label[some]], ob], np.r_[links[some], np.zeros(len(oa), np.int64)], np.r_[np.zeros(len(some), bool), np.ones(len(oa), bool)]]
        return pa.table(columns, ["a", "b", "n", "open"])

    return run


def cosine(x: Column, y: Column) -> Column:
    """In double precision; vectors of very large or very small numbers are scaled first."""

    def sized(v: Column) -> Column:
        most = F.array_max(F.transform(v, F.abs))
        return F.when(most.between(1e-100, 1e100), v).otherwise(F.transform(v, lambda e: e / most))

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    x, y = sized(x), sized(y)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def shards(n: int, size: int, partitions: int) -> int:
    """As many as their bytes ask for, or more for pairs enough to share out, but none of less than SHARD_LEAST."""
    by_bytes = -(-n * 2 * size // SHARD_BYTES)
    enough = int(np.ceil((np.sqrt(8 * partitions + 1) - 1) / 2))
    return max(1, by_bytes, min(enough, -(-n // SHARD_LEAST)))


def grouped(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", n_shards: int | None = None) -> DataFrame:
    """For every row: id, n_links, component_id and kept.

    n_links: other rows whose cosine is at least the threshold, which must be above 0; component_id: the
    smallest id reachable by links, the row's own included; kept: the row has that id.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different sizes. Each row is a vector of its own, also when
    ids repeat. A row with a null id takes part in links; without an id among those it
    reaches, its component is null, and such a row is kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = F.coalesce(ann.usable(F.col("vector")), F.lit(False))
    classes = rows.where(good).groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = shared.written(classes.select(F.monotonically_increasing_id().alias("cls"), "n", "least", F.size("vector").alias("size"), "vector"), "classes", few=True)
    counts = classes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc(F.col("n") * F.col("size"))).first()
    n, size = (counts["n"], counts["size"]) if counts else (0, 1)
    g = n_shards or shards(n, size, shared.partitions(spark))
    codes = shared.map_arrow(classes, _encode, "cls long, n long, size int, codes binary, s double, t double, e double, f double")
    dealt = codes.withColumn("shard", F.pmod(F.xxhash64("cls"), F.lit(g)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    dealt = dealt.withColumns({"i": F.least("shard", "other"), "j": F.greatest("shard", "other")}).drop("other")
    pairs = dealt.repartition(g * (g + 1) // 2, "size", "i", "j").groupBy("size", "i", "j")
    found = shared.written(pairs.applyInArrow(_compare(threshold), "a long, b long, n long, open boolean"), "pairs", few=True)

    vector = lambda end: classes.select(F.col("cls").alias(end), F.col("vector").alias(f"v{end}"), F.col("n").alias(f"n{end}"))
    verified = found.where("open").select("a", "b").join(vector("a"), "a").join(vector("b"), "b").where(cosine(F.col("va"), F.col("vb")) >= threshold)
    verified = shared.written(verified.select("a", "b", "na", "nb"), "verified", few=True)
    each = found.where("not open").select(F.col("a").alias("cls"), F.col("n").alias("links"))
    each = each.union(verified.select("a", "nb")).union(verified.select("b", "na")).groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.where("not open and a <> b").select("a", "b").union(verified.select("a", "b"))
    hung = components.components(edges).withColumnsRenamed({"id": "cls", "component": "root"})
    known = classes.select("cls", "n", "least", "vector").join(each, "cls", "left").join(hung, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = shared.written(known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root", "least"), "known", few=True)
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(roots, "root").select("vector", "n_links", "component_id")
    linked = rows.where(good).join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.union(alone).select("id", "n_links", "component_id", kept.alias("kept"))
