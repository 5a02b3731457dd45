"""N-gram Jaccard join: rare-first prefix filtering.

Shingles are ordered rare first, by a count sketch of fixed size over all documents and
then by hash; any one order gives every link, a good one gives few candidates. Documents
of equal sets form one class, so copies meet once. Each class posts its first shingles,
which any partner must share. Per posted shingle, all classes first meet its hub, the
class with the fewest rarer shingles. Once the components of those links are known, only
classes of different components that share a posted shingle still meet: pairs within a
component can't change the result, so a group of near copies costs one pair a member.
Length, positional and suffix filters apply to both; each pair left is verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import components, shared, words

WORDS = 5
#: Links need intersection / union of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 80, 100
#: The count sketch has 2**SKETCH_BITS counts whatever the input, 4 MB when broadcast.
SKETCH_BITS = 22
#: Chunks in which the sketches of tasks are added up, each in a task of its own.
CHUNKS = 512
#: Shares in which rows of one class are dealt.
SALT = 16
#: Classes of a shingle that meet all others of it in one task.
MEETING = 1000
#: Parts of the suffix filter.
PARTS = 512


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of size words; of fewer words, the whole is one."""
    w = words.split(texts, "space", True)
    h = w.hashes()
    first, runs = words.windows(h, w.at, size)
    at = np.searchsorted(first, w.at)
    out = []
    for i in range(len(w.at) - 1):
        a, b = w.at[i], w.at[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[at[i] : at[i + 1]]))
        elif b > a:
            whole = h[a : a + 1].copy()
            for j in range(a + 1, b):
                whole = whole * words.SHINGLE_BASE + h[j : j + 1]
            out.append(words.mixed(whole ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _scan(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        names = ["chunk", "id", "n", "h1", "h2", "load"]
        for piece in shared.text_pieces(batches):
            found = sets(piece.column("text"), size)
            for u in found:
                sketch[u >> np.uint64(64 - bits)] += np.uint32(1)
            sums = [[int(words.mixed(u ^ salt).sum(dtype=np.uint64).view(np.int64)) for u in found] for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))]
            m = piece.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), piece.column("id"), pa.array([len(u) for u in found], pa.int64()), *(pa.array(x, pa.int64()) for x in sums), pa.nulls(m, pa.binary())], names)
        press = zstandard.ZstdCompressor(level=1).compress
        loads = [press(x.tobytes()) for x in sketch.reshape(CHUNKS, -1)]
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), none, none, none, none, pa.array(loads, pa.binary())], names)

    return run


def _sum_chunks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for load in batch.column("load"):
            x = np.frombuffer(zstandard.decompress(load.as_py()), np.uint32).astype(np.int64)
            total = x if total is None else total + x
    # eight steps for each doubling of the count
    steps = np.minimum(255, np.rint(8 * np.log2(total + 1))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["chunk", "load"])


def _prefixes(handle, size: int, bits: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.frombuffer(handle.value, np.uint8)
        for piece in shared.text_pieces(batches):
            found = sets(piece.column("text"), size)
            lists, parts = [], np.zeros((len(found), PARTS), np.uint8)
            for i, u in enumerate(found):
                n = len(u)
                rare = steps[u >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(56) | u >> np.uint64(8)
                lists.append(u[np.argsort(rare, kind="stable")[: n - -(-num * n // den) + 1 if n else 0]].view(np.int64))
                parts[i] = np.bincount((u & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
            at = np.r_[0, np.cumsum([len(x) for x in lists])]
            prefix = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(lists)))
            odd = np.packbits(parts, axis=1).view(np.int64)
            columns = [pa.array(odd[:, k]) for k in range(PARTS // 64)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([len(u) for u in found], pa.int64()), prefix, *columns], ["id", "n", "prefix", *PART_NAMES])

    return run


PART_NAMES = [f"p{k}" for k in range(PARTS // 64)]


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            held: dict[int, np.ndarray] = {}
            for ids, column in ((a, "text_a"), (b, "text_b")):
                rows = {x: i for i, x in enumerate(ids) if x not in held}
                only = batch.column(column).take(pa.array(list(rows.values()), pa.int64()))
                lengths = np.cumsum(shared.byte_lengths(only))
                names, at = list(rows), 0
                while at < len(names):
                    to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + shared.PIECE_BYTES)))
                    held.update(zip(names[at:to], sets(only.slice(at, to - at), size), strict=True))
                    at = to
            linked = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = held[x], held[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    return run


def _need(x: str, y: str, num: int, den: int) -> Column:
    """The least intersection of linked sets of sizes x and y."""
    return F.ceil(F.lit(num) * (F.col(x) + F.col(y)) / F.lit(num + den))


def _filters(num: int, den: int) -> Column:
    """Length and positional filter for columns na, pa and nb, pb."""
    length = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return length & (left >= _need("na", "nb", num, den))


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)


def _suffix_filter(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) whose parts allow a link.

    Each set is cut into PARTS by hash. Two sets differ in at least one shingle of every
    part of which one has an odd and the other an even number.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(parts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(p).alias(f"{p}{x}") for p in PART_NAMES]), x)
    apart = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in PART_NAMES), F.lit(0))
    return pairs.where(F.col("na") + F.col("nb") - apart >= 2 * _need("na", "nb", num, den)).select("a", "b")


def _linked(pairs: DataFrame, rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    for x in "ba":
        pairs = pairs.join(rows.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")), x)
    return shared.map_arrow(pairs.select("a", "b", "text_a", "text_b"), _verify(size, num, den), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A set holds the distinct
    shingles of size words, or the whole of fewer words; a null text or one without words
    is empty and linked with nothing. Two rows link when den * intersection >= num * union.
    class_id: the least id with the same set; component_id: the least id reachable by
    links. A row with a null id has a null class and component. Rows of one id are one
    node; of a repeated id with different texts either text may stand for it. Shingles
    are compared by 64-bit hashes, sets of one class by 128 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scan = shared.written(shared.map_arrow(rows, _scan(size, sketch_bits), "chunk int, id long, n long, h1 long, h2 long, load binary"), "sets")
    chunks = scan.where("chunk is not null").groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, load binary").orderBy("chunk").collect()
    handle = spark.sparkContext.broadcast(b"".join(bytes(r["load"]) for r in chunks) or bytes(1 << sketch_bits))

    known = scan.where("chunk is null").select("id", "n", "h1", "h2")
    full = known.where("n > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"))
    usable = rows.where("id is not null and text is not null")
    schema = "id long, n long, prefix array<long>, " + ", ".join(f"{p} long" for p in PART_NAMES)
    prefixes = shared.map_arrow(usable, _prefixes(handle, size, sketch_bits, num, den), schema)
    prefixes = shared.written(prefixes.where("n > 0").join(classes.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi"), "prefixes")
    parts = prefixes.select("id", "n", *PART_NAMES)

    posted = prefixes.select("id", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("rank", F.col("pos").cast("long") * (1 << 40) + F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)))
    hubs = posted.groupBy("token").agg(F.min("rank").alias("hub"), F.count("*").alias("posts")).where("posts > 1").select("token", "hub")
    met = shared.written(posted.join(hubs, "token").select("token", "id", "n", "pos", (F.col("rank") == F.col("hub")).alias("is_hub")), "posts")

    fits = _filters(num, den)
    first = _side(met.where("is_hub"), "a").join(_side(met.where("not is_hub"), "b"), "token").where(fits & (F.col("a") != F.col("b")))
    tried = shared.written(_suffix_filter(first.select("a", "b"), parts, num, den), "pairs", few=True)
    links = shared.written(_linked(tried, usable, size, num, den), "links")

    found = shared.written(components.components(links), "components", few=True)
    placed = met.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = shared.written(placed, "placed")
    home = placed.where("is_hub").groupBy("token").agg(F.min("component").alias("home"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("posts")).where("lo <> hi")
    # the classes of a frequent shingle are dealt to several tasks, each of which meets all others
    shares = F.ceil(F.col("posts") / MEETING)
    split = shared.written(placed.join(mixed.select("token", shares.alias("shares")), "token").join(home, "token"), "split")
    strange = _side(split.where("component <> home"), "a", F.col("component").alias("ca"), F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"))
    every = _side(split, "b", F.col("component").alias("cb"), "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    second = strange.join(every, ["token", "share"]).where(fits & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("home")) | (F.col("a") < F.col("b"))))
    rest = _suffix_filter(second.select("a", "b"), parts, num, den).join(tried, ["a", "b"], "left_anti")
    more = shared.written(_linked(shared.written(rest, "pairs", few=True), usable, size, num, den), "links")

    # the links found last join components, so only these are joined anew
    for x in "ab":
        more = more.join(found.withColumnRenamed("id", x), x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
    joined = shared.written(components.components(more).withColumnRenamed("component", "reached"), "components", few=True)
    final = found.join(joined.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("reached", "component").alias("reached"))
    final = final.union(joined).distinct().withColumnRenamed("id", "class_id")
    # classes of several rows, dealt with a salt: one of them may hold a third of all rows
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT))
    several = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    named = full.withColumn("salt", salt).join(several, ["h1", "h2", "n", "salt"], "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id"))
    moved = final.where("reached <> class_id").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    named = named.withColumn("salt", salt).join(moved, ["class_id", "salt"], "left")
    named = named.select("id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("reached", "class_id").alias("component_id"))
    return named.union(known.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """The rows of docs without those whose component has a smaller id; rows with a null id stay."""
    gone = groups(docs, id_col, text_col, size, num, den).where("component_id <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
