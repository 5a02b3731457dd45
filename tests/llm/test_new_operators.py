"""Operators 11 to 13 against brute force, at and beyond their bounds, and on odd rows."""

import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import band_join, filter_audit, int8_links, queries

# --- 11 -----------------------------------------------------------------------------------


def clustered(n=300, d=12, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    rows = [list(map(float, centres[r.integers(12)] + r.normal(size=d) * r.choice([0.05, 0.3, 0.6]))) for _ in range(n)]
    return rows + [rows[0]] * 20 + [[3 * x for x in rows[1]], [1e200 * x for x in rows[1]], [1e-200 * x for x in rows[2]]]


def links_of(rows, threshold):
    """n_links and component by comparing every pair."""
    unit = [None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.abs(v).max() for _, v in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    n, label = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    out = []
    for i, (k, _) in enumerate(rows):
        component = least.get(root(i))
        out.append((k, n[i], component, component is None or k == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("threshold", "n_shards"), [(0.9, None), (0.9, 4), (0.3, 3), (0.999, 2)])
def test_links_equal_brute_force(spark, threshold, n_shards):
    vectors = clustered()
    rows = [(i * 3 % 331, v) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, vectors[5][:7], vectors[5][:7]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(None, vectors[3]), (7, vectors[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("own") for c in ("id", "cls", "vector", "n", "root")})
    got = sorted(map(tuple, int8_links.grouped(df, threshold, n_shards=n_shards).collect()), key=repr)
    assert got == links_of(rows, threshold)


def test_pairs_close_to_the_threshold_are_decided_exactly(spark):
    """Two vectors at an angle whose cosine differs from the threshold by 1e-9 either way."""
    rows = []
    for k in range(40):
        c = 0.9 + (1e-9 if k % 2 else -1e-9)
        a = np.zeros(80)
        a[2 * k] = 1.0
        b = np.zeros(80)
        b[2 * k], b[2 * k + 1] = c, math.sqrt(1 - c * c)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in int8_links.grouped(df).collect()}
    assert got == {i: (i // 2) % 2 for i in range(80)}


def test_error_bounds_hold_and_leave_few_pairs_open():
    r = np.random.default_rng(3)
    for d in (1, 3, 64, 1500):
        x = r.normal(size=(60, d)) * r.choice([1e-3, 1, 50], size=(60, 1))
        codes, numbers = int8_links.quantised(x)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        q, s, e = codes[:, :d].astype(float), numbers[:, 0], numbers[:, 2]
        near = (s[:, None] * q) @ (s[:, None] * q).T
        assert (np.abs(unit @ unit.T - near) <= int8_links._bound(e[:, None], e[None])).all()
        both = s[:, None] * q + numbers[:, 1][:, None] * codes[:, d:]
        assert (np.abs(unit @ unit.T - both @ both.T) <= int8_links._bound(numbers[:, 3][:, None], numbers[:, 3][None])).all()
        assert (numbers[:, 3] < 1e-3).all()


def test_long_vectors_are_multiplied_in_exact_slices(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=2500)
    rows = [(i, (base + r.normal(size=2500) * (0.2 if i % 2 else 2)).tolist()) for i in range(40)]
    got = sorted(map(tuple, int8_links.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == links_of(as_float, 0.9)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert int8_links.grouped(df).count() == 0
    assert int8_links.grouped(spark.createDataFrame([(1, None)], df.schema)).collect()[0][:] == (1, 0, 1, True)


# --- 12 -----------------------------------------------------------------------------------


def in_band(x, y, a=50, num=5, den=1000):
    return abs(x - y) <= a or den * abs(x - y) <= num * min(x, y)


def test_band_join_finds_each_pair_once(spark):
    r = random.Random(1)
    values = [r.choice([r.randrange(-200, 400), r.randrange(9_800, 10_300), r.randrange(10**6, 10**6 + 20_000), r.randrange(2**50, 2**50 + 2**44)]) for _ in range(250)] + [None, 0, 10_000, 10_050, 10_051, 9_950, 20_000, 20_100, 20_101]
    left, right = [(i, v) for i, v in enumerate(values)], [(i, v) for i, v in enumerate(values[::-1] + values[:9])]
    a, b = spark.createDataFrame(left, "id long, gap long"), spark.createDataFrame(right, "id long, gap long")
    got = sorted((x["left"]["id"], x["right"]["id"], x["gap"]) for x in band_join.band_join(a, b, "gap", "gap").collect())
    assert got == sorted((i, j, abs(x - y)) for i, x in left for j, y in right if x is not None and y is not None and in_band(x, y))
    with pytest.raises(Exception, match="beyond"):
        band_join.band_join(spark.createDataFrame([(1, 1 << 60)], "id long, gap long"), b, "gap", "gap").collect()


def near_by_force(items, lines, k):
    def cents(x):
        return None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)

    out = []
    for item, price in items:
        p, pairs = cents(price), []
        for sale, no, other, q, amount in lines:
            a = cents(amount)
            if None in (p, item, sale, other, q, a) or q == 0 or item == other:
                continue
            u = (2 * a + q) // (2 * q)
            if in_band(p, u):
                pairs.append((abs(u - p), u, sale, no is None, no, other))
        pairs.sort(key=lambda x: tuple(v or 0 for v in x))
        crc = sum(zlib.crc32(f"{s},{'' if n is None else n},{o}".encode()) for _, _, s, _, n, o in pairs)
        sums = (len(pairs), sum(x[0] for x in pairs), crc)
        out += [(item, rank, g, u, s, n, o, *sums) for rank, (g, u, s, _, n, o) in enumerate(pairs[:k], 1)] or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dominated", [100_000, 0])
@pytest.mark.parametrize("k", [2, 10])
def test_near_lines_equal_brute_force(spark, monkeypatch, dominated, k):
    monkeypatch.setattr(band_join, "DOMINATED", dominated)
    r = random.Random(k)
    items = [(i % 25, r.choice([None, 1.0, 1.2, 3.49, 150.0, 150.6, 400.0])) for i in range(40)] + [(None, 1.0), (77, 9999.0), (0, 1.0), (0, 1.0)]
    lines = [(r.choice([None, *range(60)]), r.choice([None, 1, 2, 3]), r.choice([None, 0, 0, 0, *range(25)]), r.choice([None, 0, 1, 2, 7]), r.choice([None, 1.0, 2.4, 7.0, 150.3, 301.0, 1050.0, float("nan"), float("inf")])) for _ in range(1500)]
    lines += [(5, 1, 0, 1, 1.0)] * 60 + [(s, 1, 0, 1, 3.49) for s in range(50)] + [(90, 2, 3, 1, 3.49), (91, 2, 3, 1, 3.49)]
    a = spark.createDataFrame(items, "item_id long, price double").withColumn("rank", F.lit("own"))
    b = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, quantity int, amount double").repartition(6).withColumn("u", F.lit("own"))
    monkeypatch.setattr(band_join.first_lines, "__defaults__", (10, dominated))
    got = sorted(map(tuple, band_join.near_lines(a, b, k).collect()), key=repr)
    assert got == near_by_force(items, lines, k)


def test_no_items_or_lines(spark):
    items, lines = spark.createDataFrame([], "item_id long, price double"), spark.createDataFrame([], "sale_id long, line_no int, item_id long, quantity int, amount double")
    assert band_join.near_lines(items, lines).count() == 0
    some = spark.createDataFrame([(1, 2.0)], items.schema)
    assert band_join.near_lines(some, lines).collect()[0][:] == (1, 0, None, None, None, None, None, 0, 0, 0)


# --- 13 -----------------------------------------------------------------------------------


def audited(docs, labels):
    def words(t):
        return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]

    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = ("A" if len(w) < 100 else "") + ("B" if 100 * len(set(w)) < 80 * len(w) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else "")
        fails += ("D" if set(t) & set("#$%&*|") else "") + ("E" if i is not None and i > first[t] else "")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {x[0] for x in rows}:
        mine, removed_in = [x[1:] for x in rows if x[0] == part], Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_in[f] += len(gone)
                failing = sum(f in x[0] for x in mine)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(x[0] == f for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*x[:-1], removed_in[x[-1]]) for x in steps]
    return sorted(out)


def test_audit_equals_replaying_every_order(spark):
    r = random.Random(6)
    texts = ["", None, "A B C", "wort " * 120, " ".join(map(str, range(150))), " ".join(f"w{i}" for i in range(150)) + " #", "ABC " * 30 + "|", "x\ty\nz " * 50, "ΑΒΓ " * 10, "$"]
    docs = [(r.choice([None, *range(30)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(150)] + [(3, "same", "en")] * 5 + [(2, "same", "de")] * 3 + [(900, "word", f"junk{i}") for i in range(3)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 30, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1)]
    a = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5).withColumns({c: F.lit("own") for c in ("n", "part", "digest", "good", "id", "A")})
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.interactions(filter_audit.joint_failures(filter_audit.flagged(a, b)))
    assert rows.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, rows.collect())) == audited(docs, labels)
    none = filter_audit.interactions(filter_audit.joint_failures(filter_audit.flagged(a)))
    assert sorted(x[:7] + (x[9],) for x in map(tuple, none.collect())) == [x[:7] + (x[9],) for x in audited(docs, labels)]
    empty = filter_audit.interactions(filter_audit.joint_failures(filter_audit.flagged(a.limit(0), b)))
    assert empty.count() == 0


def test_any_number_of_filters(spark):
    rows = spark.createDataFrame([("p", 1, 0, 1, 4), ("p", 0, 0, 0, 6), ("p", 1, 1, 1, 5)], "part string, x int, y int, z int, w long")
    got = filter_audit.interactions(filter_audit.joint_failures(rows, "xyz", ["w"]), "xyz", ["w"])
    first = {r["step"]: (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got.where("filter_order = 'yxz'").collect()}
    assert first == {1: (10, 5, 0, 0, 10), 2: (6, 4, 5, 0, 22), 3: (6, 0, 9, 0, 22)} and got.count() == 18


def test_the_three_queries_are_registered_with_sql():
    for name in ("op11_embedding_dedup", "op12_price_band_join", "op13_filter_audit"):
        assert name in queries.queries() and name in queries.oracle_sql()
