import base64
import hashlib
import random

import numpy as np
import pytest

from quarryloom.llm import ann, shared, store, warc


def pages(seed=1):
    r = random.Random(seed)
    rows = [(i, f"http://h{i % 3}.example/ü?q={i}", r.choice(["<p>same</p>", "", None, f"<b>{i}é</b>" * r.randrange(1, 9000)])) for i in range(60)]
    return [*rows, (7, None, "<p>again</p>"), (None, "x\r\ny", "<p>again</p>"), (None, None, None)]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS sha", "'own' AS last_id", "'own' AS content")
    folder = shared.scratch(spark, "test")
    listed = warc.write_pages(df, folder)
    found = warc.read_pages(spark, folder, listed).collect()
    assert listed.count() > 3 and len(found) == len(rows) and all(r["valid"] for r in found)
    last, copies = {}, {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
        copies[html or ""] = copies.get(html or "", 0) + 1
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = copies[html or ""] > 1 and i is not None and i != last[html or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None, None if revisit else data))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert any(r["payload_bytes"] > 2 * warc.SEGMENT_BYTES for r in found)


def test_lost_and_damaged_segments_are_told(spark):
    from pyspark.sql import functions as F

    from quarryloom.llm import store

    folder = shared.scratch(spark, "test")
    parts = warc.page_records("a", 1, "u", b"x" * 100_000, None, False)
    whole = warc.page_records("b", 2, "u", b"y" * 100_000, None, False)
    other = warc.page_records("c", 3, "u", b"z" * 100_000, None, False)
    names = [store.put(folder, "one", b"".join([*parts[:1], *parts[2:], *reversed(whole)])), store.put(folder, "two", b"".join([*other, other[1]]))]
    store.put(folder, "left", b"".join(warc.page_records("d", 9, None, b"", None, False)))  # a file of a task that was repeated
    files = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["page_id"]: r["valid"] for r in warc.read_pages(spark, folder, files).select("page_id", "valid", F.length("payload")).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 20_000):
        assert warc.dechunked(warc.chunked(bytes(n))) == bytes(n)
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc", b"3\r\nabcXX0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_a_revisit_of_a_lost_page_is_not_valid(spark):
    folder = shared.scratch(spark, "test")
    listed = warc.write_pages(spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "other")], "page_id long, url string, html string").coalesce(1), folder)
    assert {r["page_id"]: (r["record_type"], r["valid"]) for r in warc.read_pages(spark, folder, listed).collect()} == {1: ("revisit", True), 2: ("response", True), 3: ("response", True)}
    alone = store.put(folder, "alone", b"".join(warc.page_records("x", 9, None, b"gone", 8, True)))
    wrong = store.put(folder, "wrong", b"".join(warc.page_records("y", 10, None, b"not the same", 2, True)))
    more = listed.select("name").union(spark.createDataFrame([(alone,), (wrong,)], "name string"))
    got = {r["page_id"]: r["valid"] for r in warc.read_pages(spark, folder, more).collect()}
    assert got == {1: True, 2: True, 3: True, 9: False, 10: False}


def test_no_pages(spark):
    folder = shared.scratch(spark, "test")
    listed = warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert listed.count() == 0 and warc.read_pages(spark, folder, listed).count() == 0


def brute(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 6}
    out = {}
    for q in asked:
        if q in good:
            cos = [(-float(good[q] @ v / (np.linalg.norm(good[q]) * np.linalg.norm(v))), i) for i, v in good.items() if i != q]
            out[q] = sorted(cos)[:k]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # copies
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None] * 3), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [1.0] * 5), (None, [1.0] * 6), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'own' AS vector", "'own' AS members")
    found = ann.neighbours(df, df.where("vec_id % 5 = 0 or vec_id > 200")).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = brute(rows, [i for i, _ in rows if i is not None and (i % 5 == 0 or i > 200)], 5)
    assert set(got) == set(expected)
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert [x[1] for x in found if x[2] < 0.999999] == [i for s, i in expected[q] if -s < 0.999999]
        assert [x[2] for x in found] == pytest.approx([-s for s, _ in expected[q]], abs=1e-12)
    assert [x[1] for x in got[205]] == [3, 200, 201, 202, 203]


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_VECTORS", 1500)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = ann.neighbours(df, df.where("vec_id % 50 = 0")).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-cos)[:5].tolist()))
    assert len(found) == 400 and hits / 400 >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.neighbours(none, none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.neighbours(one, one).count() == 0
