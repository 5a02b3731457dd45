"""Archives as a data source, subword ids, masks and their runs."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import masks, spans, subwords
from quarryloom.sources import archives


def test_archives_round_trip_and_are_grouped_into_partitions(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"a{i % 7}.tar.bz2", f"d/m{i}", bytes(r.randrange(256) for _ in range(r.randrange(2000)))) for i in range(60)] + [("empty.tar.bz2", "none", None)]
    df = spark.createDataFrame(rows, "name string, member string, content binary").repartition(5)
    folder = f"file://{tmp_path}/x"
    archives.write_archives(df, folder)
    (tmp_path / "x" / "other.txt").write_text("no archive")
    got = archives.read_archives(spark, folder)
    assert sorted(tuple(x[:2]) + (bytes(x[2]),) for x in got.collect()) == sorted((n, m, c or b"") for n, m, c in rows)
    assert sorted(x.name for x in (tmp_path / "x").iterdir()) == sorted({n for n, _, _ in rows} | {"other.txt"})
    assert len(archives.Reader(folder).partitions()) == 1
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_a_failed_job_leaves_no_archive(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    fails = F.udf(lambda i: b"x" if i < 90 else 1 // 0, "binary")
    df = spark.range(100).select(F.concat(F.lit("a"), (F.col("id") % 9).cast("string"), F.lit(".tar.bz2")).alias("name"), F.col("id").cast("string").alias("member"), fails("id").alias("content"))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        archives.write_archives(df, folder)
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]
    with pytest.raises(Exception, match="needs a name"):
        archives.write_archives(spark.createDataFrame([(None, "m", b"")], "name string, member string, content binary"), folder)


def test_large_member_streams_through(spark, tmp_path):
    df = spark.range(40).select(F.lit("a.tar.bz2").alias("name"), F.format_string("%03d", "id").alias("member"), F.repeat(F.lit("0123456789"), 100_000).cast("binary").alias("content"))
    archives.write_archives(df, f"file://{tmp_path}/x")
    got = archives.read_archives(spark, f"file://{tmp_path}/x").agg(F.sum(F.length("content")).alias("n"), F.count("*").alias("members")).first()
    assert (got["n"], got["members"]) == (40_000_000, 40)


def test_subword_ids_are_the_librarys_and_give_the_text_back(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    texts = ["hello world", "", None, "naïve 日本語 ☃ 😀", "int x = a + b;", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("row", F.lit("own"))
    got = {r["id"]: r["ids"] for r in subwords.encoded(df, "body", path).collect()}
    own = subwords._processor(path)
    assert got == {i: None if t is None else [1, *own.encode(t)[:1024]] for i, t in enumerate(texts)}
    back = subwords.decoded(subwords.encoded(df, "body", path, limit=None, bos=None), "ids", path).collect()
    assert {r["id"]: r["text"] for r in back} == {i: t for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="ids"):
        subwords.encoded(df.withColumn("ids", F.lit(1)), "body", path)


def lengths(mask):
    out, at = [], 0
    for noise, same in groupby(mask, key=bool):
        n = len(list(same))
        out.append((at, n, noise))
        at += n
    return out


def test_masks_to_runs_and_back(spark):
    r = random.Random(3)
    rows = [(i, [r.random() < 0.4 for _ in range(r.randrange(12))]) for i in range(60)] + [(90, None), (91, [None, True, None])]
    df = spark.createDataFrame(rows, "id long, m array<boolean>").select("id", "m", masks.runs(F.col("m")).alias("r")).select("*", masks.mask_of(F.col("r")).alias("back"))
    for x in df.collect():
        if x["m"] is None:
            assert x["r"] is None
            continue
        assert [tuple(y) for y in x["r"]] == lengths(x["m"]) and x["back"] == [bool(y) for y in x["m"]]


def test_runs_cross_pieces(spark):
    r = random.Random(4)
    whole = {k: [r.random() < 0.7 for _ in range(200)] for k in range(5)}
    pieces = [(k, p, m[p * 7 : p * 7 + 7]) for k, m in whole.items() for p in range(29)] + [(0, 99, []), (0, 100, None)]
    got = masks.runs_of_pieces(spark.createDataFrame(pieces, "key long, piece int, m array<boolean>").repartition(6), "key", "piece", "m").collect()
    assert sorted(map(tuple, got)) == sorted((k, *x) for k, m in whole.items() for x in lengths(m))


def test_sentinels_from_the_mask_equal_corrupt(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), (F.col("id") * 3 + 2).cast("int")), lambda x: x.cast("string")).alias("tokens"))
    done = spans.corrupt(df, "k", "tokens", 500)
    cuts = lambda kind, size: spans._cuts(42, kind, F.col("k").cast("string"), size, F.col("n_spans"))
    mask = masks.mask_of_cuts(cuts("k", F.col("n") - F.col("n_noise")), cuts("z", F.col("n_noise")))
    rows = done.withColumn("mask", mask)
    other = F.transform("mask", lambda x: ~x)
    same = rows.select((masks.with_sentinels(F.col("tokens"), F.col("mask"), 500) == F.col("inputs")).alias("i"), (masks.with_sentinels(F.col("tokens"), other, 500) == F.col("labels")).alias("l"), F.size("mask").alias("m"), "n").collect()
    assert all(r["i"] and r["l"] and r["m"] == r["n"] for r in same)


def test_corrupted_subwords_give_the_librarys_ids_back(spark):
    from pathlib import Path

    from quarryloom.plans import queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the driver's tables")
    path = pytest.importorskip("public_tokenizers").path(queries.SUBWORDS)
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, data, "documents").select("doc_id", "text").collect()}
    own, rows = subwords._processor(path), queries.QUERIES["span_corrupt_subwords"](spark, data).collect()
    whole = {i: [1, *own.encode(t)[:1024]] for i, t in texts.items() if t is not None}
    assert {r["doc_id"] for r in rows} == {i for i, ids in whole.items() if len(ids) > 1}
    for r in rows:
        spans_of, at = {}, None
        for x in r["labels"].split(" ")[:-1]:
            at = x if x.startswith("<") else at
            spans_of.setdefault(at, []).extend([] if x.startswith("<") else [x])
        back = [y for x in r["inputs"].split(" ")[:-1] for y in (spans_of[x] if x.startswith("<") else [x])]
        assert back == [str(x) for x in whole[r["doc_id"]]] and len(spans_of) == r["n_spans"]
