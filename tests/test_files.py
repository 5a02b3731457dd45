import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quarryloom.sources import files, sinks
from quarryloom.streaming import windows


def test_lines_and_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("l1\n\nl3\n")
    (tmp_path / "b.txt").write_text("x\ny\nz\n")
    (tmp_path / "c.txt").write_text("x\n")
    assert [r["text"] for r in files.text_lines(spark, f"{tmp_path}/a.txt").collect()] == ["l1", "", "l3"]
    pairs = files.paired_lines(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt").orderBy("line_no").collect()
    assert [tuple(r) for r in pairs] == [(0, "l1", "x"), (1, "", "y"), (2, "l3", "z")]
    with pytest.raises(ValueError):
        files.paired_lines(spark, f"{tmp_path}/a.txt", f"{tmp_path}/c.txt")
    sinks.write_lines(files.text_lines(spark, f"{tmp_path}/b.txt"), f"{tmp_path}/out")
    assert files.text_lines(spark, f"{tmp_path}/out").count() == 3


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(4000)]
    for name, part in (("a.txt", lines[:3000]), ("b.txt", lines[3000:])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["line_no"]: r["line"] for r in files.numbered_text(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [got[k] for k in range(4000)] == lines and len(got) == 4000


def test_written_files_strings_and_caches(spark, tmp_path):
    df = spark.createDataFrame([("a/b/C.java", "x"), ("d.txt", "")], "path string, content string")
    assert sinks.write_files(df, f"file://{tmp_path}/out") == 2
    assert (tmp_path / "out/a/b/C.java").read_text() == "x" and (tmp_path / "out/d.txt").read_text() == ""
    for content in ("long é", "b"):
        sinks.write_string(spark, content, f"file://{tmp_path}/one.txt")
        assert (tmp_path / "one.txt").read_text() == content
    makes = [lambda: spark.range(3), lambda: spark.range(9)]
    assert [files.cached(f"{tmp_path}/cache", make, spark).count() for make in makes] == [3, 3]


def test_csv_keeps_quotes_and_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi"\nthere, é'), ("b", None)], "id string, code string")
    for name in ("train", "test"):
        sinks.write_csv(df, f"{tmp_path}/{name}", ("code", "id"))
    got = files.csv_splits(spark, {n: f"{tmp_path}/{n}" for n in ("train", "test")})
    assert got.columns == ["code", "id", "split"] and got.count() == 4
    assert {r["code"] for r in got.where("id = 'a'").collect()} == {'say "hi"\nthere, é'}


def test_json_tree_catalogue_and_classes(spark, tmp_path):
    for version, n in (("1f", 2), ("2f", 11)):
        (tmp_path / "c" / version / "methods" / str(n)).mkdir(parents=True)
        (tmp_path / "c" / version / "methods" / str(n) / "corpus.json").write_text('{\n"path_focal_class": "a/B.java"}')
    got = files.corpus_json(spark, f"{tmp_path}/c").select("path_focal_class", "version", "number_method_by_version").collect()
    assert sorted(map(tuple, got)) == [("a/B.java", "1f", 2), ("a/B.java", "2f", 11)]
    (tmp_path / "cat.json").write_text('[{"project": "P", "classes": ["a.B", "a.$C\\n"]}]')
    assert files.class_catalogue(spark, f"{tmp_path}/cat.json").first()["classes"] == ["a.B", "a.$C"]
    (tmp_path / "classes").write_text("a.B\n\na.B\na.C\n")
    assert sorted(r[0] for r in files.class_list(spark, f"{tmp_path}/classes").collect()) == ["a.B", "a.C"]


def test_archives(spark, tmp_path):
    members = spark.createDataFrame([("Gson-12f-generated_test.3.tar.bz2", "a/B.java", bytearray(b"x")), ("Gson-12f-generated_test.3.tar.bz2", "c.txt", bytearray(b""))], "name string, member string, content binary")
    for r in sinks.archives(members).collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    for name in ("Gson-2f-generated_test.1.tar.bz2", "Gson-2f-scaffolding.tar.bz2"):
        with tarfile.open(tmp_path / name, "w:bz2") as tar:
            tar.addfile(tarfile.TarInfo("empty"), io.BytesIO())
    got = files.archive_listing(spark, str(tmp_path)).collect()
    assert [(r["pid"], r["vid"], r["vid_num"], r["tid"]) for r in got] == [("Gson", "2f", 2, 1), ("Gson", "12f", 12, 3)]
    inside = files.archive_members(spark, str(tmp_path)).where(F.col("name").startswith("Gson-12f")).orderBy("member").collect()
    assert [(r["member"], bytes(r["content"])) for r in inside] == [("a/B.java", b"x"), ("c.txt", b"")]
    k = spark.createDataFrame([("Cli-4b-generated_test.7.2.tar.bz2",), ("x",)], "name string")
    assert [tuple(r) for r in k.select(*files.archive_parts(F.col("name"), of_k=True)).collect()] == [("Cli", "4b", 4, "generated_tests", 7, 2), (None,) * 6]


def test_sources_and_logs(spark, tmp_path):
    for name in ("a/B_ESTest.java", "a/B_ESTest_scaffolding.java", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\ny")
    got = files.java_sources(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["path"].endswith("B_ESTest.java") and got[0]["lines"] == ["x", "y"]
    log = spark.createDataFrame([("[javac] /t/g/a/B.java:12: error: cannot find symbol. more",), ("[javac] x warning: y",), ("ok",)], "text string")
    rows = files.without_noise(log).select(*files.compile_error(F.col("text"))).collect()
    assert [tuple(r) for r in rows] == [("/t/g/a/B.java", "t.g.a.B", 12, "cannot find symbol"), (None,) * 4]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("n", "P", "1f", 1, True, True, False, False, False)], "name string, project string, version string, test_id int, correct_syntax boolean, compilable boolean, executable boolean, passing_test boolean, correct_test boolean")
    sinks.write_outcomes(rows, f"{tmp_path}/o")
    assert tuple(files.csv_table(spark, f"{tmp_path}/o").first())[4:] == ("Yes", "Yes", "No", "No", "No")
    for n in (1, 2):  # a project written twice has its last rows only
        sinks.write_summary(spark.createDataFrame([("P", n)], "project string, n int"), f"{tmp_path}/s")
    sinks.write_summary(spark.createDataFrame([("Q", 9)], "project string, n int"), f"{tmp_path}/s")
    assert sorted((r["project"], r["n"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/s").collect()) == [("P", "2"), ("Q", "9")]


def test_event_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id) as ts, 'a' as event_type, 1.0D as value from range(120)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windows.windowed_counts(windows.event_stream(spark, f"{tmp_path}/in", rows.schema))
    done = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [10, 50, 60]
