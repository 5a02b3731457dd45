"""As-of join of two tables, early exit, caches by content, chunks without collecting, sampling."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import candidates, joins, order, spans
from quarryloom.sources import files


def test_asof_equals_brute_force_with_ties_nulls_and_one_large_file(spark):
    r = random.Random(2)
    left = [(i, r.choice(["a", "b", "c", None, "large"]), r.choice([None, *range(60)])) for i in range(400)] + [(1000 + i, "large", i) for i in range(3000)]
    right = [(r.choice(["a", "b", "large", None]), r.choice([None, *range(60)]), f"m{i}") for i in range(60)] + [("large", 2500, "last"), ("a", 3, None)]
    a = spark.createDataFrame(left, "id long, file string, line int").repartition(5).withColumn("value", F.lit("own"))
    b = spark.createDataFrame(right, "file string, line int, name string")

    def last(file, line):
        some = [(x[1], x[2]) for x in right if x[0] == file and x[1] is not None and line is not None and x[1] <= line and x[2]]
        return max(some)[1] if some and file is not None else None

    got = joins.asof(a, b, "file", "line", "name").collect()
    assert sorted((x["id"], x["found"], x["value"]) for x in got) == sorted((i, last(f, n), "own") for i, f, n in left)
    assert joins.asof(a.limit(0), b, "file", "line", "name").count() == 0
    assert all(x["found"] is None for x in joins.asof(a, b.limit(0), "file", "line", "name").collect())
    with pytest.raises(ValueError, match="found"):
        joins.asof(a.withColumn("found", F.lit(1)), b, "file", "line", "name")


def test_a_value_is_carried_over_ranges(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"))
        names = spark.createDataFrame([("f", 10, "first"), ("f", 4990, "last")], "file string, line int, name string")
        assert order.in_ranges(lines, "file", "line").select("part").distinct().count() > 1
        got = Counter(x["found"] for x in joins.asof(lines, names, "file", "line", "name").collect())
        assert got == {None: 10, "first": 4980, "last": 10}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_located_answers_none_one_and_several(spark):
    errors = spark.createDataFrame([(1, "one", 1), (2, "two", 5), (3, "two", 9), (4, "none", 3), (5, "two", 20), (6, None, 1)], "id int, file string, line int")
    methods = spark.createDataFrame([("one", 7, "only"), ("two", 8, "a"), ("two", 15, "b")], "file string, line int, name string")
    got = {x["id"]: (x["method"], x["n_methods"]) for x in joins.located(errors, methods).collect()}
    assert got == {1: ("only", 1), 2: (None, 2), 3: ("a", 2), 4: (None, 0), 5: ("b", 2), 6: (None, 0)}


@pytest.mark.parametrize("step", [1, 3])
def test_early_exit_judges_no_candidate_behind_the_first_valid(spark, step):
    r = random.Random(step)
    rows = [(k, p * 2, r.choice(["good", "bad", "mend"])) for k in range(60) for p in range(r.randrange(1, 7))] + [(99, 4, "bad"), (98, 0, "bad"), (98, 0, "good")]
    df = spark.createDataFrame(rows, "k long, pos int, code string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(code):
        seen.add(1)
        return code == "good"

    def judge(part):
        return candidates.judged(part, costly("code"), F.lit("mended"), F.col("code") == "mend")

    lazily = candidates.first_valid_lazily(df, "k", "pos", "code", judge, step)
    got, calls = sorted(map(tuple, lazily.collect())), seen.value
    assert got == sorted(map(tuple, candidates.first_valid(judge(df), "k", "pos", "code").collect()))
    needed = 0
    for k in {x[0] for x in rows}:
        mine = sorted({x[1] for x in rows if x[0] == k})
        valid = [p for p in mine if any(x[2] != "bad" for x in rows if x[:2] == (k, p))]
        rounds = len(mine) if not valid else (mine.index(valid[0]) // step + 1) * step
        needed += sum(x[0] == k and x[1] in mine[:rounds] for x in rows)
    assert calls == needed < len(rows)
    assert candidates.first_valid_lazily(df.limit(0), "k", "pos", "code", judge).count() == 0


def test_cache_by_content_sees_changed_inputs_plans_and_parameters(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.read.parquet(f"{tmp_path}/in")
    made = lambda: sorted(x.name for x in (tmp_path / "cache").iterdir())
    folder = f"file://{tmp_path}/cache"
    assert files.cached_by_content(folder, read().where("id > 1")).count() == 3
    assert files.cached_by_content(folder, read().where("id > 1")).count() == 3 and len(made()) == 1
    assert files.cached_by_content(folder, read().where("id > 2")).count() == 2 and len(made()) == 2
    assert files.cached_by_content(folder, read().where("id > 1"), version=2).count() == 3 and len(made()) == 3
    spark.range(100, 104).write.mode("append").parquet(f"{tmp_path}/in")
    assert files.cached_by_content(folder, read().where("id > 1")).count() == 7 and len(made()) == 4


def test_chunks_of_one_batch_that_holds_everything(spark):
    r = random.Random(4)
    rows = [(i, [f"{i}.{j}" for j in range(r.choice([0, 1, 3, 40, 700]))] if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(7).withColumn("b", F.lit(None).cast("int"))
    flat = [t for _, tokens in rows for t in tokens or []]
    got = {x["chunk"]: x["tokens"] for x in spans.packed_chunks(df, "b", "id", "tokens", 64).collect()}
    assert got == {k: flat[k * 64 : k * 64 + 64] for k in range(len(flat) // 64)}
    short = spans.packed_chunks(df.where("id = 1"), "b", "id", "tokens", 10_000).collect()
    assert [x["tokens"] for x in short] == ([rows[1][1]] if rows[1][1] else [])
    assert spans.packed_chunks(df.limit(0), "b", "id", "tokens", 4).count() == 0


def test_cut_points_are_uniform(spark):
    """Every choice of 2 cut points out of 5 comes about equally often: chi-square with 9 degrees of freedom."""
    keys = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    cuts = keys.select(spans._cuts(1, "z", F.col("key"), F.lit(6), F.lit(3)).alias("c"))
    counts = Counter(tuple(x["c"]) for x in cuts.collect())
    assert len(counts) == 10 and all(c[0] == 0 and c[3] == 6 and list(c) == sorted(set(c)) for c in counts)
    assert sum((n - 600) ** 2 / 600 for n in counts.values()) < 27.9  # 0.1 %


def test_wide_tables_are_bounded(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 3000, "b")], "k long, pos int, code string")
    with pytest.raises(ValueError, match="long form"):
        candidates.pivoted(df, "k", "pos", "code", candidates.width(df, "pos"))


def test_new_columns_never_replace_the_callers(spark):
    df = spark.createDataFrame([(1, 2, "x")], "k long, lines_total int, name string")
    own = df.withColumns({c: F.lit(0) for c in ("line_rate", "fixed", "enclosing")})
    from quarryloom.operators import outcomes

    for bad in (lambda: outcomes.coverage(own), lambda: candidates.judged(own, F.lit(True), F.lit(""), F.lit(True)), lambda: joins.enclosing(own, "k", F.col("name"), "k"), lambda: joins.with_archive(own, df, "k")):
        with pytest.raises(ValueError, match="columns of the new names"):
            bad()


def test_null_texts_flags_and_keys_and_clashing_names(spark):
    from quarryloom.functions import text
    from quarryloom.operators import outcomes

    one = spark.createDataFrame([(None, "a.B")], "x string, y string")
    x = F.col("x")
    got = one.select(text.format_code(x), text.simple_name(x), text.base_name(x), text.source_path(x), text.strip(x), text.remove_padding(x)).first()
    assert all(v is None for v in got) and one.select(text.method_id(x, F.col("y"))).first()[0] == "a.B"
    assert one.select(text.simple_name(F.lit("")), text.base_name(F.lit(""))).first()[:] == ("", "")
    flags = spark.createDataFrame([("p", 1, True, None, None, None, None), ("p", 2, None, None, None, None, None)], "project string, at int, " + ", ".join(f"{c} boolean" for c in outcomes.STAGES))
    single = outcomes.single_funnel(flags, ["project"]).first()
    assert (single["n_syntax_error"], single["n_compile_error"], single["n_execute_error"], single["n_failing_tests"]) == (1, 1, 0, 0)
    several = outcomes.any_of_k(flags.withColumn("first", F.lit("own")), ["project"], ["at"], "at").first()
    assert (several["total_tests"], several["n_syntax_error"], several["n_compile_error"]) == (2, 1, 2)
    names = ("pos", "best", "head", "_round", "key", "row", "found", "chosen")
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "k long, at int, code string").withColumns({c: F.lit("own") for c in names if c != "_round"})
    judge = lambda df: candidates.judged(df, F.col("code") == "b", F.lit(""), F.lit(False))
    assert candidates.first_valid(judge(turns), "k", "at", "code").first()[:] == (1, 1, "b", False, False)
    assert candidates.first_valid_lazily(turns, "k", "at", "code", judge).first()[:] == (1, 1, "b", False, False)
    classes = spark.createDataFrame([("1", "a.B"), (None, "a.C"), ("1", None)], "version string, modified_class string")
    methods = spark.createDataFrame([("1", "x/B.java"), (None, "x/C.java"), ("1", None)], "version string, path_focal_class string")
    assert joins.class_methods(classes, methods).count() == 1
    with pytest.raises(ValueError, match="focal_name"):
        joins.class_methods(classes.withColumn("focal_name", F.lit(1)), methods)
    assert joins.existing(classes, classes, "version").count() == 2
