"""What keeps a query's time and memory in proportion to its input."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryloom.functions import javagrammar as java
from quarryloom.operators import joins, masks, metrics, spans, tasks
from quarryloom.plans import queries


def _flat(tree, at=0):
    """A tree without its helper nodes, with the places of terminals."""
    if isinstance(tree, int):
        return [tree + at]
    name, below = tree
    if not isinstance(name, str):
        return _flat(name.tree, below)
    found = [x for c in below for x in _flat(c, at)]
    return found if name[0] == "_" else [(name, found)]


def test_remembered_runs_give_the_trees_of_parse():
    draw = random.Random(3)
    parts = ["a(b);", "x = y + z;", "if (c) d();", "for (int i = 0; i < n; i++) {", "}", "else", "List<A<B>> l = (p, q) -> { return p; };", "int", ";", "(A) b;", "f(" + ", ".join("a" * 70) + ");"]
    before = java.grammar()._size
    for n in range(300):
        kinds = [k for k, _, _ in java.lexed("void m() { " + " ".join(draw.choices(parts, [9, 9, 9, 2, 2, 1, 2, 1, 1, 1, 1], k=n % 12)) + " }" * (1 + n % 2))]
        tree, parsed = java.grammar().tree(kinds), java.grammar().parse(kinds)[0]
        assert (tree and _flat(tree)) == (parsed and _flat(parsed))
    assert java.grammar()._size > before


def test_short_rows_are_dealt_to_all_tasks(spark):
    least = tasks.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert tasks.spread(spark.range(100).coalesce(1)).select(F.spark_partition_id().alias("p")).distinct().count() >= least // 2


def test_a_tree_query_parses_once(spark):
    for name in ("syntax_tree_descendants", "syntax_tree_children"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


_NESTED = [
    "a(b);", "x = y + z;", "if (c) d();", "for (int i = 0; i < n; i++) {", "}", "int a = 1, b = a;", "{ int a = b; a++; x = (y = a) + b; }", "f = (p, q) -> { return p + x; };", "for (A a : b) { c += a; }",
    'x = ";{";', "// x;\n", "/* { */ y /= 2;", "z = " + "1 + " * 70 + "x;",
]


def _texts(count):
    draw = random.Random(4)
    found = ("void m(int b) { " + " ".join(draw.choices(_NESTED, k=n % 9)) + " }" * draw.randrange(1, 3) for n in range(count))
    return [code for code in found if java.nodes(code) is not None]


def test_tokens_by_runs_are_those_of_the_whole_text():
    for code in [*_texts(200), "a = 'b;' + \"{", "/* ; {", "#;$;été;", "x" * 100 + "; y", ";", ""]:
        whole = [(m.group(), m.start(), m.end()) for m in java._TOKEN.finditer(code) if m.lastgroup != "skip"]
        assert [(code[a:b], a, b) for _, a, b in java.lexed(code)] == whole


def test_what_is_remembered_of_texts_is_bounded():
    for n in range(9000):
        java.lexed(f"void m{n}(int a) {{")
    before = java._run_tokens.cache_info()
    assert before.currsize <= before.maxsize == 1 << 13
    java.lexed("a " * 100 + ";")
    assert java._run_tokens.cache_info().misses == before.misses  # a long run is read, not kept


@pytest.mark.parametrize(("code", "found"), [('f("' + "a b" * 300_000 + '");', (False, 0)), ("f('" + r"\n" * 300_000 + "');", (False, 0)), ('f("' + "abc" * 300_000, (True, None))])
def test_literals_are_read_in_little_memory(code, found):
    """Some copies of the text; places to return to in it would take over 100 times its size."""
    java.repaired("f(1);")
    tracemalloc.start()
    try:
        had, _, n = java.repaired(code)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (had, n) == found and peak < 10 * len(code)


def test_literals_are_those_of_the_plain_pattern():
    plain = re.compile(r'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+''' + "'", re.DOTALL)
    draw = random.Random(5)
    for text in ("".join(draw.choices("a\"'\\\né", k=n % 14)) for n in range(30_000)):
        for at, c in enumerate(text):
            if c in "\"'":
                found, m = java._TOKEN.match(text, at), plain.match(text, at)
                assert found.group() == (m.group() if m else c), (text, at)


def test_kept_nodes_are_some_of_all():
    """Those kept, and their variables, against the definition applied to all nodes."""
    for code in _texts(300):
        rows = java.nodes(code)
        named = [at for at, row in enumerate(rows) if row[10]]
        meant = {}
        for at in named:
            last = max((b for b in named if b <= at and rows[b][9] == rows[at][9] and rows[b][10] == "declared"), default=-1)
            meant[at] = rows[at][9], last if last >= 0 and at <= rows[last][7] else -1
        order = list(dict.fromkeys(meant.values()))
        sets = {rows[at][1]: order.index(meant[at]) for at in named if rows[at][10] in ("declared", "assigned")}
        some = {"all": range(len(rows)), "inner": [at for at, row in enumerate(rows) if row[2] > at], "variables": named, "uses": [at for at in named if rows[at][10] in ("used", "updated")]}
        for kept, those in some.items():
            out = {x: [] for x in java.FIELDS}
            assert java.add_nodes(code, out, kept) == len(those)
            expected = [(*rows[at], at, None, None) for at in those]
            for i, at in enumerate(those):
                if at in meant:
                    expected[i] = (*rows[at], at, order.index(meant[at]), sets.get(rows[at][8]))
            assert [*zip(*out.values(), strict=True)] == expected


def test_code_bleu_moves_counts_and_not_nodes(spark):
    """A text's nodes are neither shuffled nor sorted: what is shuffled are counts of its edges and shapes."""
    for name in ("codebleu_data_flow", "codebleu_syntax"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 2 and "Window" not in plan
        assert not [x for x in plan.splitlines() if "MapInArrow" in x and ("parent" in x or "last" in x)]


def test_words_of_a_batch_are_bounded():
    rows = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (5, 60_000, 60_000, 200_000)]), pa.array([["b"], None, [], ["c"]])], ["c", "r"])
    assert [x.num_rows for x in metrics._slices(iter([rows, rows.slice(0, 0)]))] == [2, 1, 1]


@pytest.mark.parametrize("name", ["bleu_corpus", "span_corrupt_subwords", "java_comments", "grammar_repair"])
def test_arrow_batches_are_small(spark, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == tasks.BATCH_ROWS


def test_classes_are_dealt_before_they_join(spark):
    plan = queries.QUERIES["class_method_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_rows_of_few_keys_take_little_disk(spark, tmp_path):
    """The joined rows of large keys come in an order that a file keeps small: in any order a pair takes over a byte."""
    size = F.col("id") % 30
    classes = spark.range(9000).select("id", size.alias("version"), F.lit("a.C").alias("modified_class"))
    methods = spark.range(9000).select(F.col("id").alias("method"), size.alias("version"), F.lit("a/C.java").alias("path_focal_class"))
    joins.class_methods(classes, methods).select("id", "method", "focal_name", "version").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300 * 300 * 30
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 0.5 * 300 * 300 * 30


def test_pieces_join_as_rows_do(spark, monkeypatch):
    """Keys of many pieces, by rows and by bytes, against the plain join; no generated code holds a pair's rows."""
    for name, most in (("BLOCK_ROWS", 3), ("BLOCK_BYTES", 200), ("PIECE_ROWS", 6), ("PIECE_BYTES", 400)):
        monkeypatch.setattr(joins, name, most)
    x = F.col("id")
    key = F.when(x % 7 < 6, x % 7 % 3)  # a key of a third, null for a seventh
    left = spark.range(150).select(key.alias("k.1"), F.repeat(F.lit("a"), (x % 90 * 5).cast("int")).alias("row"), F.create_map(F.lit("m"), x % 5).alias("n"), F.when(x % 4 > 0, x % 4).alias("end"))
    right = spark.range(100).select(key.alias("k.1"), (x % 10).alias("block"), F.array(x % 3).alias("key0"))
    done = joins.paired(left, right, "k.1")
    assert done.columns == ["k.1", "row", "n", "end", "block", "key0"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(done) == rows(left.join(right.withColumnRenamed("k.1", "k"), F.col("`k.1`") == F.col("k")).drop("k"))
    steps = [x for x in done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate explode(" in x]
    assert [("transform" in x, "*(" in x) for x in steps] == [(False, True), (True, False), (True, False), (True, False)]
    assert joins.paired(left.limit(0), right, "k.1").count() == 0
    assert joins.paired(left.select("`k.1`"), right.select("`k.1`"), "k.1").count() == done.count()


def test_few_columns_pass_the_windows(spark):
    plan = queries.QUERIES["noise_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    df = spark.createDataFrame([(1, 0, [True]), (1, 1, [True, True]), (1, 2, [True, False]), (1, 3, [False]), (2, 0, [False])], "k int, p int, m array<boolean>")
    assert sorted(map(tuple, masks.runs_of_pieces(df, "k", "p", "m").collect())) == [(1, 0, 4, True), (1, 4, 2, False), (2, 0, 1, False)]


def test_a_chunk_inside_a_row_is_not_grouped(spark):
    df = spark.createDataFrame([(None, 1, ["a"] * 7), (None, 2, ["b"] * 2), (0, 1, ["c"] * 4), (0, 2, None)], "b int, o int, t array<string>")
    done = spans.packed_chunks(df, "b", "o", "t", 3)
    assert sorted((r["b"] is None, r["chunk"], "".join(r["tokens"])) for r in done.collect()) == [(False, 0, "ccc"), (True, 0, "aaa"), (True, 1, "aaa"), (True, 2, "abb")]
    assert "Union" in done._jdf.queryExecution().executedPlan().toString()
