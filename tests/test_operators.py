import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryloom.operators import candidates, columns, joins, metrics, order, outcomes, spans, templates


def test_first_valid(spark):
    rows = [(1, 0, "bad"), (1, 1, "fixme"), (1, 2, "good"), (2, 0, "bad"), (2, 1, "bad2"), (3, 0, None), (3, 1, "good")]
    df = spark.createDataFrame(rows, "k long, pos int, code string")
    df = candidates.judged(df, F.col("code").startswith("good"), F.upper("code"), F.col("code") == "fixme")
    got = {r["k"]: (r["chosen_pos"], r["chosen"], r["used_repair"], r["fell_back"]) for r in candidates.first_valid(df, "k", "pos", "code").collect()}
    assert got == {1: (1, "FIXME", True, False), 2: (0, "bad", False, True), 3: (1, "good", False, False)}
    chosen = candidates.first_valid(df, "k", "pos", "code")
    assert [tuple(r) for r in candidates.position_histogram(chosen, 3).orderBy("pos").collect()] == [(0, 0, 0), (1, 1, 1), (2, 0, 0)]
    assert tuple(candidates.all_failed(chosen).first()) == (3, 1)
    assert [r["n_valid"] for r in candidates.validity_by_position(df, "pos", 3).orderBy("pos").collect()] == [0, 1, 1]


def test_pivot_and_strides(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (2, 1, "c")], "k long, pos int, code string")
    wide = candidates.pivoted(df, "k", "pos", "code", 2)
    assert sorted(map(tuple, wide.collect())) == [(1, 2, "a", ""), (2, 2, None, "c")]
    assert sorted(map(tuple, candidates.unpivoted(wide, "k", 2).collect())) == [(1, 0, "a"), (2, 1, "c")]
    row = spark.range(1).select(F.sequence(F.lit(0), F.lit(14)).alias("f")).select(*candidates.strided(F.col("f"), 3)).first()
    assert list(row) == [[0, 3, 6, 9, 12], [1, 4, 7, 10, 13], [2, 5, 8, 11, 14]]


def test_exact_splits_and_batches(spark):
    for n in (1, 7, 10, 1003):
        counts = {r["split"]: r["count"] for r in order.train_valid_test(spark.range(n), "id").groupBy("split").count().collect()}
        held = -(-n // 5)
        assert counts.get("train", 0) == n - held and counts.get("test", 0) == -(-held // 2)
    rows = spark.range(0, 400, 3)
    assert {r["batch_id"]: r["count"] for r in order.batches(rows, "id", 20).groupBy("batch_id").count().collect()} == dict.fromkeys(range(6), 20)
    sizes = [r["count"] for r in order.batches(rows, "id", 20, drop_last=False).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [20] + [19] * 6
    assert order.batches(rows.limit(0), "id", 20).count() == 0
    first, second = ([r["id"] for r in order.shuffled(spark.range(50).repartition(k), "id").orderBy("rank").collect()] for k in (1, 5))
    assert first == second != sorted(first)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(2, 80), min_size=1, max_size=4), st.integers(0, 9), st.booleans())
def test_span_corruption_restores(spark, sizes, seed, dynamic):
    rows = [(i, [f"t{k}" for k in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for r in spans.corrupt(df, "id", "tokens", 100, seed=seed, dynamic=dynamic).collect():
        n = len(r["tokens"])
        noise = min(max(round(n * 0.15), 1), n - 1)
        count = max(1, round((min(noise, n - noise) if dynamic else noise) / 3.0))
        assert (r["n"], r["n_noise"], r["n_spans"]) == (n, noise, min(count, noise, n - noise))
        assert r["inputs"][-1] == r["labels"][-1] == spans.EOS and r["inputs"][0] == "t0" and r["labels"][0] == "<99>"
        lost, key = {}, None
        for t in r["labels"][:-1]:
            if t.startswith("<"):
                key, lost[t] = t, []
            else:
                lost[key].append(t)
        assert all(lost.values()) and len(lost) == r["n_spans"]
        assert [x for t in r["inputs"][:-1] for x in lost.get(t, [t])] == r["tokens"]


def test_batches_keep_null_keys_and_outliers(spark):
    rows = spark.createDataFrame([(None,), (5,), (None,), (1,)], "id long")
    got = order.batches(rows, "id", 2)
    assert sorted((r["batch_id"], r["id"] is None) for r in got.collect()) == [(0, True), (0, True), (1, False), (1, False)]
    spread = spark.range(3000).selectExpr("case when id = 7 then 1000000000000000 else id end as id")
    got = {r["id"]: r["batch_id"] for r in order.batches(spread, "id", 100).collect()}
    assert got == {x: k // 100 for k, x in enumerate(sorted(got))} and len(got) == 3000
    same = spark.range(50).selectExpr("3 as id")
    assert order.batches(same, "id", 10).groupBy("batch_id").count().where("count = 10").count() == 5


def test_no_column_of_the_caller_is_lost(spark):
    own = [f"'own' AS `{c}`" for c in ("rank", "digest", "bucket", "key", "key0", "start", "inside", "row", "z", "k", "ids", "a.b")]
    df = spark.range(20).selectExpr("id", *own)
    for got, new in ((order.train_valid_test(df, "id"), "split"), (order.batches(df, "id", 5), "batch_id"), (order.ranked(df.drop("rank"), "id"), "rank")):
        assert got.columns[-1] == new and got.count() == 20
        assert all(r[c] == "own" for r in got.collect() for c in got.columns[1:-1])
    tokens = df.withColumn("tokens", F.array(*[F.lit(str(i)) for i in range(9)]))
    got = spans.corrupt(tokens, "id", "tokens", 100).collect()
    assert len(got) == 20 and all(r["rank"] == r["z"] == r["ids"] == r["a.b"] == "own" for r in got)
    for bad in (lambda: spans.corrupt(tokens.withColumn("n", F.lit(1)), "id", "tokens", 100), lambda: order.shuffled(df, "id"), lambda: order.batches(df.withColumn("batch_id", F.lit(1)), "id", 5)):
        with pytest.raises(ValueError, match="columns of the new names"):
            bad()


def test_columns_are_chosen_by_name(spark):
    assert columns.chosen(spark.range(1).selectExpr("id", "1 AS `a.b`", "2 AS c"), "a.b", "id").columns == ["a.b", "id"]
    with pytest.raises(ValueError, match="no column x among id"):
        columns.chosen(spark.range(1), "x")


@pytest.mark.parametrize("density", [0.0, 0.1, 0.15, 0.5, 0.7])
def test_raw_lengths_are_the_greatest_that_fit(density):
    for limit in range(2, 300):
        fit = [n for n in range(limit, 12 * limit) if n == limit or spans.corrupted_lengths(n, density, 3.0)[0] <= limit]
        raw = fit[-1]
        inputs, labels = spans.corrupted_lengths(raw, density, 3.0)
        less = density == 0.5 and labels > inputs
        assert spans.raw_and_target_lengths(limit, density, 3.0) == (raw - less, labels - less)


def test_length_guard_and_detokenized(spark):
    df = spark.createDataFrame([(1, ["a"] * 4, ["b"] * 2)], "id long, inputs array<string>, labels array<string>")
    for length, labels, fits in ((4, None, True), (5, None, True), (3, None, False), (4, 2, True), (5, 2, False), (4, 3, False)):
        assert df.select(spans.lengths_fit(F.col("inputs"), F.col("labels"), length, labels)).first()[0] is fits
        if fits:
            assert spans.guarded(df, "inputs", "labels", length, labels).count() == 1
        else:
            with pytest.raises(Exception, match="should have"):
                spans.guarded(df, "inputs", "labels", length, labels).collect()
    ids = spark.createDataFrame([([3, 4, 5, 1, 0, 0],), ([],), (None,)], "ids array<int>")
    pieces = ["<pad>", "</s>", "<s>", "\u2581void", "\u2581te", "st"]
    assert [r["text"] for r in spans.detokenized(ids, "ids", pieces).collect()] == ["void test</s>", "", None]
    assert [r["text"] for r in spans.detokenized(ids, "ids", pieces, (0, 1, 2), skip_special=True).collect()] == ["void test", "", None]


def test_chosen_candidates_are_edited(spark):
    df = spark.createDataFrame([(1, 0, "ok"), (2, 0, "bad")], "k long, pos int, code string")
    chosen = candidates.first_valid(candidates.judged(df, F.col("code") == "ok", F.col("code"), F.lit(False)), "k", "pos", "code")
    assert sorted(r["chosen"] for r in candidates.edited(chosen, F.upper).collect()) == ["OK", "bad"]
    assert sorted(r["chosen"] for r in candidates.edited(chosen, None).collect()) == ["bad", "ok"]


def test_predictions_by_position(spark):
    inputs = spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, src string")
    flat = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "line_no long, code string")
    assert sorted((r["src"], r["cand_pos"], r["code"]) for r in joins.by_position(inputs, flat, 2).collect()) == [("a", 0, "p0"), ("a", 1, "p1"), ("b", 0, "p2"), ("b", 1, "p3")]
    with pytest.raises(ValueError):
        joins.by_position(inputs, flat, 3)
    listing = spark.createDataFrame([(0, "x.tar.bz2")], "line_no long, name string")
    assert joins.with_archive(inputs.where("line_no = 0"), listing, "line_no").first()["name"] == "x.tar.bz2"
    with pytest.raises(Exception, match="no archive for 1"):
        joins.with_archive(inputs, listing, "line_no").collect()


def test_lengths_and_shaping(spark):
    assert spans.raw_and_target_lengths(512, 0.15, 3.0) == (568, 114)
    assert spans.raw_and_target_lengths(8, 0.5, 3.0)[0] >= 8
    df = spark.createDataFrame([(1, [5, 6, 7]), (1, [8])], "b long, ids array<int>")
    rows = spans.batch_width(df, "b", "ids").select("width", spans.shifted_right(F.col("ids"), 0, 0).alias("s"), spans.attention_mask(F.col("ids"), F.col("width")).alias("m"), spans.padded(F.col("ids"), F.col("width"), -100).alias("p")).collect()
    assert sorted((r["width"], r["s"], r["m"], r["p"]) for r in rows) == [(3, [0], [1, 0, 0], [8, -100, -100]), (3, [0, 5, 6], [1, 1, 1], [5, 6, 7])]
    packed = spark.createDataFrame([(0, 1, ["a"] * 3), (0, 2, ["b"] * 4), (1, 1, ["c"]), (2, 1, [])], "b long, o long, t array<string>")
    assert sorted((r["b"], r["chunk"], "".join(r["tokens"])) for r in spans.packed_chunks(packed, "b", "o", "t", 3).collect()) == [(0, 0, "aaa"), (0, 1, "bbb"), (1, 0, "c")]


def test_funnels_and_coverage(spark):
    rows = [("p", m, s, *[r > i for i in range(5)]) for m, s, r in [(1, 0, 0), (1, 1, 5), (1, 2, 4), (2, 0, 4), (2, 1, 5), (3, 0, 0), (3, 1, 2), (4, 0, 0)]]
    df = spark.createDataFrame(rows, "project string, m int, sid int, " + ", ".join(f"{c} boolean" for c in outcomes.STAGES))
    one = outcomes.single_funnel(df, ["project"]).first()
    assert [one[f"n_{k}"] for k in ("syntax_error", "compile_error", "execute_error", "failing_tests", "passing_tests", "correct_tests")] == [3, 0, 1, 0, 4, 2]
    assert one["rate_syntax_error"] == 37.5
    any_ = outcomes.any_of_k(df, ["project"], ["m"], "sid").first()
    assert [any_[f"n_{k}"] for k in ("syntax_error", "compile_error", "execute_error", "failing_tests", "passing_tests", "correct_tests")] == [1, 1, 2, 2, 2, 1]
    lines = spark.createDataFrame([(0, 0, 0, 0), (4, 1, 0, 0), (4, 3, 2, 1)], "lines_total int, lines_covered int, branches_total int, branches_covered int")
    assert [(r["line_rate"], r["branch_rate"]) for r in outcomes.coverage(lines).orderBy("lines_covered").collect()] == [(None, 0.0), (25.0, 0.0), (75.0, 50.0)]


def test_templates(spark):
    def edit(expr, lines):
        return spark.createDataFrame([(lines,)], "lines array<string>").select(expr).first()[0]

    wanted = F.array(F.lit("import b;"), F.lit("import a;"))
    add = lambda lines: edit(templates.with_imports(F.col("lines"), wanted, F.lit("package q;")), lines)
    assert add(["// x", "package p;", "import a;", "class C"]) == ["// x", "package p;", "", "import b;", "import a;", "class C"]
    assert add(["// x", "import a;", "class C"]) == ["package q;", "", "import b;", "", "// x", "import a;", "class C"]
    assert add(["import a;", "import b;"]) == ["package q;", "", "import a;", "import b;"]
    assert add(["package p;", "import a;", "import b;"]) == ["package p;", "import a;", "import b;"]
    cut = edit(templates.truncated(F.col("lines"), F.lit("C$1")), ["import a;", "public class C$1 {", "void old() {}", "}"])
    assert cut == ["import a;", "public class C$1 {", "", "    // Test Method generated", "", "}"]
    done = edit(templates.inject(F.col("lines"), F.lit("id7"), F.lit("void m() { $1 }")), ["a // Test Method generated b // Test Method generated", "c"])
    assert done[0].startswith("a @Rule\n    public Timeout globalTimeout = new Timeout(10000);\n\n    // Starting generated-test id7\n    void m() { $1 }\n    // Ending")
    assert done[0].endswith(" b // Test Method generated") and done[1] == "c"


def test_joins(spark):
    classes = spark.createDataFrame([(1, "a.b.C"), (1, "x.$D$E"), (2, "a.b.C")], "version int, modified_class string")
    methods = spark.createDataFrame([(1, "s/a/b/C.java", 0), (1, "s/$D$E.java", 1), (3, "C.java", 2)], "version int, path_focal_class string, n int")
    assert sorted((r["modified_class"], r["n"]) for r in joins.class_methods(classes, methods).collect()) == [("a.b.C", 0), ("x.$D$E", 1)]
    lines = joins.numbered_lines(spark.createDataFrame([(1, "x\nvoid a\ny\nvoid b\nz")], "id int, code string"), "id", "code")
    name = F.when(F.col("line").startswith("void"), F.substring_index("line", " ", -1))
    assert [r["enclosing"] for r in joins.enclosing(lines, "id", name).orderBy("line_no").collect()] == [None, "a", "a", "b", "b"]
    with pytest.raises(ValueError):
        joins.same_place(lines, lines.limit(2))


def test_bleu(spark):
    pairs = lambda *rows: spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(rows)], "k long, c array<string>, r array<string>")
    same = metrics.corpus_bleu(pairs(("a b c d e", "a b c d e")), "c", "r").first()
    assert same["bleu"] == pytest.approx(1) and same["length_ratio"] == 1
    clipped = metrics.corpus_bleu(pairs(("the the the the the the the", "the cat is on the mat")), "c", "r").first()
    assert clipped["p1"] == pytest.approx(2 / 7) and clipped["bleu"] == 0
    assert metrics.corpus_bleu(pairs(("a", "a")).limit(0), "c", "r").first()["bleu"] == 0
