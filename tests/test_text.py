import pytest
from pyspark.sql import functions as F

from quarryloom.functions import javasrc, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("out")).first()[0]


@pytest.mark.parametrize(("code", "want"), [
    ("a . b ( c , d ) ;", "a.b(c, d);"), ("if ( x ) { y ( ) ; }", "if (x) { y(); }"), ("i ++ ; List < ? > l", "i++; List<?> l"), ("x = ( a ) ( b )", "x = (a) (b)"), ("", ""),
])
def test_format_code(spark, code, want):
    assert one(spark, text.format_code(F.col("c")), c=code) == want


@pytest.mark.parametrize(("code", "want"), [("a(b[c]{d})", True), ("(]", False), ("((", False), (")", False), ("", True), ("([)]", False), ("{}[]()", True)])
def test_brackets(spark, code, want):
    assert one(spark, text.is_balanced(F.col("c")), c=code) is want


@pytest.mark.parametrize(("line", "want"), [
    ("public void foo() { a(); }", "@Test public void testfoo() { a(); }"),
    ("@Test public void testA() { a(); }", "@Test public void testA() { a(); }"),
    ("@Test void foo() { a(); b(", "@Test void testfoo() { a(); }"),
    ("void foo() { a(", "void foo() { a("),
    ("void", "@Test void"),
    ("a  b", "@Test a  b"),
    ("", "@Test "),
])
def test_postprocess(spark, line, want):
    assert one(spark, text.postprocess_test(F.col("c")), c=line) == want


def test_names_and_sizes(spark):
    assert one(spark, text.simple_name(F.col("c")), c="com.google.gson.internal.$Gson$Types") == "$Gson$Types"
    assert one(spark, text.simple_name(F.col("c")), c="Alone") == "Alone"
    assert one(spark, text.source_path(F.col("c")), c="a.b.C") == "a/b/C.java"
    assert one(spark, text.base_name(F.col("c")), c="x/y/Foo.test.java") == "Foo"
    assert one(spark, text.version_digits(F.col("c")), c="12f") == "12"
    assert one(spark, text.split_imports(F.col("c")), c="import a;||import b;|") == ["import a;", "import b;"]
    assert one(spark, text.prefixed_test_name(F.col("c")), c="toString") == "testToString"
    assert one(spark, text.prefixed_test_name(F.col("c")), c="testX") == "testX"
    assert one(spark, text.fill_placeholder(F.col("c"), F.lit(" \tassertTrue($1)\n")), c='x "<AssertPlaceHolder>" y "<AssertPlaceHolder>"') == "x assertTrue($1) y assertTrue($1)"
    assert [one(spark, text.human_count(F.col("n")), n=n) for n in (999_000, 2_500_000, 3_000_000_000)] == ["999.00 K", "2.50 M", "3.00 B"]
    assert [one(spark, text.human_bytes(F.col("n")), n=n) for n in (500, 1_000_000, 2_000_000_000)] == ["0.50 KB", "1.00 MB", "2.00 GB"]
    assert [one(spark, text.seconds_text(F.col("n")), n=n) for n in (3661.259, 90_061.5, 180_000.0)] == ["1:01:01.25", "1 day, 1:01:01.50", "2 days, 2:00:00.00"]
    assert [one(spark, text.elapsed(F.col("n"), days=False), n=n) for n in (90_061.0, 61.0, 123 * 3600 + 61.0)] == ["25:01:01", "00:01:01", "123:01:01"]
    assert [one(spark, text.parsed_boolean(F.col("c")), c=c) for c in ("Yes", "on", "1", "T", "no", "OFF", "0")] == [True] * 4 + [False] * 3
    with pytest.raises(Exception, match="not a boolean: maybe"):
        one(spark, text.parsed_boolean(F.col("c")), c="maybe")
    assert tuple(spark.range(1).select(*text.method_id_parts(F.lit("P_1f_2_C_d"))).first()) == ("P", "1f", "2", "C")
    assert one(spark, text.longest_first(F.col("a")), a=["bb", "a", "cc", "ddd"]) == ["ddd", "cc", "bb", "a"]
    assert one(spark, text.missing_imports(F.col("a"), F.array(F.lit("x"))), a=["y", "x", "y"]) == ["y", "y"]


def test_java_checks_and_repair():
    good = '@Test public void a() { String s = "}{ // no"; /* ( */ call(s); } // end ('
    assert not javasrc.has_errors(good) and javasrc.repaired(good) == (False, good)
    assert javasrc.repaired("void a() { f(1)") == (True, "void a() { f(1);}")
    assert not javasrc.has_errors(javasrc.repaired("void a() { f(g(1 }")[1])
    assert javasrc.repaired("void a() { x(); ") == (True, "void a() { x();} ")
    assert javasrc.repaired("void a() { f(1) }")[1] == "void a() { f(1); }"
    for broken in ("void a() }", 'void a() { "open }', "a(]"):
        assert javasrc.has_errors(broken) and javasrc.repaired(broken) == (True, broken)
    assert javasrc.repaired("") == (False, "")


def test_java_names_and_comments():
    assert javasrc.adapted("@Before public static <T> void toString() { }") == "@Test public void testToString() { }"
    assert javasrc.adapted("public Map<String, int[]> get(int a) { }") == "@Test public Map<String, int[]> testGet(int a) { }"
    assert javasrc.adapted("@Test void testIt() throws E { }") == "@Test public void testIt() throws E { }"
    assert javasrc.adapted("int x;") == "int x;"
    assert javasrc.without_comments('a /* b */ c "// d" // e\nf') == 'a   c "// d"  \nf'
    assert javasrc.without_comments("x // another comment // one comment\ny // one comment") == "x  \ny  "
    assert javasrc.without_annotations("@Test(expected = A.class) @Foo public void b() { }") == "    public void b() { }"
    assert javasrc.method_name("@Test public void testIt() { }") == "testIt" and javasrc.method_name("x = 1") is None


def test_java_functions_as_columns(spark):
    df = spark.createDataFrame([("void a() { f(1)",), (None,)], "c string")
    rows = df.select(javasrc.code_has_errors("c").alias("e"), javasrc.repair("c").alias("r"), javasrc.clean_comments("c").alias("k")).collect()
    assert [r["e"] for r in rows] == [True, None]
    assert rows[0]["r"]["code"] == "void a() { f(1);}" and rows[1]["r"]["code"] is None
    both = df.select(javasrc.mended("c").alias("m")).select("m.*").collect()
    assert tuple(both[0]) == (True, "void a() { f(1);}", False, "a", "@Test public void testA() { f(1);}", "void a() { f(1);}") and tuple(both[1]) == (None,) * 6
