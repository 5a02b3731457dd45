"""The grammar engine against enumeration, the Java grammar on texts with and without errors, and trees as tables."""

import itertools
import random

import pytest

from quarryloom.functions import javagrammar as java
from quarryloom.functions.grammar import Grammar
from quarryloom.operators import trees

SMALL = Grammar("start: item*\nitem: 'x' ';' | '(' item* ')' | 'f' '(' 'x'%, ')' ';' | 'x' '=' 'x' ';'", "start")
RANK = {t: n for n, t in enumerate([";", ")", "(", "x", ",", "=", "f"], 1)}


def fewest(kinds, most=3):
    """Brute force: every insertion of 0, 1, 2 .. tokens."""
    for n in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(kinds) + 1), n):
            for tokens in itertools.product(RANK, repeat=n):
                text, shift = list(kinds), 0
                for at, token in zip(places, tokens, strict=True):
                    text.insert(at + shift, token)
                    shift += 1
                if SMALL.parse(text)[0] is not None:
                    return n
    return None


def test_fewest_insertions_equal_enumeration():
    r = random.Random(3)
    for _ in range(150):
        kinds = [r.choice("xf(),;=") for _ in range(r.randrange(5))]
        found, least = SMALL.mended(kinds, RANK), fewest(kinds)
        if least is None:
            assert found is None or len(found) > 3
            continue
        assert found is not None and len(found) == least, kinds
        text = list(kinds)
        for at, token in reversed(found):
            text.insert(at, token)
        assert SMALL.parse(text)[0] is not None


GOOD = [
    "", "int a;", "int m() { return a.b.c(d).e()[f]; }", "import a.b.*; package x; interface I { void m(); default int k() { return 1; } @interface Z { } }",
    "@Test public void m() throws IOException { Field[] f = Field.get(); List<Map<String, int[]>> x = new ArrayList<>(); assertThat(t.get(0, String.class)).isEqualTo(String.class); }",
    "public <T extends A & B> T[] f(final int a, String... b) { for (int i = 0; i < 10; i++) { if (a < b && c > d) continue; else break; } for (String s : b) x += s; return (int) y + (T) z; }",
    'class A extends B<C> implements D, E { int x = 3, y[] = {1, 2}; A() { super(); } static { x = 1; } enum K { P, Q(1) { }; } @Override public String toString() { return "a" + b; } }',
    "void f() { try (A a = b()) { x = y ? z : w; } catch (E | F e) { throw new R(e); } finally { q(); } switch (x) { case 1: case 2: y(); break; default: z(); } do { i--; } while (i > 0); }",
    'void f() { Runnable r = () -> { g(); }; F h = x -> x + 1; K k = A::b; int z = a >> 2 >>> 3; a[i][j] = new int[3][]; synchronized (this) { assert x : "m"; } l: while (true) { break l; } }',
    "void f() { int[] a = new int[]{1,2,}; Object o = (Object) (b); boolean c = o instanceof String; x = -1 - -y; foo.<T>bar(); this.x = super.y(); char q = '\\n'; double d = 1.5e3; } // end",
    '@A(x = 1, y = {2, 3}) @B("q") void f() { @C final int a = 3; if (x) if (y) a(); else b(); /* c */ }',
]


@pytest.mark.parametrize("code", GOOD)
def test_valid_texts(code):
    assert java.repaired(code) == (False, code, 0) and java.nodes(code)


@pytest.mark.parametrize(("code", "mended", "n"), [
    ("int = 3;", "int identifier = 3;", 1), ("return return;", "return; return;", 1), ("if () x;", "if (identifier) x;", 1), ("void f() { int a = 3 }", "void f() { int a = 3; }", 1),
    ("void f() { if (x) { foo(a, b", "void f() { if (x) { foo(a, b);}}", 4), ("void f() { for (int i = 0; i < 3; i++ { x(); } }", "void f() { for (int i = 0; i < 3; i++) { x(); } }", 1),
    ("void f() { if (a) { b(); } else c() }", "void f() { if (a) { b(); } else c(); }", 1), ('"abc', '"abc', None), ("void f(", "void f();", 2),
])
def test_mended_texts(code, mended, n):
    assert java.repaired(code) == (True, mended, n)
    assert (java.nodes(mended) is None) == (n is None)


def test_unreadable_list_of_five():
    had, mended, n = java.repaired("void f( int a b, ) { x + ; }")
    assert had and n == 5 and java.nodes(mended) is not None


@pytest.mark.parametrize("code", GOOD[3:])
def test_one_token_less_is_mended_by_one(code):
    """Whatever token is lost: the text still parses, or one insertion mends it."""
    found = java.lexed(code)
    for _, start, stop in found[:: max(1, len(found) // 25)]:
        cut = code[:start] + " " + code[stop:]
        had, mended, n = java.repaired(cut)
        if had:
            assert n == 1 or _unmendable(code[start:stop]), (cut, mended, n)


def _unmendable(token: str) -> bool:
    """Tokens that a repair never inserts may cost more than one."""
    return token not in java.INSERTED and not (token.isidentifier() and token not in java.KEYWORDS)


def test_tree_is_preorder_with_ranges_and_texts():
    code = "void m() { if (a) { f(b, 1); } x = y + z; }"
    tree = java.nodes(code)
    for at, (_, parent, last, depth, start, stop, *_rest) in enumerate(tree):
        assert at <= last < len(tree) and start <= stop
        if parent >= 0:
            assert parent < at <= tree[parent][2] and depth == tree[parent][3] + 1 and tree[parent][4] <= start and stop <= tree[parent][5]
    call = next(n for n in tree if n[0] == "call")
    assert code[call[4] : call[5]] == "f(b, 1)"
    assert [(n[9], n[10]) for n in tree if n[9]] == [("m", None), ("a", "used"), ("f", None), ("b", "used"), ("x", "assigned"), ("y", "used"), ("z", "used")]
    assert java.nodes("f(a);")[1][6] == java.nodes(" g( b ) ;")[1][6] != java.nodes("f(1);")[1][6]


def test_trees_in_spark_with_null_empty_and_clashing_columns(spark):
    rows = [(1, "void m() { g(a, h(b)); int i = 0; i++; j = i + k; }", "own"), (2, None, "own"), (3, "", "own"), (4, "if () x", "own"), (4, "if () x", "own")]
    df = spark.createDataFrame(rows, "id long, code string, kind string").withColumnRenamed("kind", "row")
    judged = {(r["id"], r["had_errors"], r["mended"], r["inserted"], r["has_errors"], r["row"]) for r in trees.judged(df, "code").collect()}
    assert judged == {(1, False, rows[0][1], 0, False, "own"), (2, None, None, None, None, "own"), (3, False, "", 0, False, "own"), (4, True, "if (identifier) x;", 2, False, "own")}
    assert trees.judged(df, "code").count() == 5 and trees.judged(df.limit(0), "code").count() == 0
    with pytest.raises(ValueError, match="mended"):
        trees.judged(df.withColumn("mended", df["id"]), "code")
    nodes = trees.node_table(trees.parsed(df, "code"), "id", "code")
    assert {r["id"] for r in nodes.select("id").collect()} == {1, 3}
    calls = trees.descendants(nodes, "call", "call", "id", "code").select(trees.span_text(nodes["code"]).alias("t"))
    assert [r["t"] for r in calls.collect()] == ["h(b)"]
    kids = trees.children(nodes, "arguments", ["identifier"], "id", "code").select("name").collect()
    assert sorted(r["name"] for r in kids) == ["a", "b"]
    flow = sorted((r["relation"], r["target"], r["source"]) for r in trees.data_flow(nodes, "id").collect())
    # a, b come from themselves; i is computed from itself by the update; j from i and k
    assert flow == [("comes", 0, 0), ("comes", 1, 1), ("computed", 2, 2), ("computed", 3, 2), ("computed", 3, 4)]


def test_data_flow_of_random_straight_lines(spark):
    r = random.Random(5)
    texts, expected = [], []
    for i in range(30):
        order, edges, lines = {}, [], []
        for _ in range(r.randrange(1, 9)):
            x, more = r.choice("abcd"), [r.choice("abcd") for _ in range(r.randrange(1, 4))]
            lines.append(f"{x} = {' + '.join(more)};")
            for v in (x, *more):
                order.setdefault(v, len(order))
            edges += [(i, "computed", order[x], order[v]) for v in more]
        texts.append((i, "void m() { " + " ".join(lines) + " }"))
        expected += edges
    nodes = trees.node_table(trees.parsed(spark.createDataFrame(texts, "id long, code string"), "code"), "id")
    assert sorted(map(tuple, trees.data_flow(nodes, "id").collect())) == sorted(expected)


def test_scopes_make_variables_of_their_own(spark):
    codes = [(1, "void m() { for (int i = 0; i < a; i++) { } for (int i = 0; i < a; i++) { } }"), (2, "void m() { for (int i = 0; i < a; i++) { } for (int j = 0; j < a; j++) { } }")]
    nodes = trees.node_table(trees.parsed(spark.createDataFrame(codes, "id long, code string"), "code"), "id")
    flow = {k: sorted((r["relation"], r["target"], r["source"]) for r in trees.data_flow(nodes, "id").collect() if r["id"] == k) for k in (1, 2)}
    assert flow[1] == flow[2] and len(flow[1]) == 6


def test_subtree_match_equals_comparing_texts(spark):
    """Shapes against subtrees written out as nested kinds."""
    r = random.Random(7)
    parts = ["a();", "x = y;", "if (c) d(e);", "return z + 1;", "while (q) { a(); }"]
    codes = [(i, "void m() { " + " ".join(r.choice(parts) for _ in range(r.randrange(6))) + " }") for i in range(20)]

    def written(code):
        tree = java.nodes(code)
        texts = {}
        for at in range(len(tree) - 1, -1, -1):
            texts[at] = "(" + tree[at][0] + "".join(texts[c] for c in range(at + 1, len(tree)) if tree[c][1] == at) + ")"
        return [texts[at] for at in range(len(tree)) if tree[at][2] > at]

    df = trees.parsed(spark.createDataFrame(codes, "id long, code string"), "code")
    shapes = trees.subtrees(trees.node_table(df, "id"), "id")
    pairs = [(i, i + 1) for i in range(0, 20, 2)]
    p = spark.createDataFrame(pairs, "id long, other long")
    cand = shapes.join(p, "id").select("id", "shape")
    ref = shapes.withColumnRenamed("id", "other").join(p, "other").select("id", "shape")
    found = {x["id"]: (x["matched"], x["total"]) for x in trees.clipped(cand, ref, ["id"], ["shape"], ["id"]).collect()}
    for a, b in pairs:
        have, want = written(codes[a][1]), written(codes[b][1])
        assert found[a] == (sum(min(have.count(t), want.count(t)) for t in set(want)), len(want))
