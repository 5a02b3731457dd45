"""Queries over code: errors and repair by grammar, syntax trees as tables, and the parts of CodeBLEU.

The texts are methods made from the tables' rows, so that SQL without a parser knows their trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.operators import metrics, tasks, trees
from quarryloom.plans.queries import JAVA_KEYWORDS, SQL, _against_turn_1, query, table

_TEXT = """replace(replace(translate(coalesce(text, ''), '"\\', ''), chr(10), ' '), chr(13), ' ')"""
#: What a token lost, doubled or astray does to a method, and what mends it: part of the method before, and after the repair.
_PLANTED = [
    ("none", None, None), ("a + 1; if", "a + 1 if", None), ("< b) {", "< b {", None), ("return; }", "return; ", "return;} "), ("{ f(", "{ f ", "{ f( "), ("return; }", "return return; }", "return; return; }"),
    ("int b", "int", "int identifier"), ("return; }", 'return; }"', False),
]


def _planted_sql(mended: bool) -> str:
    whole = "'void m' || doc_id || '(int a) { int b = a + 1; if (a < b) { f(\"' || t || '\", b); } return; }'"
    cases = []
    for k, (old, broken, fixed) in enumerate(_PLANTED[1:], 1):
        new = broken if not mended or fixed is False else old if fixed is None else fixed
        parts = whole.split(old)
        cases.append(f"WHEN doc_id % 8 = {k} THEN {new.join(parts)}" if len(parts) == 2 else "")
    return f"CASE {' '.join(cases)} ELSE {whole} END"


@query(f"""WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents)
SELECT doc_id, doc_id % 8 <> 0 AS had_errors, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 8 < 7 THEN 1 END AS inserted, doc_id % 8 = 7 AS has_errors, md5({_planted_sql(True)}) AS mended_md5 FROM d""")
def grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods around each document with a token lost, doubled or astray, judged and mended with the fewest insertions."""
    clean = F.translate(F.coalesce("text", F.lit("")), '"\\', "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace(clean, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")).alias("t"))
    code = F.expr(_planted_sql(False))
    done = trees.judged(rows.select("doc_id", code.alias("code")), "code")
    return done.select("doc_id", "had_errors", "inserted", "has_errors", F.md5("mended").alias("mended_md5"))


# --- trees ------------------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """A method of p_size % 6 conditions in one another for each part, with its nodes."""
    n = F.pmod("p_size", F.lit(6)).cast("int")
    code = F.concat(F.lit("void m() { "), F.repeat(F.lit("if (a) { "), n), F.lit("f(b);"), F.repeat(F.lit(" }"), n), F.lit(" }"))
    return trees.parsed(tasks.spread(table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))), "code", fields=fields)


#: Nodes of a method of n nested conditions, by kind.
_KINDS = {
    "program": "1", "method": "1", "primitive_type": "1", "parameters": "1", "expression_statement": "1", "call": "1", "arguments": "1", "block": "n + 1",
    "statement": "2 * n + 1", "identifier": "n + 3", "if_statement": "n", "condition": "n",
}


@query(f"""WITH p AS (SELECT p_partkey, p_size % 6 AS n FROM part), k AS ({" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, {v} AS n_nodes FROM p" for k, v in _KINDS.items())})
SELECT p_partkey, kind, CAST(n_nodes AS BIGINT) AS n_nodes FROM k WHERE n_nodes > 0""")
def syntax_tree_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.node_table(_nested(spark, sf_dir, "kind"), "p_partkey").groupBy("p_partkey", "kind").agg(F.count("*").alias("n_nodes"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_size % 6 AS n FROM part), node AS (SELECT p_partkey, n, 1 AS i FROM p WHERE n > 0 UNION ALL SELECT p_partkey, n, i + 1 FROM node WHERE i < n),
below AS (SELECT p_partkey, i AS above, i FROM node UNION ALL SELECT b.p_partkey, above, node.i FROM below b JOIN node ON node.p_partkey = b.p_partkey AND node.i = b.i + 1),
c AS (SELECT p_partkey, above, count(*) - 1 AS n_below FROM below GROUP BY ALL)
SELECT p_partkey, CAST(11 + 9 * (above - 1) AS INTEGER) AS start, n_below, CAST(1 AS BIGINT) AS n_calls, repeat('if (a) { ', n_below + 1) || 'f(b);' || repeat(' }', n_below + 1) AS span FROM c""")
def syntax_tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each condition: its text, and how many conditions and calls lie below it."""
    kinds = {"n_below": "if_statement", "n_calls": "call"}
    rows = _nested(spark, sf_dir, "kind", "last", "start", "stop")
    rows = rows.select("p_partkey", "code", "nodes", *[trees.places(F.col("nodes"), k).alias(name) for name, k in kinds.items()])
    each = trees.of_kind(rows.select("*", F.posexplode("nodes").alias("node", "x")).select("*", "x.*"), "if_statement")
    counts = [trees.below(F.col(name), F.col("node"), F.col("last")).alias(name) for name in kinds]
    return each.select("p_partkey", "start", *counts, trees.span_text(F.col("code")).alias("span"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS w FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS place, 'v' || i || '_' || w[i] AS argument FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w)""")
def syntax_tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of a call as children of one kind, with their texts and places."""
    words = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    named = F.transform(words, lambda w, i: F.concat(F.lit("v"), (i + 1).cast("string"), F.lit("_"), w))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("int m() { return g("), F.array_join(named, " , "), F.lit("); }")).alias("code"))
    rows = trees.parsed(tasks.spread(rows), "code", fields=("kind", "parent", "start", "stop"))
    found = rows.select("p_partkey", "code", F.posexplode(trees.children_of(F.col("nodes"), "arguments", ["identifier"])).alias("place", "x"))
    return found.select("p_partkey", "code", (F.col("place") + 1).alias("place"), "x.*").select("p_partkey", "place", trees.span_text(F.col("code")).alias("argument"))


# --- CodeBLEU ---------------------------------------------------------------------------

#: A word's statement by its length, and how many subtrees it has.
_STATEMENTS = (("a(b);", 4), ("x = y + z;", 4), ("if (c) d();", 6))
_PAIRED = r"""p AS (SELECT a.conv_id, a.turn AS position, list_transform(string_split_regex(coalesce(a.text, ''), '\s+'), lambda w: length(w)) AS c, list_transform(coalesce(string_split_regex(b.text, '\s+'), []), lambda w: length(w)) AS r
 FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn <> 1)"""


def _matches(spark: SparkSession, sf_dir: str, statement, items, names: list[str], fields: tuple[str, ...], kept: str) -> DataFrame:
    """Matched items, named by names, of the trees: each word of a turn is a statement. A reference is parsed, and its items are counted, once for all its candidates."""

    def code(words: Column) -> Column:
        return F.concat(F.lit("void m() { "), F.array_join(F.transform(F.coalesce(words, F.array().cast("array<string>")), statement), " "), F.lit(" }"))

    def nodes(rows: DataFrame, *keys: str) -> DataFrame:
        return items(trees.node_table(trees.parsed(tasks.spread(rows), "code", fields=fields, kept=kept), *keys), *keys)

    pairs = _against_turn_1(spark, sf_dir).select("conv_id", "position", F.coalesce("c", F.array(F.lit(""))).alias("c"), "r")
    found = nodes(pairs.select("conv_id", code(F.col("r")).alias("code")).distinct(), "conv_id").groupBy("conv_id", *names).agg(F.count("*").alias("times"))
    references = found.join(pairs.select("conv_id", "position"), "conv_id")
    return trees.clipped(nodes(pairs.select("conv_id", "position", code(F.col("c")).alias("code")), "conv_id", "position"), references, ["conv_id", "position"], names, ["position"], "times")


def _by_length(w: Column, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s, _ in _STATEMENTS]), (F.pmod(F.length(w), F.lit(3)) + 1).cast("int"))


def _syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, _by_length, trees.subtrees, ["shape"], ("shape",), "inner")


_SYNTAX = rf"""WITH {_PAIRED}, n AS (SELECT position, c, r, {", ".join(f"len(list_filter({s}, lambda w: w % 3 = {k})) AS {s}{k}" for s in "cr" for k in range(3))}, list_transform(c, lambda w: w % 3) = list_transform(r, lambda w: w % 3) AS same FROM p)
SELECT position, CAST(sum({" + ".join(f"{n} * least(c{k}, r{k})" for k, (_, n) in enumerate(_STATEMENTS))} + CASE WHEN NOT same THEN 0 WHEN len(r) = 0 THEN 2 ELSE 3 END) AS BIGINT) AS matched,
 CAST(sum({" + ".join(f"{n} * r{k}" for k, (_, n) in enumerate(_STATEMENTS))} + CASE WHEN len(r) = 0 THEN 2 ELSE 3 END) AS BIGINT) AS total FROM n GROUP BY position"""


@query(_SYNTAX)
def codebleu_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees of the references that the candidates at each position have too."""
    return _syntax(spark, sf_dir)


def _assigned(w: Column, i: Column) -> Column:
    n = F.length(w)
    return F.concat(F.lit("v"), F.pmod(n, F.lit(7)).cast("string"), F.lit(" = v"), F.pmod(n * 3 + i, F.lit(7)).cast("string"), F.lit(";"))


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, _assigned, trees.data_flow, ["relation", "target", "source"], ("role", "variable", "target"), "uses")


_FLOW = rf"""WITH {_PAIRED}, s AS (SELECT conv_id, position, side, unnest(w) AS n, generate_subscripts(w, 1) - 1 AS i FROM (SELECT conv_id, position, 'c' AS side, c AS w FROM p UNION ALL SELECT conv_id, position, 'r', r FROM p)),
e AS (SELECT *, n % 7 AS t, (n * 3 + i) % 7 AS f FROM s), o AS (SELECT conv_id, position, side, t AS v, 2 * i AS place FROM e UNION ALL SELECT conv_id, position, side, f, 2 * i + 1 FROM e),
g AS (SELECT conv_id, position, side, v, min(place) AS place FROM o GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, position, side ORDER BY place) AS number FROM g),
x AS (SELECT e.conv_id, e.position, e.side, a.number AS target, b.number AS source FROM e JOIN v a ON (a.conv_id, a.position, a.side, a.v) = (e.conv_id, e.position, e.side, e.t) JOIN v b ON (b.conv_id, b.position, b.side, b.v) = (e.conv_id, e.position, e.side, e.f)),
k AS (SELECT conv_id, position, target, source, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 'r') AS r FROM x GROUP BY ALL)
SELECT position, CAST(sum(least(c, r)) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS total FROM k WHERE r > 0 GROUP BY position"""


@query(_FLOW)
def codebleu_data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow edges of the references that the candidates at each position have too."""
    return _flow(spark, sf_dir)


#: The score of weighted n-grams, from the SQL of the plain ones and that of the weighted precisions.
_ALL = f"""WITH b AS ({SQL["bleu_corpus"]}), w AS ({SQL["weighted_ngrams"]}), y AS ({_SYNTAX}), f AS ({_FLOW}),
z AS ({SQL["bleu_corpus"].replace("SELECT position, round(CASE", "SELECT position, nc, nr, round(CASE")}),
s AS (SELECT w.position, CASE WHEN least(w.p1, w.p2, w.p3, w.p4) > 0 THEN (CASE WHEN nc >= nr THEN 1 ELSE exp(1 - nr / nc) END) * exp((ln(nullif(w.p1, 0)) + ln(nullif(w.p2, 0)) + ln(nullif(w.p3, 0)) + ln(nullif(w.p4, 0))) / 4) ELSE 0 END AS weighted FROM w JOIN z USING (position))
SELECT b.position, round(b.bleu, 6)::DOUBLE AS bleu, round(weighted, 6)::DOUBLE AS weighted_bleu, round(coalesce(y.matched / y.total, 0), 6)::DOUBLE AS syntax, round(coalesce(f.matched / f.total, 0), 6)::DOUBLE AS data_flow,
 round((b.bleu + weighted + coalesce(y.matched / y.total, 0) + coalesce(f.matched / f.total, 0)) / 4, 6)::DOUBLE AS codebleu FROM b JOIN s USING (position) LEFT JOIN y USING (position) LEFT JOIN f USING (position)"""


@query(_ALL)
def codebleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four parts and their mean, for every candidate position."""
    pairs = _against_turn_1(spark, sf_dir)
    plain, weighted = (metrics.corpus_bleu(pairs, "c", "r", weights, by=("position",)) for weights in (None, dict.fromkeys(JAVA_KEYWORDS, 1.0)))
    rows = metrics.code_bleu(plain, weighted, _syntax(spark, sf_dir), _flow(spark, sf_dir), "position")
    return rows.select("position", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])
