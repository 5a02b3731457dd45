"""Syntax trees as a table: a row for each node, numbered in preorder, so that "below" is a range of numbers.

The trees come from one pass over the texts; kinds, children, descendants, subtree and
data-flow matches are joins and aggregations over their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryloom.functions import javagrammar
from quarryloom.operators import tasks
from quarryloom.operators.columns import as_row, column, from_row

NODE = "kind string, parent int, last int, depth int, start int, stop int, shape bigint, ends int, setter int, name string, role string, node int, variable int, target int"
_ARROW = pa.list_(pa.struct([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[c.split()[1]]) for c in NODE.split(", ")]))
FIELDS = tuple(x for x in javagrammar.FIELDS if x != "node")
#: New columns of judged.
JUDGED = ("had_errors", "mended", "inserted", "has_errors")
#: Texts of one Arrow batch that are parsed before their trees are sent on.
HELD = 64


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(None,) * 4 if code is None else _verdict(code) for code in batch.column("code").to_pylist()]
        columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.bool_(), pa.string(), pa.int32(), pa.bool_()), strict=True)] if found else []
        if found:
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *JUDGED])


def _verdict(code: str) -> tuple:
    had, mended, n = javagrammar.repaired(code)
    return had, mended, n, n is None


def judged(df: DataFrame, code: str) -> DataFrame:
    """df with had_errors, mended, inserted and has_errors by the grammar.

    mended: the text with the fewest tokens inserted that make it parse, the text itself
    where none are needed or insertions don't help; inserted: how many, then 0 or null;
    has_errors: whether mended still has errors. A null text has nulls, an empty one no errors.
    """
    tasks.small_batches(df.sparkSession)
    rows = df.select(as_row(df, *JUDGED), column(code).alias("code"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("had_errors boolean, mended string, inserted int, has_errors boolean")])
    return rows.mapInArrow(_judge, schema).select(*from_row(df.columns), *JUDGED)


def _parse(fields: tuple[str, ...], kept: str):
    types = [_ARROW.value_type.field(_ARROW.value_type.get_field_index(x)) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                part = batch.slice(a, HELD)
                found: dict[str, list] = {x: [] for x in fields}
                sizes = [None if code is None else javagrammar.add_nodes(code, found, kept) for code in part.column("code").to_pylist()]
                values = pa.StructArray.from_arrays([pa.array(found[t.name], t.type) for t in types], fields=types)
                ends = [0, *accumulate(n or 0 for n in sizes)]
                starts = [None if n is None else e for n, e in zip(sizes, ends, strict=False)]  # a null start is a null list
                nodes = pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("row"), nodes], ["row", "nodes"])

    return run


def parsed(df: DataFrame, code: str, name: str = "nodes", fields: tuple[str, ...] = FIELDS, kept: str = "all") -> DataFrame:
    """df with the nodes of each text's tree in preorder, as an array; null for a null text and for one with errors.

    fields: those of a node that are needed; fewer are cheaper. kept: "all" nodes, those with others below ("inner"), the identifiers that stand for
    "variables" or those of them that are "uses"; of some alone the field "node" has the number among all.
    """
    tasks.small_batches(df.sparkSession)
    rows = df.select(as_row(df, name), column(code).alias("code"))
    types = dict(c.split() for c in NODE.split(", "))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(f"nodes array<struct<{','.join(f'{x}:{types[x]}' for x in fields)}>>")])
    return rows.mapInArrow(_parse(fields, kept), schema).select(*from_row(df.columns), F.col("nodes").alias(name))


def node_table(df: DataFrame, *keys: str, nodes: str = "nodes") -> DataFrame:
    """(keys, node, kind, parent, last, depth, start, stop, shape, ends, setter, name, role, variable, target), or those that were parsed: a row for each node, the root with number 0."""
    numbered = "node" in df.schema[nodes].dataType.elementType.names
    each = F.explode(column(nodes)).alias("_x") if numbered else F.posexplode(column(nodes)).alias("node", "_x")
    return df.select(*map(column, keys), each).select(*map(column, keys), *[] if numbered else ["node"], "_x.*")


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """The nodes of a kind."""
    return nodes.where(F.col("kind") == kind)


def descendants(nodes: DataFrame, above: str, kind: str, *keys: str) -> DataFrame:
    """Nodes of a kind with ``above``, the number of each node of the kind above that they lie under."""
    over = of_kind(nodes, above).select(*keys, F.col("node").alias("above"), F.col("last").alias("_last"))
    return of_kind(nodes, kind).join(over, list(keys)).where("node > above and node <= _last").drop("_last")


def children(nodes: DataFrame, above: str, kinds: list[str], *keys: str) -> DataFrame:
    """Nodes of some kinds right under nodes of the kind above."""
    over = of_kind(nodes, above).select(*keys, F.col("node").alias("parent"))
    return nodes.where(F.col("kind").isin(kinds)).join(over, [*keys, "parent"], "left_semi")


def places(nodes: Column, kind: str) -> Column:
    """The numbers of the nodes of a kind in the array of a text's nodes, rising."""
    return F.filter(F.transform(nodes, lambda x, i: F.when(x["kind"] == kind, i)), lambda i: i.isNotNull())


def below(places_: Column, node: Column, last: Column) -> Column:
    """How many of the places are under a node."""
    return F.size(F.filter(places_, lambda i: (i > node) & (i <= last))).cast("long")


def children_of(nodes: Column, above: str, kinds: list[str]) -> Column:
    """Of the array of a text's nodes those of some kinds right under nodes of the kind above, in order."""
    return F.filter(nodes, lambda x: x["kind"].isin(kinds) & (F.get(nodes, x["parent"])["kind"] == above))


def span_text(code: Column) -> Column:
    """The text of a node's characters."""
    return F.substring(code, F.col("start") + 1, F.col("stop") - F.col("start"))


def clipped(candidates: DataFrame, references: DataFrame, pair: list[str], item: list[str], by: list[str], times: str | None = None) -> DataFrame:
    """(by, matched, total): items of the references that their candidates have too, each as often as both do, and all of them.

    candidates and references: rows (pair, item); by: some of the pair's columns; times: the references' column that counts an item, if a row is
    not just one. A pair without reference items adds nothing.
    """
    have = candidates.groupBy(*pair, *item).agg(F.count("*").alias("_have"))
    want = references.groupBy(*pair, *item).agg((F.sum(times) if times else F.count("*")).alias("_want"))
    both = want.join(have, [*pair, *item], "left")
    return both.groupBy(*by).agg(F.sum(F.least("_want", F.coalesce("_have", F.lit(0)))).alias("matched"), F.sum("_want").alias("total"))


def subtrees(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, shape) of every subtree of two nodes or more. nodes: all, or the inner ones alone and without their numbers."""
    return (nodes.where("last > node") if "last" in nodes.columns else nodes).select(*keys, "shape")


def data_flow(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, relation, target, source): what each assignment computes a variable from, and where other uses come from.

    Variables are numbered by their first place in the text. A name means the last
    declaration of it before, if its scope hasn't ended, or else the same undeclared variable
    throughout the text. In ``x = e`` and ``T x = e`` x is computed from each variable of e, in
    ``x++`` from itself; a use in no assignment comes from itself. nodes need role, variable and target.
    """
    computed = (F.col("role") == "updated") | F.col("target").isNotNull()
    target = F.when(F.col("role") == "updated", F.col("variable")).otherwise(F.coalesce("target", "variable"))
    found = nodes.where("role in ('used', 'updated')")
    return found.select(*keys, F.when(computed, "computed").otherwise("comes").alias("relation"), target.alias("target"), F.col("variable").alias("source"))
