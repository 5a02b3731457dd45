"""Filter interaction audit: what each filter removes in every order of filters, from joint-failure counts.

For every set S of filters one pass counts the rows that fail all of S, as sums of
products of 0/1 flags. These counts N(S) hold everything: inclusion-exclusion gives the
rows that survive any set of filters, hence what each step of each order keeps and
removes; Moebius inversion gives the rows that fail one filter only; and as the Harsanyi
dividend of S in the game "rows removed" is (-1)^(|S|+1) N(S), a filter's Shapley value is
the sum of the dividends of its sets, each shared among |S| filters. No order is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import shared

#: Fewer words fail A; a smaller percentage of distinct words fails B; a larger percentage of capitals fails C; a sign of D fails D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Filters A to D of a text without null, as 0 or 1."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text), "D": text.rlike(SIGNS),
    }
    return {k: v.cast("int") for k, v in fails.items()}


def flagged(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A .. E, n, good, toxic): numbers of rows of documents with the same flags; rows may repeat.

    A null text is empty, a null part the empty string. E fails where a row of a smaller id
    has the identical text (by SHA-256); a row with a null id never fails E, nor does it make another
    one fail. A repeated row counts each time. good and toxic count rows whose id has a
    label of quality 1 and of toxic 1; several labels of one id count once.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"),
    )
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[v.alias(k) for k, v in text_flags(F.col("text")).items()])
    rows = shared.written(rows, "flags")
    flags = list("ABCD")
    nameless = rows.where("id is null").select("part", *flags, F.lit(0).alias("E"), F.lit(1).cast("long").alias("n"), *[F.lit(0).cast("long").alias(m) for m in MEASURES[1:]])

    each = rows.where("id is not null").groupBy("id", "part", "digest").agg(F.count("*").alias("n"), *[F.first(f).alias(f) for f in flags])
    if labels is None:
        each = each.withColumns({m: F.lit(0).cast("long") for m in MEASURES[1:]})
    else:
        one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
        known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        each = each.join(known, "id", "left").withColumns({m: F.col("n") * F.coalesce(m, F.lit(0)) for m in MEASURES[1:]})
    # the copies of a text in one part: all of them, and those of the smallest id
    copies = each.groupBy("digest", "part").agg(*[F.first(f).alias(f) for f in flags], *[F.sum(m).alias(m) for m in MEASURES], F.min(F.struct("id", *MEASURES)).alias("head"))
    first = copies.groupBy("digest").agg(F.min("head.id").alias("first"))
    copies = copies.join(first, "digest")
    passes = F.col("head.id") == F.col("first")
    kept = [F.when(passes, F.col(f"head.{m}")).otherwise(F.lit(0).cast("long")) for m in MEASURES]
    split = F.array(
        F.struct(F.lit(0).alias("E"), *[k.alias(m) for k, m in zip(kept, MEASURES, strict=True)]),
        F.struct(F.lit(1).alias("E"), *[(F.col(m) - k).alias(m) for k, m in zip(kept, MEASURES, strict=True)]),
    )
    return copies.select("part", *flags, F.explode(split).alias("x")).select("part", *flags, "x.*").where("n > 0").unionByName(nameless)


def joint_failures(rows: DataFrame, filters: Sequence[str] = FILTERS, measures: Sequence[str] = MEASURES, part: str = "part") -> DataFrame:
    """(part, one array for each measure): entry S is the sum over rows that fail every filter of the bit set S, as a product of flags."""
    sets = range(1 << len(filters))
    joint = lambda m, s: f"sum({' * '.join([m, *[f for i, f in enumerate(filters) if s >> i & 1]])}) AS {m}_{s}"
    sums = rows.groupBy(part).agg(*[F.expr(joint(m, s)) for m in measures for s in sets])
    return sums.select(part, *[F.array(*[f"{m}_{s}" for s in sets]).alias(m) for m in measures])


def _signed(array: str, sets: dict[int, int]) -> str:
    """SQL of the sum of entries of an array, each with its factor."""
    return " + ".join(f"{array}[{s}] * {k}L" for s, k in sets.items())


def interactions(joint: DataFrame, filters: Sequence[str] = FILTERS, measures: Sequence[str] = MEASURES, part: str = "part") -> DataFrame:
    """One row for each part, order of the filters and step (from 1).

    kept and removed: after and by this step; redundant: rows that fail its filter, but were
    removed before; unique_fails: rows that fail its filter alone; shapley: what its filter
    removes, summed over all orders; and for every measure but the first ``<measure>_lost``,
    its part of what the step removes.
    """
    k = len(filters)
    sets = range(1 << k)
    inside = lambda s: [t for t in sets if t & s == t]
    sign = lambda t: -1 if t.bit_count() % 2 else 1
    array = lambda entries, name: f"array({', '.join(entries)}) AS {name}"
    survivors = [array([_signed(m, {t: sign(t) for t in inside(s)}) for s in sets], m) for m in measures]
    n = measures[0]
    own = [[s for s in sets if s >> i & 1] for i in range(k)]
    fails = array([f"{n}[{1 << i}]" for i in range(k)], "fails")
    alone = array([_signed(n, {s: -sign(s) for s in own[i]}) for i in range(k)], "alone")
    # the share of a dividend, times the number of orders: whole, as |S| divides k!
    shares = array([_signed(n, {s: -sign(s) * factorial(k) // s.bit_count() for s in own[i]}) for i in range(k)], "shares")
    steps = []
    for order in permutations(range(k)):
        name, gone = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "i": i, "before": gone, "after": gone | 1 << i})
            gone |= 1 << i
    rows = joint.selectExpr(part, *survivors, fails, alone, shares)
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int>>")
    rows = rows.select("*", F.inline(listed))
    lost = {m: F.col(m)[F.col("before")] - F.col(m)[F.col("after")] for m in measures}
    return rows.select(
        part, "filter_order", "step", F.col(n)[F.col("after")].alias("kept"), lost[n].alias("removed"), (F.col("fails")[F.col("i")] - lost[n]).alias("redundant"),
        F.col("alone")[F.col("i")].alias("unique_fails"), *[lost[m].alias(f"{m}_lost") for m in measures[1:]], F.col("shares")[F.col("i")].alias("shapley"),
    )
