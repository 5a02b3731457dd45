"""Noise masks as such: runs of equal values, masks from runs, and sentinels from a mask.

A run is (first, length, noise). Rows that are too long for one array may come in pieces,
whose runs are joined where they meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators.columns import column
from quarryloom.operators.spans import EOS


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def runs(mask: Column) -> Column:
    """The runs of an array of booleans, in order; an empty array has none. A null entry is no noise."""

    def of(clean: Column) -> Column:
        n = F.size(clean)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(clean, i) != F.get(clean, i - 1))))
        each = lambda places: F.transform(places, lambda p, j: F.struct(p.alias("first"), (F.coalesce(F.get(places, j + 1), n) - p).alias("length"), F.get(clean, p).alias("noise")))
        return _once(begins, each)

    return F.when(mask.isNotNull(), _once(F.transform(mask, lambda x: F.coalesce(x, F.lit(False))), of))


def mask_of(runs_: Column) -> Column:
    """The array of booleans that has the runs."""
    return F.flatten(F.transform(runs_, lambda r: F.array_repeat(r["noise"], r["length"])))


def mask_of_cuts(kept: Column, noise: Column) -> Column:
    """The mask of spans that take turns, a kept one first, whose ends are the cut points kept and noise, both from 0 on."""
    spans = F.sequence(F.lit(1), F.size(kept) - 1)
    each = lambda cuts, j, value: F.array_repeat(F.lit(value), F.get(cuts, j) - F.get(cuts, j - 1))
    return F.flatten(F.transform(spans, lambda j: F.concat(each(kept, j, False), each(noise, j, True))))


def with_sentinels(ids: Column, mask: Column, vocabulary: int) -> Column:
    """ids with each run of noise as one sentinel ``<vocabulary - j>``, j from 1, and EOS at the end.

    The complement of the mask gives labels: there the kept runs become sentinels.
    """

    def parts(found: Column) -> Column:
        # runs take turns, so the number of those of noise up to the i-th follows from i and the first
        number = lambda i: F.floor((i + F.when(found[0]["noise"], 2).otherwise(1)) / 2).cast("int")
        sentinel = lambda i: F.array(F.concat(F.lit("<"), (F.lit(vocabulary) - number(i)).cast("string"), F.lit(">")))
        return F.transform(found, lambda r, i: F.when(r["noise"], sentinel(i)).otherwise(F.slice(ids, r["first"] + 1, r["length"])))

    return F.concat(F.flatten(_once(runs(mask), parts)), F.array(F.lit(EOS)))


def runs_of_pieces(df: DataFrame, key: str, piece: str, mask: str) -> DataFrame:
    """(key, first, length, noise): the runs of each key's pieces, one after another by their number; a run may cross pieces.

    The pieces' masks are shuffled, which are shorter than their runs, and only pieces are sorted. Places count over
    all pieces of a key; empty and null masks add nothing.
    """
    rows = df.select(column(key).alias("key"), column(piece).alias("piece"), F.size(column(mask)).alias("n"), F.transform(column(mask), lambda x: F.coalesce(x, F.lit(False))).alias("mask")).where("n > 0")
    # the values at both ends, and where the last run begins, 0 if all is one run
    other = F.array_position(F.reverse("mask"), ~F.element_at("mask", -1))
    rows = rows.withColumns({"first": F.get("mask", 0), "last": F.element_at("mask", -1), "turn": F.when(other > 0, F.col("n") - other + 1).otherwise(0)})
    order = Window.partitionBy("key").orderBy("piece")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("n").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a run goes on over pieces that are one run each: it begins where the last run before has another value, and ends with the last piece it reaches
    rows = rows.withColumns({"head": F.coalesce(F.lag("last").over(order) != F.col("first"), F.lit(True)), "tail": F.coalesce(F.lead("first").over(order) != F.col("last"), F.lit(True))})
    begin = F.last(F.when((F.col("turn") > 0) | F.col("head"), F.col("at") + F.col("turn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("from", F.when(F.col("head"), F.col("at")).otherwise(begin))  # where the first run began
    each = lambda found: F.transform(found, lambda r, i: F.struct(
        F.when(i == 0, F.col("from")).otherwise(F.col("at") + r["first"]).alias("first"), (F.col("at") + r["first"] + r["length"]).alias("end"), r["noise"].alias("noise"), ((i < F.size(found) - 1) | F.col("tail")).alias("whole"),
    ))
    found = rows.select(F.col("key").alias(key), F.inline(_once(runs(F.col("mask")), each))).where("whole")
    return found.select(column(key), "first", (F.col("end") - F.col("first")).alias("length"), "noise")
