"""Candidates in long form (input, position, code): selection, histograms, pivots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators.columns import as_row
from quarryloom.sources import scratch

#: Most columns of pivoted.
MOST_COLUMNS = 2000


def judged(df: DataFrame, raw_ok: Column, fixed: Column, fixed_ok: Column) -> DataFrame:
    """df with raw_ok, fixed and fixed_ok. Nulls count as not valid."""
    as_row(df, "raw_ok", "fixed", "fixed_ok")
    return df.withColumns({"raw_ok": F.coalesce(raw_ok, F.lit(False)), "fixed": fixed, "fixed_ok": F.coalesce(fixed_ok, F.lit(False))})


def first_valid(df: DataFrame, key: str, pos: str, code: str) -> DataFrame:
    """One row for each input: the first candidate that is valid raw or mended.

    At one position raw wins. Where none is valid the first candidate stands unchanged,
    with fell_back. Partial aggregation keeps one struct for each input and task.
    """
    ok = F.col("raw_ok") | F.col("fixed_ok")
    item = F.struct(F.col(pos).alias("pos"), F.when(F.col("raw_ok") | ~ok, F.col(code)).otherwise(F.col("fixed")).alias("code"), (~F.col("raw_ok") & ok).alias("used_repair"))
    found = df.groupBy(key).agg(F.min(F.when(ok, item)).alias("best"), F.min(item).alias("head"))
    chosen = F.coalesce("best", "head")
    return found.select(key, chosen["pos"].alias("chosen_pos"), chosen["code"].alias("chosen"), chosen["used_repair"].alias("used_repair"), F.col("best").isNull().alias("fell_back"))


def first_valid_lazily(df: DataFrame, key: str, pos: str, code: str, judge: Callable[[DataFrame], DataFrame], step: int = 1) -> DataFrame:
    """first_valid, but judge sees a candidate only while its input has none valid before it.

    judge: adds raw_ok, fixed and fixed_ok to rows, as judged does; it may be costly. In each
    round the next ``step`` positions of the inputs still open are judged, and what they
    give is written; inputs with a valid one leave. There are as many rounds as steps to the last first
    valid candidate. Positions count by rank, so gaps cost nothing; equal positions are
    judged together.
    """
    spark = df.sparkSession

    def written(rows: DataFrame) -> DataFrame:
        path = scratch.folder(spark, "round")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    nth = F.floor((F.dense_rank().over(Window.partitionBy(key).orderBy(pos)) - 1) / step)
    rows = written(df.withColumn("_round", nth))
    last = rows.agg(F.max("_round")).first()[0]
    # what every input falls back on, and the first valid ones found so far
    heads = rows.where("_round = 0").groupBy(key).agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(code).alias("code"))).alias("_head"))
    todo, found = heads.select(key), []
    for n in range(-1 if last is None else int(last) + 1):
        # written before anything is asked of it: a condition on judge's columns would else be tried on closed inputs too, and twice
        judged_ = written(judge(rows.where(F.col("_round") == n).join(todo, key, "left_semi").drop("_round")))
        ok = judged_.where(F.col("raw_ok") | F.col("fixed_ok"))
        best = written(first_valid(ok, key, pos, code))
        found.append(best)
        todo = written(rows.where(F.col("_round") > n).select(key).distinct().join(todo, key, "left_semi").join(best, key, "left_anti"))
        if not todo.limit(1).count():
            break
    none = heads.select(key, F.col("_head.pos").alias("chosen_pos"), F.col("_head.code").alias("chosen"), F.lit(False).alias("used_repair"), F.lit(True).alias("fell_back"))
    if not found:
        return none
    chosen = reduce(DataFrame.unionByName, found)
    return chosen.unionByName(none.join(chosen, key, "left_anti"))


def edited(chosen: DataFrame, edit: Callable[[Column], Column] | None, column: str = "chosen") -> DataFrame:
    """chosen with each chosen candidate edited, such as renamed and annotated; what a fallback left stays as it was. No edit: as it is."""
    if edit is None:
        return chosen
    return chosen.withColumn(column, F.when(F.col("fell_back"), F.col(column)).otherwise(edit(F.col(column))))


def position_histogram(chosen: DataFrame, k: int) -> DataFrame:
    """How often each position was chosen raw and mended; positions without a row count 0."""
    spark = chosen.sparkSession
    counts = chosen.where(~F.col("fell_back")).groupBy(F.col("chosen_pos").cast("long").alias("pos")).agg(F.count_if(~F.col("used_repair")).alias("n_raw"), F.count_if("used_repair").alias("n_repaired"))
    return spark.range(k).withColumnRenamed("id", "pos").join(counts, "pos", "left").na.fill(0)


def all_failed(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count("*").alias("n_inputs"), F.count_if("fell_back").alias("n_all_failed"))


def validity_by_position(df: DataFrame, pos: str, k: int) -> DataFrame:
    """Valid candidates at each position, with no early exit."""
    counts = df.groupBy(F.col(pos).cast("long").alias("pos")).agg(F.count_if("raw_ok").alias("n_valid"))
    return df.sparkSession.range(k).withColumnRenamed("id", "pos").join(counts, "pos", "left").na.fill(0)


def width(df: DataFrame, pos: str) -> int:
    """How many columns the positions of df need, 1 at least."""
    return (df.agg(F.max(pos)).first()[0] or 0) + 1


def pivoted(df: DataFrame, key: str, pos: str, code: str, k: int, prefix: str = "generated_test_") -> DataFrame:
    """One row for each input with num_results and k columns, MOST_COLUMNS at most; a missing candidate is null.

    A position of null, of less than 0 or of k or more raises. Of several candidates at one
    position the greatest stays.
    """
    if k > MOST_COLUMNS:
        raise ValueError(f"{k} positions are more than the {MOST_COLUMNS} columns of a wide table: keep the long form")
    placed = F.coalesce(F.col(pos).between(0, k - 1), F.lit(False))
    lost = F.raise_error(F.concat(F.lit(f"no column of {k} for position "), F.coalesce(F.col(pos).cast("string"), F.lit("null"))))
    kept = df.where(F.when(placed, F.lit(True)).otherwise(lost.cast("boolean")))
    each = kept.groupBy(key, pos).agg(F.max(code).alias("_code"))
    wide = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int"), "_code"))).alias("_at"))  # k entries at most
    return wide.select(key, F.lit(k).alias("num_results"), *[F.col("_at")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def unpivoted(df: DataFrame, key: str, k: int, prefix: str = "generated_test_") -> DataFrame:
    """Long form again, without null and empty candidates."""
    long = df.unpivot([key], [f"{prefix}{i + 1}" for i in range(k)], "name", "code")
    pos = F.regexp_extract("name", r"(\d+)$", 1).cast("int") - 1
    return long.where("code is not null and code <> ''").select(key, pos.alias("cand_pos"), "code")


def strided(flat: Column, k: int) -> list[Column]:
    """Column i holds the entries i, i + k, i + 2k of a flat list with k candidates for each input."""

    def part(i: int) -> Column:
        return F.filter(flat, lambda x, j: F.pmod(j, F.lit(k)) == i)

    return [part(i) for i in range(k)]
