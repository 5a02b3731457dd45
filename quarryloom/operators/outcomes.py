"""Outcome funnels, coverage and project summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.operators.columns import as_row

#: How far a test came: each stage includes the ones before.
STAGES = ("correct_syntax", "compilable", "executable", "passing_test", "correct_test")


def rate(n: Column, total: Column) -> Column:
    """Percent; null where total is 0."""
    return F.try_divide(n * F.lit(100.0), total.cast("double"))


def stage_flags(reached: Column) -> dict[str, Column]:
    """Booleans of the stages from the number of stages reached."""
    return {name: reached > i for i, name in enumerate(STAGES)}


def ordered(df: DataFrame, version: str = "version_num", test: str = "test_id") -> DataFrame:
    """df by version, then by test."""
    return df.orderBy(version, test)


def _summary(df: DataFrame, by: list[str], errors: dict[str, Column], right: dict[str, Column]) -> DataFrame:
    counts = {k: F.count_if(v) for k, v in {**errors, **right}.items()}
    found = df.groupBy(*by).agg(F.count("*").alias("total_tests"), *[v.alias(f"n_{k}") for k, v in counts.items()])
    return found.select(*by, "total_tests", *[c for k in counts for c in (F.col(f"n_{k}"), rate(F.col(f"n_{k}"), F.col("total_tests")).alias(f"rate_{k}"))])


def _right() -> dict[str, Column]:
    return {"syntax_correct": F.col("correct_syntax"), "compile_correct": F.col("compilable"), "passing_tests": F.col("passing_test"), "correct_tests": F.col("correct_test")}


def single_funnel(df: DataFrame, by: list[str]) -> DataFrame:
    """Each test ends in one bucket, so the error counts are disjoint. A null flag is a stage that was not reached."""
    syntax, compiled, ran, passed = (F.coalesce(F.col(c), F.lit(False)) for c in STAGES[:4])
    errors = {"syntax_error": ~syntax, "compile_error": syntax & ~compiled, "execute_error": compiled & ~ran, "failing_tests": ran & ~passed}
    return _summary(df, by, errors, _right())


def any_of_k(df: DataFrame, by: list[str], method: list[str], order: str) -> DataFrame:
    """Outcome of each method over its candidates up to the first passing one, then the funnel with nested error counts.

    Whether a stage was reached is that of any candidate; correctness is decided on the
    first passing candidate alone. A null flag is a stage that was not reached.
    """
    first = F.min(F.when(F.col("passing_test"), F.struct(F.col(order).alias("at"), F.col("correct_test").alias("correct"))))
    each = df.groupBy(*by, *method).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in STAGES[:4]], first.alias("first"))
    each = each.withColumn("correct_test", F.coalesce(F.col("first.correct"), F.lit(False)))
    errors = {"syntax_error": ~F.col("correct_syntax"), "compile_error": ~F.col("compilable"), "execute_error": ~F.col("executable"), "failing_tests": ~F.col("passing_test")}
    return _summary(each, by, errors, _right())


def coverage(df: DataFrame) -> DataFrame:
    """df with line_rate and branch_rate: no branches count as 0, no lines as null."""
    as_row(df, "line_rate", "branch_rate")
    return df.withColumns({
        "line_rate": rate(F.col("lines_covered"), F.col("lines_total")),
        "branch_rate": F.when(F.col("branches_total") == 0, F.lit(0.0)).otherwise(rate(F.col("branches_covered"), F.col("branches_total"))),
    })
