"""Column names: chosen at run time, and kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def chosen(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns alone; a name that df hasn't raises."""
    lost = [x for x in names if x not in df.columns]
    if lost:
        raise ValueError(f"no column {', '.join(lost)} among {', '.join(df.columns)}")
    return df.select(*map(column, names))


def as_row(df: DataFrame, *new: str) -> Column:
    """All columns of df as a struct named row, so that no name clashes with a working column. A column of df with the name of a new one raises."""
    taken = [x for x in new if x in df.columns]
    if taken:
        raise ValueError(f"df has columns of the new names {', '.join(taken)}")
    return F.struct(*map(column, df.columns)).alias("row")


def from_row(names: list[str]) -> list[Column]:
    return [F.col("row")[x].alias(x) for x in names]
