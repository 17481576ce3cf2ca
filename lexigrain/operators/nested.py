"""Lists of structs: building, flattening and profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_inner(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """A row per element, its fields as columns; rows with a null or empty list drop out."""
    return df.select(*keep, F.inline(array))


def flatten_outer(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """A row per element; a null or empty list gives one row of nulls."""
    return df.select(*keep, F.inline_outer(array))


def nest(df: DataFrame, keys: list[str], fields: list[str], name: str, order: list[str]) -> DataFrame:
    """A row per key with its rows as a list of structs, in order of ``order``, which must be the first fields."""
    if fields[: len(order)] != order:
        raise ValueError("the list is sorted by its first fields")
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def list_size(array: str | Column) -> Column:
    """Elements of a list; a null list has none."""
    return F.coalesce(F.size(array), F.lit(0)).cast("long")


def size_distribution(df: DataFrame, array: str) -> DataFrame:
    return df.groupBy(list_size(array).alias("len")).agg(F.count("*").alias("rows"))


def null_ratios(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the share of nulls in each column."""
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Value, rows, and share of all rows.  The total is one number, joined as such."""
    total = df.agg(F.count("*").alias("_all"))
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    return counts.crossJoin(F.broadcast(total)).select(column, "rows", (F.col("rows") / F.col("_all")).alias("share"))
