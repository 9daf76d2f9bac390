"""Rows in an order within their group: neighbours, what came before, the first of each group, separators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """rows with previous and next, the column of the rows before and after in their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(column).over(w)).withColumn("next", F.lead(column).over(w))


def with_preceding(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str = "preceding") -> DataFrame:
    """rows with the list of the column's values in all rows before them in their group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.collect_list(column).over(w))


def earliest(rows: DataFrame, by: Sequence[str], order: Sequence[str], *columns: str) -> DataFrame:
    """The columns of the first row of each group, by a struct of its order: one aggregation, combined before the exchange."""
    at = F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*by).agg(at.alias("_first")).select(*by, "_first.*")


def distinct_warnings(rows: DataFrame, message: str, order: Sequence[str] = ()) -> DataFrame:
    """Each message once; with an order also where it was seen first, by which the result is sorted."""
    if not order:
        return rows.select(message).distinct()
    g = rows.groupBy(message).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("first"))
    return g.orderBy("first", message).select(message, "first.*")


def separated(rows: DataFrame, by: Sequence[str], order: Sequence[str], matches: Column, name: str = "separated") -> DataFrame:
    """rows with a mark on those that need a separator before them: they and the row before them both match."""
    w = Window.partitionBy(*by).orderBy(*order)
    ok = F.coalesce(matches, F.lit(False))
    return rows.withColumn("_ok", ok).withColumn(name, F.col("_ok") & F.coalesce(F.lag("_ok").over(w), F.lit(False))).drop("_ok")
