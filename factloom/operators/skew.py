"""Per-key results where a few keys hold most rows.

Distinct rows are range partitioned on (key, secondary order) by sampled quantiles, so that a heavy key lies across
as many neighbouring partitions as its share of the rows. Each partition makes one partial state for a key; the
states of a key that crosses partition bounds are then stitched. Work for one key is never bound to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def _fresh(taken: Sequence[str], wanted: str) -> str:
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def balanced_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The distinct rows of keys + order, range partitioned on them.

    Repeats vanish before the first exchange (map-side), whose hash covers the whole row, so one row delivered a
    million times costs one row per task. The range exchange then samples quantiles of the distinct rows.
    """
    cols = [*keys, *order]
    distinct = df.select(*cols).dropDuplicates(cols)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in cols])


def skew_safe_groups(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    set_columns: Sequence[str] = (),
    partitions: int | None = None,
    first_rows: bool = True,
) -> DataFrame:
    """One row for each key: n_distinct rows, the number of distinct values of set_columns, and the first row by order.

    Result columns: key, n_distinct BIGINT, n_<column> BIGINT for each set column (nulls are no value),
    first STRUCT of order (left out, with the set columns, if first_rows is false). Null keys form a group of their own, as in GROUP BY; filter them before if unwanted.
    Repeated rows count once; nulls in order compare equal to each other and sort first; an empty table gives no rows;
    columns that are not named are never read. A set column must be one of order; ties cannot occur, since rows are
    distinct over key + order.
    """
    order = list(order)
    names = [key, *order]
    rows = balanced_distinct(df, [key], order, partitions)
    # The aggregation makes one partial state for each key (and value set) in each range, before its exchange; the
    # exchange then stitches the states of keys that cross bounds. No row is moved again.
    first = F.min(F.struct(*[F.struct(F.col(c).isNotNull().alias("s"), F.col(c).alias("v")).alias(c) for c in order])).alias("first")
    if set_columns:
        value = _fresh(names, "value")
        # Values of a key recur in its other ranges: they are merged first, key by key and value by value.
        merged = rows.groupBy(key, F.struct(*[F.col(c) for c in set_columns]).alias(value)).agg(F.count(F.lit(1)).alias("n_distinct"), first)
        counts: list[Column] = [F.countDistinct(F.col(f"{value}.{c}")).alias(f"n_{c}") for c in set_columns] if len(set_columns) > 1 else [F.count(F.col(f"{value}.{set_columns[0]}")).alias(f"n_{set_columns[0]}")]
        whole = merged.groupBy(key).agg(F.sum("n_distinct").alias("n_distinct"), *counts, F.min("first").alias("first"))
    else:
        whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_distinct"), *([first] if first_rows else []))
        if not first_rows:
            return whole
    plain = F.struct(*[F.col(f"first.{c}.v").alias(c) for c in order]).alias("first")
    return whole.select(key, "n_distinct", *[f"n_{c}" for c in set_columns], plain)


def heavy_keys(groups: DataFrame, key: str, share: float) -> DataFrame:
    """The keys of skew_safe_groups that hold at least share of all distinct rows.

    The counts, one row for each key, are written once; the total and the keys are both read from there.
    """
    groups = cut(groups.select(key, "n_distinct"))
    total = groups.agg(F.sum("n_distinct").alias("total"))
    return groups.where(F.col("n_distinct") >= F.lit(share) * total.scalar()).select(key)
