"""Groups and sets over rows, and lists within a row, under the rules of the rule language: nulls equal each other, sets
have no order, a subscript outside its list is an error."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str] = ()) -> DataFrame:
    """by and values ARRAY: the values of each group, in order (by the value itself without one). The list of a group is one
    value of one row; where only something of it is asked for, reduced_groups() never makes the list."""
    key = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("_k")).select(*by, F.transform("_k", lambda x: x["_v"]).alias("values"))


def map_values(groups: DataFrame, by: Sequence[str], **new: Column) -> DataFrame:
    return groups.select(*by, *[c.alias(n) for n, c in new.items()])


def reduced_groups(rows: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """mapValues where the new value is an aggregate: combined before the exchange, so a hot key costs one row a task."""
    return rows.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])


def lookup(groups: DataFrame, by: str, key) -> DataFrame:
    """The group of a key; no row without one."""
    return groups.where(F.col(by).eqNullSafe(F.lit(key)))


def distinct(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct()


def any_and_all(rows: DataFrame, by: Sequence[str], any_: dict[str, Column], all_: dict[str, Column]) -> DataFrame:
    """contains(where:) and allSatisfy of each group; a null test is false."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy(*by).agg(*[F.bool_or(ok(c)).alias(n) for n, c in any_.items()], *[F.bool_and(ok(c)).alias(n) for n, c in all_.items()])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, each once; nulls equal each other."""
    return a.subtract(b.select(*a.columns))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets: order and repeats do not count."""
    return is_subset(a, b) & is_subset(b, a)


def sorted_by(items: Column, precedes: Callable[[Column, Column], Column]) -> Column:
    """A list sorted by a comparator: precedes(a, b) says whether a comes before b."""
    return F.array_sort(items, lambda a, b: F.when(precedes(a, b), F.lit(-1)).when(precedes(b, a), F.lit(1)).otherwise(F.lit(0)))


def subscript(items: Column, index: Column) -> Column:
    """The element at an index from 0; outside the list an error."""
    out = F.raise_error(F.concat(F.lit("index out of range: "), index.cast("string")))
    return F.when((index < 0) | (index >= F.size(items)), out).otherwise(F.get(items, index.cast("int")))


def sliced(items: Column, start: Column, end: Column) -> Column:
    """start ..< end of a list; bounds outside it, or in the wrong order, are an error."""
    ok = (start >= 0) & (end <= F.size(items)) & (start <= end)
    length = F.when(ok, (end - start).cast("int")).otherwise(F.raise_error(F.lit("range out of bounds")).cast("int"))
    return F.slice(items, F.greatest(start.cast("int"), F.lit(0)) + 1, length)


def compact_map(items: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(items, f), lambda x: x.isNotNull())


def flat_map(items: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items, f))


def indices(items: Column) -> Column:
    """0 ..< count."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def in_range(value: Column, low: Column | None = None, high: Column | None = None, closed: bool = False) -> Column:
    """low ..< high, or low ... high if closed; either end may be open. Bounds in the wrong order are an error."""
    ok = F.lit(True)
    if low is not None and high is not None:
        ok = F.when(low > high, F.raise_error(F.lit("a range ends before it starts")).cast("boolean")).otherwise(F.lit(True))
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & ((value <= high) if closed else (value < high))
    return F.coalesce(ok, F.lit(False))


def range_count(low: Column, high: Column, closed: bool = False) -> Column:
    n = high - low + (1 if closed else 0)
    return F.when(low > high, F.raise_error(F.lit("a range ends before it starts")).cast("bigint")).otherwise(n.cast("bigint"))
