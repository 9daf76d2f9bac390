"""Rows with their members as arrays: what the matchers imports, calls and all_members look at. Each is one aggregation
of the members by their owner, combined before the exchange, and one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_members(rows: DataFrame, members: DataFrame, on: Sequence[str], columns: Sequence[str], name: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """rows with an array `name` of structs of `columns` of the members that agree in `on`, in order; empty without any."""
    key = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in columns]).alias("_m"))
    held = members.select(*on, key.alias("_k")).groupBy(*on).agg(F.array_sort(F.collect_list("_k")).alias("_all"))
    joined = rows.join(held, list(on), "left")
    kind = held.select(F.transform("_all", lambda x: x["_m"]).alias("a")).schema["a"].dataType
    return joined.withColumn(name, F.coalesce(F.transform("_all", lambda x: x["_m"]), F.array().cast(kind))).drop("_all")


def with_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (path) with imports ARRAY<STRING>, the modules each imports; imports: path, name."""
    m = imports.select("path", F.substring_index("name", ".", 1).alias("_module")).distinct().groupBy("path").agg(F.array_sort(F.collect_list("_module")).alias("imports"))
    return files.join(m, "path", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def with_calls(rows: DataFrame, calls: DataFrame, by_owner: bool = True) -> DataFrame:
    """Functions, initializers or properties with calls ARRAY<STRUCT<called, labels, line, col>>; by_owner false: files
    with all their calls. calls: path, owner, value (as called), labels, line, col, seq."""
    c = calls.select("path", "owner", F.col("value").alias("called"), "labels", "line", "col", "seq")
    if not by_owner:
        return with_members(rows, c, ["path"], ["called", "labels", "line", "col"], "calls")
    owner = F.concat_ws(".", "enclosing", "name")
    return with_members(rows.withColumn("owner", owner), c, ["path", "owner"], ["called", "labels", "line", "col"], "calls")
