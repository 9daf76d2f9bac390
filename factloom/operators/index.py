"""The symbol index: occurrences by name, role and place; definitions, references, dependencies between files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role bits of an index store.
ROLES = {"declaration": 1, "definition": 2, "reference": 4, "read": 8, "write": 16, "call": 32, "dynamic": 64, "address_of": 128, "implicit": 256}
TYPE_KINDS = ("class", "struct", "enum", "protocol", "actor", "typealias", "extension")


def has_roles(c: Column, *names: str) -> Column:
    """All of the roles."""
    m = 0
    for n in names:
        m |= ROLES[n]
    return F.coalesce(c.bitwiseAND(F.lit(m)) == m, F.lit(False))


def any_role(c: Column, *names: str) -> Column:
    m = 0
    for n in names:
        m |= ROLES[n]
    return F.coalesce(c.bitwiseAND(F.lit(m)) != 0, F.lit(False))


STABLE = ["file", "line", "col", "module", "usr", "name", "kind", "roles"]


def definitions(occ: DataFrame) -> DataFrame:
    return occ.where(any_role(F.col("roles"), "definition", "declaration"))


def references_to(occ: DataFrame, *names: str) -> DataFrame:
    """References, not definitions, of the symbols of these names; a symbol's other spellings count too."""
    ids = occ.where(F.col("name").isin(*names)).select("usr").distinct()
    return occ.where(has_roles(F.col("roles"), "reference") & ~has_roles(F.col("roles"), "definition")).join(ids, "usr", "left_semi")


def occurrences_at(occ: DataFrame, file: str, line: int, col: int) -> DataFrame:
    return occ.where((F.col("file") == file) & (F.col("line") == line) & (F.col("col") == col))


def definition_files(occ: DataFrame) -> DataFrame:
    """usr, n_files, file: definitions hold, declarations where there is none; file only if it is the only one."""
    d = definitions(occ).where("usr is not null and usr <> ''").withColumn("is_def", has_roles(F.col("roles"), "definition"))
    g = d.groupBy("usr").agg(
        F.max("is_def").alias("has_def"), F.min(F.when(F.col("is_def"), F.col("file"))).alias("a"), F.max(F.when(F.col("is_def"), F.col("file"))).alias("b"), F.min("file").alias("c"), F.max("file").alias("d")
    )
    low, high = F.when(F.col("has_def"), F.col("a")).otherwise(F.col("c")), F.when(F.col("has_def"), F.col("b")).otherwise(F.col("d"))
    return g.select("usr", (low != high).alias("ambiguous"), F.when(low == high, low).alias("file"))


def file_references(occ: DataFrame) -> DataFrame:
    """src_file, dst_file, first place, n: explicit references between files over symbols of one definition file.

    References are first reduced to one row for each (usr, file), map-side, so a symbol that holds a third of all
    occurrences is joined as one row a file.
    """
    refs = occ.where(has_roles(F.col("roles"), "reference") & ~any_role(F.col("roles"), "definition", "implicit")).where("usr is not null and usr <> '' and file is not null")
    per = refs.dropDuplicates(["usr", "file", "line", "col"]).groupBy("usr", "file").agg(F.min(F.struct("line", "col")).alias("at"), F.count(F.lit(1)).alias("n"))
    defs = definition_files(occ).where("not ambiguous").select("usr", F.col("file").alias("dst_file"))
    e = per.join(defs, "usr").where("file <> dst_file")
    return e.groupBy(F.col("file").alias("src_file"), "dst_file").agg(F.min("at").alias("at"), F.sum("n").alias("n")).select("src_file", "dst_file", F.col("at.line").alias("line"), F.col("at.col").alias("col"), "n")


def mixed_configurations(units: DataFrame) -> DataFrame:
    """(module, main_file) with more than one output."""
    return units.groupBy("module_name", "main_file").agg(F.countDistinct("output_file").alias("n_outputs")).where("n_outputs > 1")
