"""The occurrences of each symbol, where a few symbols hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import heavy_keys, skew_safe_groups
from factloom.session import table

ORDER = ["module", "file", "line", "col", "roles"]
#: The share of all distinct occurrences from which a symbol counts as heavy.
HEAVY_SHARE = 0.02


NAMED = "usr is not null and usr <> ''"


def symbol_groups(spark, sf_dir: str) -> DataFrame:
    """Groups of all occurrences; those without usr are groups as well, since they count in the total."""
    return skew_safe_groups(table(spark, sf_dir, "occurrences"), "usr", ORDER, ["module"])


def p3_found(spark, sf_dir: str) -> DataFrame:
    counts = skew_safe_groups(table(spark, sf_dir, "occurrences"), "usr", ORDER, first_rows=False)
    return heavy_keys(counts, "usr", HEAVY_SHARE).where(NAMED)


def p3_symbol_groups(spark, sf_dir: str) -> DataFrame:
    g = symbol_groups(spark, sf_dir).where(NAMED)
    return g.select(
        "usr", F.col("n_distinct").alias("n_occurrences"), F.col("n_module").alias("n_modules"), F.col("first.module").alias("first_module"), F.col("first.file").alias("first_file"),
        F.col("first.line").alias("first_line"), F.col("first.col").alias("first_col"), F.col("first.roles").alias("first_roles"),
    )
