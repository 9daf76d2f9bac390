"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spreads rows evenly if the scan has fewer splits than the cluster could work on.

    Text work costs far more than moving the text once; a table of few large row groups would leave cores idle.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
