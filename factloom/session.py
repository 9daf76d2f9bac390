"""Settings that every plan shares: where lineage may be cut, and how tables are read."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in spark.checkpoint.dir. Only a local session without that setting (tests, a laptop) gets a
    folder of this machine; a cluster without the setting is an error, since its executors share no such folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared checkpoint folder and reads it again.

    Lineage ends there, so a lost executor costs a read and not a recount. Unlike checkpoint(), the table has real
    sizes: the estimates that checkpoint() carries along multiply with every join of a loop, until planning takes
    longer than the joins. The tables of a session are deleted when it ends.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factloom-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: set[str] = set()


def _drop(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the scan keeps column pruning and pushed filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
