"""Readers: source folders, overlays, build-graph exports, baselines, facts already parsed."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from factloom.functions import paths

FILES = "path string, name string, text string, line_count int"
ROOT_MARKERS = ("Package.swift", ".git", "WORKSPACE", "MODULE.bazel")


def root_of(path: str) -> str:
    """The nearest folder at or above path that holds a project's marker; path itself if there is none."""
    at = os.path.abspath(path)
    while True:
        names = os.listdir(at) if os.path.isdir(at) else []
        if any(m in names for m in ROOT_MARKERS) or any(n.endswith(".xcodeproj") for n in names):
            return at
        up = os.path.dirname(at)
        if up == at:
            return os.path.abspath(path)
        at = up


def source_files(spark: SparkSession, root: str, including: Sequence[str] = (), excluding: Sequence[str] = (), suffix: str = "swift") -> DataFrame:
    """The text files below a root that the globs cover; a file that is no UTF-8 raises, as a query needs all its files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    cut = len(os.path.abspath(root).rstrip("/")) + 2
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {cut})")
    df = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).where(paths.covers(F.col("path"), including, excluding))
    return df.select("path", paths.last_component(F.col("path")).alias("name"), "text", F.size(F.split("text", r"\r\n|\r|\n")).alias("line_count"))


def inline_sources(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = [(p, p.rsplit("/", 1)[-1], t, len(t.splitlines()) + (t.endswith("\n") or not t)) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, FILES)


def with_overlay(disk: DataFrame, overlay: DataFrame) -> DataFrame:
    """Unsaved texts (path, text) in place of those on disk; files that are only in the editor are added."""
    o = overlay.select("path", F.col("text").alias("_text"))
    j = disk.join(o, "path", "full_outer")
    return j.select("path", F.coalesce("name", paths.last_component(F.col("path"))).alias("name"), F.coalesce("_text", "text").alias("text"), F.size(F.split(F.coalesce("_text", "text"), r"\r\n|\r|\n")).alias("line_count"))


def changed_only(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files whose text has no parsed facts yet, told by path and hash; only hashes are compared."""
    return files.withColumn("hash", F.sha2("text", 256)).join(parsed.select("path", "hash"), ["path", "hash"], "left_anti")


GRAPH = "results array<struct<target:struct<type:string,rule:struct<name:string,ruleClass:string,location:string,ruleInput:array<string>,attribute:array<struct<name:string,stringListValue:array<string>>>>>,configurationId:int>>, configurations array<struct<id:int,checksum:string,isTool:boolean>>"


def build_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Targets (label, checksum, rule_class, tags) and edges of a JSON export of configured targets.

    A target that comes twice with one configuration, or a dependency that is no target, is an error of the export.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    configs = raw.select(F.explode("configurations").alias("c")).select(F.col("c.id").alias("id"), F.col("c.checksum").alias("checksum"))
    t = raw.select(F.explode("results").alias("r")).select(
        F.col("r.target.rule.name").alias("label"), F.col("r.target.rule.ruleClass").alias("rule_class"), F.col("r.target.rule.ruleInput").alias("inputs"),
        F.coalesce(F.try_element_at(F.filter("r.target.rule.attribute", lambda a: a["name"] == "tags"), F.lit(1))["stringListValue"], F.array().cast("array<string>")).alias("tags"), F.col("r.configurationId").alias("id"),
    ).join(configs, "id", "left")
    targets = t.select("label", "checksum", "rule_class", "tags")
    w = Window.partitionBy("label", "checksum")
    again = F.count(F.lit(1)).over(w) > 1
    targets = targets.withColumn("label", F.when(again, F.raise_error(F.concat(F.lit("a target comes twice with one configuration: "), "label"))).otherwise(F.col("label")))
    known = targets.select(F.col("label").alias("dst_label"), F.col("checksum").alias("dst_checksum")).withColumn("known", F.lit(True))
    edges = t.select(F.col("label").alias("src_label"), F.col("checksum").alias("src_checksum"), F.explode("inputs").alias("dst_label")).withColumn("dst_checksum", F.col("src_checksum")).distinct()
    edges = edges.join(known, ["dst_label", "dst_checksum"], "left")
    missing = F.raise_error(F.concat("src_label", F.lit(" depends on an unknown target: "), "dst_label"))
    return targets, edges.select("src_label", "src_checksum", F.when(F.col("known"), F.col("dst_label")).otherwise(missing).alias("dst_label"), "dst_checksum")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted entries: rule, name, path (and folder, whose scope they have)."""
    return spark.read.schema("rule string, name string, path string, folder string").json(path)


class Folders(DataSource):
    """format('source_folders'): option root; one row for each folder, listed in parallel by top-level folder."""

    @classmethod
    def name(cls) -> str:
        return "source_folders"

    def schema(self) -> str:
        return "path string, depth int, n_files int"

    def reader(self, schema: StructType) -> "FoldersReader":
        return FoldersReader(self.options["root"])


class FoldersReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as it:
            return [InputPartition(e.name) for e in sorted(it, key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for at, dirs, files in os.walk(os.path.join(self.root, partition.value)):
            dirs.sort()
            rel = os.path.relpath(at, self.root)
            yield rel, rel.count("/") + 1, len(files)
