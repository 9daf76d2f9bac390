"""Package manifests against the files they describe: files and imports of targets, declared and used dependencies.

manifest is a table of read_manifests(); files has path; imports has path, module, line, col. All checks are equi-joins:
a file meets its target over the folders above it, so no pair of file and target is compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import graph


def module_name(name):
    """The module of a target: what is no letter, digit or underscore becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def _folder(c):
    return F.regexp_replace(F.regexp_replace(c, r"^(?:\./)+", ""), r"/+$", "")


def targets(manifest: DataFrame) -> DataFrame:
    """target, module, type, folder, position: the known targets with a known folder."""
    t = manifest.where("kind = 'target' and state = 'known' and name is not null and value is not null")
    return t.select(F.col("name").alias("target"), module_name(F.col("name")).alias("module"), "type", _folder(F.col("value")).alias("folder"), "position")


def _below(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows (target, path, relative) whose relative path is or lies below one that is listed (owner, name)."""
    up = files.withColumn("at", F.explode(F.array_append(paths.ancestors(F.col("relative")), F.col("relative"))))
    named = listed.select(F.col("owner").alias("target"), _folder(F.col("name")).alias("at")).distinct()
    return up.join(named, ["target", "at"], "left_semi").select("target", "path").distinct()


def target_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """target, path: files in a target's folder, without excluded ones, and only listed ones where sources are listed."""
    t = targets(manifest)
    up = files.where("path is not null").select("path").distinct().withColumn("folder", F.explode(F.array_append(paths.ancestors(F.col("path")), F.lit(""))))
    held = up.join(t.select("target", "folder"), "folder").withColumn("relative", F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))).drop("folder")
    known = manifest.where("state = 'known'")
    held = held.join(_below(held, known.where("kind = 'target_exclude'")), ["target", "path"], "left_anti")
    listed = known.where("kind = 'target_sources'")
    chosen = _below(held, listed)
    owners = listed.select(F.col("owner").alias("target")).distinct()
    return held.join(owners, "target", "left_anti").select("target", "path").unionByName(held.join(chosen, ["target", "path"], "left_semi").select("target", "path"))


def target_imports(manifest: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """target, path, line, col, module, imported: each import of a target's files, with the target of its module if the
    package has one; of several targets of a module the first in the manifest."""
    own = targets(manifest).groupBy("module").agg(F.min_by("target", "position").alias("imported"))
    return target_files(manifest, files).join(imports, "path").join(own, "module", "left").select("target", "path", "line", "col", "module", "imported")


def package_edges(manifest: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, seq, path, line, col: imports between targets, each edge at its first place."""
    at = F.min(F.struct("path", "line", "col"))
    e = target_imports(manifest, files, imports).where("imported is not null and imported <> target")
    return e.groupBy(F.col("target").alias("src"), F.col("imported").alias("dst")).agg(at.alias("at")).select("src", "dst", F.lit(0).alias("seq"), "at.*")


def declared(manifest: DataFrame) -> DataFrame:
    """src, dst, state: dependencies between targets of the package; a bare name counts if a target has it."""
    names = manifest.where("kind = 'target' and name is not null").select(F.col("name").alias("dst")).distinct()
    d = manifest.where("kind = 'target_dependency' and type in ('target', 'byName') and owner is not null")
    return d.select(F.col("owner").alias("src"), F.col("name").alias("dst"), "state").distinct().join(names, "dst", "left_semi").select("src", "dst", "state")


def check_dependencies(manifest: DataFrame, files: DataFrame, imports: DataFrame, ignoring: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """undeclared (target, module, path, line, col), unused (target, dependency) and empty (target).

    Targets whose list of dependencies is not fully known, and those without files, are not judged. A plug-in runs its
    dependencies and need not import them.
    """
    t = targets(manifest).where(~F.col("target").isin(*ignoring)) if ignoring else targets(manifest)
    held = target_files(manifest, files)
    empty = t.select("target").join(held, "target", "left_anti")
    open_ = manifest.where("kind = 'target_dependency' and state <> 'known' and owner is not null").select(F.col("owner").alias("target")).distinct()
    judged = t.join(held.select("target").distinct(), "target", "left_semi").join(open_, "target", "left_anti")
    modules = targets(manifest).groupBy("target").agg(F.min_by("module", "position").alias("module"))
    needs = declared(manifest).where("state = 'known'").select(F.col("src").alias("target"), F.col("dst").alias("dependency")).distinct()
    needs = needs.join(modules.withColumnRenamed("target", "dependency"), "dependency").select("target", "dependency", "module")
    used = target_imports(manifest, files, imports).join(judged.select("target", F.col("module").alias("own")), "target")
    undeclared = used.where("imported is not null and module <> own").join(needs, ["target", "module"], "left_anti").select("target", "module", "path", "line", "col")
    judged = judged.where(F.coalesce(F.col("type") != "plugin", F.lit(True))).select("target")
    unused = needs.join(judged, "target", "left_semi").join(used.select("target", "module"), ["target", "module"], "left_anti").select("target", "dependency")
    return undeclared, unused, empty


def _edges(manifest: DataFrame, conditional: bool) -> DataFrame:
    d = declared(manifest)
    return (d if conditional else d.where("state = 'known'")).select("src", "dst").distinct().withColumn("seq", F.lit(0))


def direct_dependencies(manifest: DataFrame, target: str, conditional: bool = False) -> DataFrame:
    return _edges(manifest, conditional).where(F.col("src") == target).select(F.col("dst").alias("target"))


def transitive_dependencies(manifest: DataFrame, *roots: str, conditional: bool = False) -> DataFrame:
    """target, level: all that the roots depend on, each at its shortest distance."""
    start = manifest.sparkSession.createDataFrame([(r,) for r in roots], "node string")
    return graph.reachable(_edges(manifest, conditional), start).withColumnRenamed("node", "target")


def tests_depending_on(manifest: DataFrame, target: str, conditional: bool = True) -> DataFrame:
    """Test targets that reach the target over declared dependencies."""
    start = manifest.sparkSession.createDataFrame([(target,)], "node string")
    up = graph.reachable(_edges(manifest, conditional), start, reverse=True).select(F.col("node").alias("target"))
    return up.join(targets(manifest).where("type = 'testTarget'").select("target"), "target", "left_semi")


def products_containing(manifest: DataFrame, target: str) -> DataFrame:
    p = manifest.where((F.col("kind") == "product_target") & (F.col("name") == target)).select(F.col("owner").alias("product"), "state")
    return p.distinct()


def shipped_targets(manifest: DataFrame, conditional: bool = True) -> DataFrame:
    """target: what products hold, and all that these targets depend on."""
    roots = manifest.where("kind = 'product_target' and name is not null").select(F.col("name").alias("node")).distinct()
    return graph.reachable(_edges(manifest, conditional), roots).select("node").unionByName(roots).distinct().withColumnRenamed("node", "target")
