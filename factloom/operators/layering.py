"""Layers, dependencies between groups, folder layouts and accepted baselines: checks that are joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths


@dataclass(frozen=True)
class Layer:
    """may: the only layers it may depend on; None for any that is not forbidden."""

    name: str
    files: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    may: tuple[str, ...] | None = None
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


class LayeringError(ValueError):
    pass


@dataclass(frozen=True)
class Layering:
    """Layers are a handful of declarations, checked when they are declared."""

    layers: tuple[Layer, ...]
    names: frozenset[str] = field(init=False)

    def __post_init__(self):
        names = [x.name for x in self.layers]
        if len(set(names)) < len(names):
            raise LayeringError(f"a layer is declared twice: {next(n for n in names if names.count(n) > 1)}")
        object.__setattr__(self, "names", frozenset(names))
        owners: dict[str, str] = {}
        for x in self.layers:
            for other in (*(x.may or ()), *x.required, *x.forbidden):
                if other not in self.names:
                    raise LayeringError(f"'{x.name}' names the unknown layer '{other}'")
            if both := {*(x.may or ()), *x.required} & set(x.forbidden):
                raise LayeringError(f"'{x.name}' both allows and forbids '{min(both)}'")
            for m in x.modules:
                if owners.setdefault(m, x.name) != x.name:
                    raise LayeringError(f"module '{m}' belongs to '{owners[m]}' and '{x.name}'")
        if c := self.declared_cycle():
            raise LayeringError("layers form a cycle: " + " -> ".join(c))

    def declared_cycle(self) -> list[str]:
        """The first closed path over allowed and required edges; edges of a layer to itself do not count."""
        follow = {x.name: [o for o in (*(x.may or ()), *x.required) if o != x.name] for x in self.layers}
        done: set[str] = set()
        for root in follow:
            path, todo = [root], [iter(follow[root])]
            while todo:
                for n in todo[-1]:
                    if n in path:
                        return [*path[path.index(n) :], n]
                    if n not in done:
                        path.append(n)
                        todo.append(iter(follow[n]))
                        break
                else:
                    done.add(path.pop())
                    todo.pop()
        return []

    def allows(self, src: str, dst: str) -> bool:
        x = next(y for y in self.layers if y.name == src)
        return src == dst or dst in x.required or (dst not in x.forbidden and (x.may is None or dst in x.may))

    def table(self, spark: SparkSession) -> DataFrame:
        """Every pair of layers with whether it is allowed and required: bounded by the declarations."""
        rows = [(a.name, b.name, self.allows(a.name, b.name), b.name in a.required) for a in self.layers for b in self.layers]
        return spark.createDataFrame(rows, "src string, dst string, allowed boolean, required boolean")

    def layer_of(self, path) -> "F.Column":
        """The layer of a path as one CASE; a path in several layers raises when it is met."""
        hits = F.filter(F.array(*[F.when(paths.matches_any(path, x.files), F.lit(x.name)) for x in self.layers]), lambda v: v.isNotNull())
        return F.when(F.size(hits) > 1, F.raise_error(F.concat(F.lit("a file is in several layers: "), path))).otherwise(F.try_element_at(hits, F.lit(1)))

    def owner_of(self, module) -> "F.Column":
        return F.coalesce(*[F.when(module.isin(*x.modules), F.lit(x.name)) for x in self.layers if x.modules], F.lit(None).cast("string"))


def used_edges(references: DataFrame, layering: Layering, path: str = "path", module: str = "module") -> DataFrame:
    """Each reference with its layers: src_layer of the file, dst_layer of the module; unowned ones are left out."""
    return references.withColumn("src_layer", layering.layer_of(F.col(path))).withColumn("dst_layer", layering.owner_of(F.col(module))).where("src_layer is not null and dst_layer is not null")


def layering_violations(used: DataFrame, layering: Layering) -> DataFrame:
    pairs = layering.table(used.sparkSession).where("not allowed").select(F.col("src").alias("src_layer"), F.col("dst").alias("dst_layer"))
    return used.join(pairs, ["src_layer", "dst_layer"], "left_semi")


def missing_required(used: DataFrame, layering: Layering) -> DataFrame:
    need = layering.table(used.sparkSession).where("required").select(F.col("src").alias("src_layer"), F.col("dst").alias("dst_layer"))
    return need.join(used.select("src_layer", "dst_layer").distinct(), ["src_layer", "dst_layer"], "left_anti")


def empty_layers(files: DataFrame, layering: Layering, path: str = "path") -> DataFrame:
    names = files.sparkSession.createDataFrame([(x.name,) for x in layering.layers if x.files], "layer string")
    return names.join(files.select(layering.layer_of(F.col(path)).alias("layer")).distinct(), "layer", "left_anti")


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges (src, dst) that are used and not declared; edges of a target to itself do not count."""
    return used.where("src <> dst").select("src", "dst").distinct().join(declared.select("src", "dst"), ["src", "dst"], "left_anti")


def unused(used: DataFrame, declared: DataFrame) -> DataFrame:
    return declared.select("src", "dst").distinct().join(used.select("src", "dst"), ["src", "dst"], "left_anti")


def corresponding(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a counterpart that agrees in the columns on."""
    return rows.join(others.select(*on).distinct(), list(on), "left_anti")


def folder_groups(files: DataFrame, glob: str, path: str = "path") -> DataFrame:
    """The folders above files that match a glob, each once."""
    return files.select(F.explode(paths.ancestors(F.col(path))).alias("folder")).where(paths.matches_any(F.col("folder"), [glob])).distinct()


def folder_layout(files: DataFrame, glob: str, children: Sequence[str], path: str = "path") -> DataFrame:
    """folder, child, problem ('missing' or 'unexpected'): what folders that match the glob hold against what they must."""
    spark = files.sparkSession
    dirs = files.select(F.explode(paths.ancestors(F.col(path))).alias("dir")).distinct()
    folders = dirs.where(paths.matches_any(F.col("dir"), [glob])).select(F.col("dir").alias("folder"))
    held = dirs.select(paths.parent(F.col("dir")).alias("folder"), paths.last_component(F.col("dir")).alias("child")).join(folders, "folder", "left_semi")
    wanted = folders.select("folder", F.explode(F.array(*[F.lit(c) for c in children])).alias("child"))
    missing = wanted.join(held, ["folder", "child"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = held.where(~F.col("child").isin(*children)).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def accepted(offenders: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("rule", "name", "path")) -> DataFrame:
    """Offenders that no baseline entry accepts; nulls in the keys are equal to each other."""
    return _null_safe(offenders, baseline, keys, "left_anti")


def stale(baseline: DataFrame, offenders: DataFrame, keys: Sequence[str] = ("rule", "name", "path")) -> DataFrame:
    return _null_safe(baseline, offenders, keys, "left_anti")


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, on, how)


def nearest(files: DataFrame, settings: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the setting of the nearest folder at or above it: settings has folder and any other columns.

    The folders above a path become an equi-join, so no pair of path and folder is compared. Paths without one are
    left out. Of a folder that is set twice one row holds.
    """
    up = files.select(path).distinct().withColumn("folder", F.explode(F.array_append(paths.ancestors(F.col(path)), F.lit(""))))
    values = F.struct(*[F.col(c) for c in settings.columns])
    one = settings.groupBy(F.col("folder").alias("_folder")).agg(F.max(values).alias("_setting"))
    hit = up.join(one, F.col("folder") == F.col("_folder"))
    return hit.groupBy(path).agg(F.max_by("_setting", F.length("_folder")).alias("s")).select(path, "s.*")


def language_modes(files: DataFrame, settings: DataFrame, default: str | None = None) -> DataFrame:
    """path, language_mode: of the nearest setting (folder, language_mode), else the default."""
    got = nearest(files, settings.select("folder", "language_mode")).select("path", F.col("language_mode").alias("_mode"))
    return files.select("path").distinct().join(got, "path", "left").select("path", F.coalesce("_mode", F.lit(default)).alias("language_mode"))
