"""Checks of an index: which files may refer to which, cycles between groups of files, layers by resolved references,
conformers by symbol. Symbols are resolved to files once; references are reduced to one row for each pair of files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import graph
from factloom.operators.index import any_role, definitions, file_references, has_roles
from factloom.operators.layering import Layering, layering_violations
from factloom.session import cut


def only_modules(occ: DataFrame, modules: Sequence[str] = (), units: DataFrame | None = None) -> DataFrame:
    """Occurrences of these modules, and of the files that units (main_file) compiled; without either all."""
    kept = occ.where(F.col("module").isin(*modules)) if modules else occ
    return kept.join(units.select(F.col("main_file").alias("file")).where("file is not null").distinct(), "file", "left_semi") if units is not None else kept


def check_dependencies(occ: DataFrame, sources: Sequence[str], allowed: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """References from files under sources to files that are neither allowed, nor below the same folder that a glob of
    within names: src_file, dst_file, line, col (the earliest), n.

    A file in several such folders, one inside the other, is an error, raised where it is met.
    """
    e = file_references(occ).where(paths.matches_any(F.col("src_file"), list(sources)))
    e = e.where(~paths.matches_any(F.col("dst_file"), list(allowed)))
    if not within:
        return e

    def home(path: Column) -> Column:
        hits = F.filter(paths.ancestors(path), lambda f: paths.matches_any(f, list(within)))
        return F.when(F.size(hits) > 1, F.raise_error(F.concat(F.lit("a file is in several folders: "), path))).otherwise(F.try_element_at(hits, F.lit(1)))

    return e.where(~F.coalesce(home(F.col("src_file")) == home(F.col("dst_file")), F.lit(False)))


def group_of(path: Column, groups: dict[str, Sequence[str]]) -> Column:
    """The group whose globs hold a path, null for none; a path in several groups raises."""
    hits = F.filter(F.array(*[F.when(paths.matches_any(path, list(g)), F.lit(n)) for n, g in groups.items()]), lambda v: v.isNotNull())
    return F.when(F.size(hits) > 1, F.raise_error(F.concat(F.lit("a file is in several groups: "), path))).otherwise(F.try_element_at(hits, F.lit(1)))


def first_match(path: Column, groups: dict[str, Sequence[str]], other: str | None = None) -> Column:
    """The first group, in their order, that takes a path; else other."""
    return F.coalesce(*[F.when(paths.matches_any(path, list(g)), F.lit(n)) for n, g in groups.items()], F.lit(other))


def group_edges(occ: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """src, dst, seq, src_file, dst_file, line, col: each edge between groups at its earliest reference (by file, line,
    column); seq orders edges by that place."""
    e = file_references(occ).withColumn("src", group_of(F.col("src_file"), groups)).withColumn("dst", group_of(F.col("dst_file"), groups))
    e = e.where("src is not null and dst is not null and src <> dst")
    at = F.min(F.struct("src_file", "line", "col", "dst_file"))
    g = e.groupBy("src", "dst").agg(at.alias("at"))
    return g.select("src", "dst", F.struct("at.src_file", "at.line", "at.col").alias("seq"), "at.*")


def check_cycles(occ: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One cycle between the groups, if there is one: step, src, dst and the earliest reference of each of its edges."""
    edges = cut(group_edges(occ, groups))
    ring = graph.first_cycle(edges.select("src", "dst", "seq"))
    steps = occ.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(ring, ring[1:]))], "step int, src string, dst string")
    return steps.join(edges.drop("seq"), ["src", "dst"]).select("step", "src", "dst", "src_file", "line", "col", "dst_file")


def ambiguous(occ: DataFrame) -> DataFrame:
    """usr, name, n_files: referenced symbols that several files define; checks leave them out and warn."""
    d = definitions(occ).where("usr is not null and usr <> ''").withColumn("is_def", has_roles(F.col("roles"), "definition"))
    n = d.groupBy("usr").agg(F.countDistinct(F.when(F.col("is_def"), F.col("file"))).alias("a"), F.countDistinct("file").alias("b"), F.min("name").alias("name"))
    n = n.select("usr", "name", F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("n_files")).where("n_files > 1")
    used = occ.where(has_roles(F.col("roles"), "reference")).select("usr").distinct()
    return n.join(used, "usr", "left_semi")


def indexed_layering(occ: DataFrame, layering: Layering) -> DataFrame:
    """References that a layering forbids, resolved for each module: src_layer, dst_layer, file, line, col, usr, one row
    for each symbol and file at its first place, in the order of files.

    Within the module of a reference a symbol belongs to the layer of its definitions there, if that is one.
    """
    o = occ.where("usr is not null and usr <> '' and file is not null")
    lay = o.select("file").distinct().withColumn("layer", layering.layer_of(F.col("file"))).where("layer is not null")
    lay = cut(lay)
    owner = definitions(o).select("usr", "module", "file").distinct().join(lay, "file").groupBy("usr", "module").agg(F.min("layer").alias("dst_layer"), F.max("layer").alias("hi")).where("dst_layer = hi").drop("hi")
    refs = o.where(has_roles(F.col("roles"), "reference") & ~any_role(F.col("roles"), "definition", "implicit")).groupBy("usr", "module", "file").agg(F.min(F.struct("line", "col")).alias("at"))
    own = owner.withColumnRenamed("module", "m").withColumnRenamed("usr", "u")
    used = refs.join(own, (F.col("usr") == F.col("u")) & F.col("module").eqNullSafe(F.col("m"))).join(lay.withColumnRenamed("layer", "src_layer"), "file")
    return layering_violations(used, layering).select("src_layer", "dst_layer", "file", F.col("at.line").alias("line"), F.col("at.col").alias("col"), "usr")


def conformers(relations: DataFrame, *symbols: str, direct: bool = False) -> DataFrame:
    """node, level: symbols that conform to or inherit from the given ones. relations: usr (the type) and base (what it
    names). Transitively unless direct; each symbol once, circles end."""
    e = relations.where("usr is not null and base is not null").select(F.col("base").alias("src"), F.col("usr").alias("dst")).distinct()
    roots = relations.sparkSession.createDataFrame([(s,) for s in symbols], "node string")
    if direct:
        return e.join(roots.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(1).alias("level")).distinct()
    return graph.reachable(e, roots)


def occurrences_of(occ: DataFrame, *names: str) -> DataFrame:
    """All occurrences of the symbols of these names, also under other spellings."""
    return occ.join(occ.where(F.col("name").isin(*names)).select("usr").where("usr is not null and usr <> ''").distinct(), "usr", "left_semi")


def index_query(occ: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """occurrences_of and a warning row for each name that no symbol has."""
    wanted = occ.sparkSession.createDataFrame([(n,) for n in names], "name string")
    unknown = wanted.join(occ.select("name").distinct(), "name", "left_anti")
    return occurrences_of(occ, *names), unknown.select(F.concat(F.lit("the index has no symbol named '"), "name", F.lit("'")).alias("message"))


def is_type(kind: Column) -> Column:
    """Kinds of symbols that are types."""
    return reduce(lambda a, b: a | b, [kind == k for k in ("class", "struct", "enum", "protocol", "actor", "typealias", "extension")])
