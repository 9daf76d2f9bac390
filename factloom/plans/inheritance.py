"""Class hierarchies from type declarations: newest states, superclass names resolved, full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.literals import without_generics
from factloom.operators import matcher
from factloom.operators.hierarchy import cyclic_ancestors, hierarchy, with_descendants
from factloom.session import table

_BEFORE = r"^(?:@[\p{L}_][\p{L}\p{N}_.]*(?:\([^)]*\))?\s+)+"


def plain_entry(entry):
    """An inheritance entry without attributes, generic arguments and outer spaces."""
    e = F.regexp_replace(F.trim(F.regexp_replace(entry, r"[\s ]+", " ")), _BEFORE, "")
    e = without_generics(e)
    return F.trim(F.regexp_replace(e, r"\s*\.\s*", "."))


def newest_types(types: DataFrame) -> DataFrame:
    """One row for each type_id: the state with the greatest observed_at (missing first), then received_at."""
    state = F.struct("module", "qualified_name", "name", "keyword", "inherited")
    when = F.struct(F.col("observed_at"), F.col("received_at"), F.xxhash64("module", "qualified_name", "name", "keyword", "inherited"))
    return types.where("type_id is not null").groupBy("type_id").agg(F.max_by(state, when).alias("s")).select("type_id", "s.*")


def superclass_links(types: DataFrame) -> DataFrame:
    """node, parent: each class and its superclass, the first entry that names a class.

    An entry names a class by qualified_name in its own module, else by module.qualified_name in any. Two equi joins,
    each on (module, qualified_name); heavy names (protocols) are no class and drop out, AQE splits their partition.
    """
    newest = newest_types(types).where("keyword = 'class'")
    classes = newest.where("module is not null and qualified_name is not null").groupBy("module", "qualified_name").agg(F.min("type_id").alias("parent"))
    entries = newest.select("type_id", "module", F.posexplode("inherited").alias("at", "entry")).withColumn("entry", plain_entry("entry")).where("entry <> ''")
    own = entries.select("type_id", "at", F.lit(0).alias("rank"), "module", F.col("entry").alias("qualified_name"))
    other = entries.where("contains(entry, '.')").select(
        "type_id", "at", F.lit(1).alias("rank"), F.substring_index("entry", ".", 1).alias("module"), F.expr("substring(entry, locate('.', entry) + 1)").alias("qualified_name")
    )
    hits = own.unionByName(other).join(classes, ["module", "qualified_name"])
    return hits.groupBy(F.col("type_id").alias("node")).agg(F.min_by("parent", F.struct("at", "rank")).alias("parent"))


def class_hierarchy(spark, sf_dir: str) -> DataFrame:
    return hierarchy(superclass_links(table(spark, sf_dir, "type_decls")))


def p4_found(spark, sf_dir: str) -> DataFrame:
    t = class_hierarchy(spark, sf_dir).where("parent is not null")
    tree = F.col("state") == "tree"
    return t.select(
        F.col("node").alias("type_id"), F.when(tree, F.col("root")).otherwise(F.lit(-1)).cast("bigint").alias("root_id"), F.when(tree, F.col("depth")).otherwise(F.lit(-1)).cast("bigint").alias("depth")
    )


def p4_paths(spark, sf_dir: str) -> DataFrame:
    """Every class with a superclass or subclasses: path of names from the root, state, and size and height below it."""
    types = table(spark, sf_dir, "type_decls")
    names = newest_types(types).select(F.col("type_id").alias("id"), F.concat_ws(".", "module", "qualified_name").alias("label"))
    tree = hierarchy(superclass_links(types), paths=True)
    steps = tree.select("node", F.posexplode_outer("path").alias("at", "id")).join(names, "id", "left")
    paths = steps.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " > ").alias("path"))
    known = lambda c: F.when(F.col("state") == "tree", F.col(c)).alias(c)
    return tree.drop("path").join(paths, "node").select(F.col("node").alias("type_id"), "parent", "root", "depth", "state", known("path"), known("n_descendants"), known("height"))


def p4_descendants(spark, sf_dir: str) -> DataFrame:
    return with_descendants(superclass_links(table(spark, sf_dir, "type_decls")))[1]


def inherited_names(types: DataFrame) -> DataFrame:
    """node, name, level: what a type inherits, its own entries at level 0, those of its superclasses above.

    Superclass chains come from hierarchy(), so their length costs no rounds; the entries of each ancestor are joined
    once. On or below a cycle each superclass counts once, where the walk up meets it first.
    """
    newest = newest_types(types)
    entries = newest.select(F.col("type_id").alias("ancestor"), F.explode("inherited").alias("entry")).select("ancestor", plain_entry("entry").alias("name")).where("name <> ''").distinct()
    tree, lists = with_descendants(superclass_links(types))
    up = lists.select("ancestor", F.col("descendant").alias("node"), "distance").unionByName(cyclic_ancestors(tree)).withColumnRenamed("distance", "level")
    own = newest.select(F.col("type_id").alias("ancestor"), F.col("type_id").alias("node"), F.lit(0).alias("level"))
    return up.unionByName(own).join(entries, "ancestor").groupBy("node", "name").agg(F.min("level").alias("level"))


def with_closure(types: DataFrame) -> DataFrame:
    """The newest types with all_inherited, the names nearest first; for the matchers inherits and conforms."""
    names = inherited_names(types).groupBy(F.col("node").alias("type_id")).agg(F.array_sort(F.collect_list(F.struct("level", "name"))).alias("n"))
    return newest_types(types).join(names, "type_id", "left").select("*", F.coalesce(F.transform("n", lambda x: x["name"]), F.array().cast("array<string>")).alias("all_inherited")).drop("n")


def inheritance_closure(spark, sf_dir: str) -> DataFrame:
    return inherited_names(table(spark, sf_dir, "type_decls"))


def conformers(spark, sf_dir: str) -> DataFrame:
    """Types that conform to Codable themselves or through a superclass."""
    t = with_closure(table(spark, sf_dir, "type_decls"))
    return t.where(matcher.conforms("Codable").ok()).select("type_id", "module", "qualified_name")
