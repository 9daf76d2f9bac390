"""Queries of package checks and index checks over the Swift files and the symbol index."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import dependencies, layering, packages
from factloom.plans.facts import code_facts
from factloom.plans.relations import WALK_SQL
from factloom.session import table
from factloom.sources.declarations import view
from factloom.sources.manifest import SCHEMA

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _swift(spark, d):
    return table(spark, d, "source_files").where("lang = 'swift' and path is not null")


def _manifest(spark, d):
    """A manifest with a target for each folder below Sources, all of which depend on the first and the last of them and on
    a target without files; a product of the last, and tests of the first."""
    m = _swift(spark, d).where(F.col("path").rlike("^Sources/[^/]+/")).select(F.regexp_extract("path", "^Sources/([^/]+)/", 1).alias("name")).distinct()
    ends = m.agg(F.min("name").alias("a"), F.max("name").alias("b")).first()
    n = lambda c: F.lit(None).cast("string").alias(c)
    row = lambda kind, name, type_, owner, value: (F.lit("Package.swift").alias("path"), F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"), owner.alias("owner"), value.alias("value"), n("requirement"), F.lit(0).alias("position"), F.lit("known").alias("state"))
    null = F.lit(None).cast("string")
    t = m.select(*row("target", F.col("name"), F.lit("target"), null, F.concat(F.lit("Sources/"), F.col("name"))))
    deps = m.select("name", F.explode(F.array(F.lit(ends["a"]), F.lit(ends["b"]), F.lit("Ghost"))).alias("dep")).where("name <> dep").distinct().select(*row("target_dependency", F.col("dep"), F.lit("byName"), F.col("name"), null))
    more = [
        ("Package.swift", "target", "Ghost", "target", None, "Sources/Ghost", None, 1, "known"), ("Package.swift", "target", "AllTests", "testTarget", None, "Tests/AllTests", None, 2, "known"),
        ("Package.swift", "target_dependency", ends["a"], "target", "AllTests", None, None, 3, "known"), ("Package.swift", "product_target", ends["b"], None, "Kit", None, None, 4, "known"),
    ]
    return t.unionByName(deps).unionByName(spark.createDataFrame(more, SCHEMA))


def _imports(spark, d):
    return view(code_facts(spark, d), "import").select("path", F.substring_index("name", ".", 1).alias("module"), "line", "col")


_PACKAGE = r"""
m AS (SELECT DISTINCT regexp_extract(path, '^Sources/([^/]+)/', 1) AS t FROM source_files WHERE lang = 'swift' AND regexp_matches(path, '^Sources/[^/]+/')),
dep AS (SELECT DISTINCT src, dst FROM (SELECT t AS src, unnest([(SELECT min(t) FROM m), (SELECT max(t) FROM m), 'Ghost']) AS dst FROM m UNION ALL SELECT 'AllTests', min(t) FROM m) WHERE src <> dst),
imp AS (SELECT regexp_extract(path, '^Sources/([^/]+)/', 1) AS t, path, unnest(regexp_extract_all(text, '(?m)(?:^|\r|\x{FEFF})\s*(?:@testable )?import (\w+)', 1)) AS module FROM (SELECT DISTINCT path, text FROM source_files WHERE lang = 'swift')),
used AS (SELECT * FROM imp WHERE t IN (SELECT t FROM m) AND module IN (SELECT t FROM m) AND module <> t)"""


@query(f"WITH {_PACKAGE} SELECT t AS target, module, count(DISTINCT path) AS n_files FROM used WHERE (t, module) NOT IN (SELECT src, dst FROM dep) GROUP BY ALL")
def package_undeclared(spark, d):
    found = packages.check_dependencies(_manifest(spark, d), _swift(spark, d), _imports(spark, d))[0]
    return found.groupBy("target", "module").agg(F.countDistinct("path").alias("n_files"))


@query(f"WITH {_PACKAGE} SELECT src AS target, dst AS dependency FROM dep WHERE src IN (SELECT t FROM m) EXCEPT SELECT t, module FROM used")
def package_unused(spark, d):
    return packages.check_dependencies(_manifest(spark, d), _swift(spark, d), _imports(spark, d))[1]


@query("SELECT 'Ghost' AS target UNION ALL SELECT 'AllTests' WHERE NOT EXISTS (SELECT 1 FROM source_files WHERE lang = 'swift' AND starts_with(path, 'Tests/AllTests/'))")
def package_empty(spark, d):
    return packages.check_dependencies(_manifest(spark, d), _swift(spark, d), _imports(spark, d))[2]


@query(f"WITH {_PACKAGE} SELECT t AS src, module AS dst, min(path) AS path FROM used GROUP BY ALL")
def package_edges(spark, d):
    return packages.package_edges(_manifest(spark, d), _swift(spark, d), _imports(spark, d)).select("src", "dst", "path")


@query("SELECT regexp_extract(path, '^Sources/([^/]+)/', 1) AS target, count(DISTINCT path) AS n_files FROM source_files WHERE lang = 'swift' AND regexp_matches(path, '^Sources/[^/]+/') GROUP BY 1")
def package_target_files(spark, d):
    return packages.target_files(_manifest(spark, d), _swift(spark, d)).groupBy("target").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH RECURSIVE {_PACKAGE}, r AS (SELECT dst FROM dep WHERE src = (SELECT min(t) FROM m) UNION SELECT dep.dst FROM r JOIN dep ON dep.src = r.dst) SELECT dst AS target FROM r WHERE dst <> (SELECT min(t) FROM m)")
def package_transitive(spark, d):
    m = _manifest(spark, d)
    first = packages.targets(m).where("type = 'target' and target <> 'Ghost'").agg(F.min("target")).first()[0]
    return packages.transitive_dependencies(m, first).select("target")


@query(f"WITH RECURSIVE {_PACKAGE}, r AS (SELECT max(t) AS dst FROM m UNION SELECT dep.dst FROM r JOIN dep ON dep.src = r.dst) SELECT dst AS target FROM r")
def package_shipped(spark, d):
    return packages.shipped_targets(_manifest(spark, d))


@query("SELECT 'AllTests' AS target")
def package_tests_of(spark, d):
    m = _manifest(spark, d)
    first = packages.targets(m).where("type = 'target' and target <> 'Ghost'").agg(F.min("target")).first()[0]
    return packages.tests_depending_on(m, first)


# The index.

_INDEX = """o AS (SELECT * FROM occurrences WHERE usr IS NOT NULL AND usr <> ''),
df AS (SELECT usr, max(roles & 2) = 2 AS has_def, min(file) FILTER (WHERE roles & 2 = 2) AS a, max(file) FILTER (WHERE roles & 2 = 2) AS b, min(file) AS c, max(file) AS d FROM o WHERE roles & 3 <> 0 GROUP BY usr),
ff AS (SELECT usr, CASE WHEN has_def THEN a ELSE c END AS lo, CASE WHEN has_def THEN b ELSE d END AS hi FROM df),
rr AS (SELECT DISTINCT usr, file, line, col FROM o WHERE roles & 4 = 4 AND roles & 258 = 0 AND file IS NOT NULL),
fr AS (SELECT rr.file AS src_file, lo AS dst_file, min((line, col)) AS place, count(*) AS n FROM rr JOIN ff USING (usr) WHERE lo = hi AND rr.file <> lo GROUP BY 1, 2)"""


@query(
    rf"""WITH {_INDEX} SELECT src_file, dst_file, struct_extract_at(place, 1) AS line, struct_extract_at(place, 2) AS col, n FROM fr WHERE regexp_matches(src_file, '^Sources/[^/]+/Views/')
    AND NOT regexp_matches(dst_file, '^Sources/[^/]+/Models/') AND regexp_extract(src_file, '^(Sources/[^/]+)/', 1) <> regexp_extract(dst_file, '^(Sources/[^/]+)/', 1)"""
)
def dependency_check(spark, d):
    """Views may refer to models, and to what lies in their own module."""
    return dependencies.check_dependencies(table(spark, d, "occurrences"), ["Sources/*/Views/**"], ["Sources/*/Models/**"], ["Sources/*"])


_GROUPS = {"views": ["Sources/*/Views/**"], "models": ["Sources/*/Models/**"], "loading": ["Sources/*/Loading/**"], "sync": ["Sources/*/Sync/**"]}
_GROUP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(@, '^Sources/[^/]+/{f}/') THEN '{n}'" for n, f in (("views", "Views"), ("models", "Models"), ("loading", "Loading"), ("sync", "Sync"))) + " END"


@query(
    f"""WITH {_INDEX}, g AS (SELECT {_GROUP_SQL.replace('@', 'src_file')} AS src, {_GROUP_SQL.replace('@', 'dst_file')} AS dst, src_file, dst_file, place FROM fr),
    f AS (SELECT src, dst, min((src_file, struct_extract_at(place, 1), struct_extract_at(place, 2), dst_file)) AS x FROM g WHERE src <> dst GROUP BY 1, 2)
    SELECT src, dst, struct_extract_at(x, 1) AS src_file, struct_extract_at(x, 2) AS line, struct_extract_at(x, 3) AS col, struct_extract_at(x, 4) AS dst_file FROM f"""
)
def dependency_group_edges(spark, d):
    return dependencies.group_edges(table(spark, d, "occurrences"), _GROUPS).drop("seq")


@query(
    f"""WITH RECURSIVE {_INDEX}, g AS (SELECT {_GROUP_SQL.replace('@', 'src_file')} AS src, {_GROUP_SQL.replace('@', 'dst_file')} AS dst, src_file, dst_file, place FROM fr),
    f AS (SELECT src, dst, min((src_file, struct_extract_at(place, 1), struct_extract_at(place, 2), dst_file)) AS x FROM g WHERE src <> dst GROUP BY 1, 2),
    e AS (SELECT src, dst, x, (struct_extract_at(x, 1), struct_extract_at(x, 2), struct_extract_at(x, 3), src, dst) AS k FROM f), {WALK_SQL}, st AS (SELECT generate_subscripts(c, 1) AS i, unnest(c) AS node FROM cy)
    SELECT CAST(a.i - 1 AS INT) AS step, e.src, e.dst, struct_extract_at(x, 1) AS src_file, struct_extract_at(x, 2) AS line, struct_extract_at(x, 3) AS col, struct_extract_at(x, 4) AS dst_file FROM st a JOIN st b ON b.i = a.i + 1 JOIN e ON e.src = a.node AND e.dst = b.node"""
)
def dependency_cycle(spark, d):
    return dependencies.check_cycles(table(spark, d, "occurrences"), _GROUPS)


@query(
    """WITH o AS (SELECT * FROM occurrences WHERE usr IS NOT NULL AND usr <> ''), n AS (SELECT usr, min(name) AS name, count(DISTINCT file) FILTER (WHERE roles & 2 = 2) AS a, count(DISTINCT file) AS b FROM o WHERE roles & 3 <> 0 GROUP BY usr)
    SELECT usr, name, CASE WHEN a > 0 THEN a ELSE b END AS n_files FROM n WHERE CASE WHEN a > 0 THEN a ELSE b END > 1 AND usr IN (SELECT usr FROM o WHERE roles & 4 = 4)"""
)
def ambiguous_symbols(spark, d):
    return dependencies.ambiguous(table(spark, d, "occurrences"))


_LAYERS = layering.Layering((layering.Layer("models", ("Sources/*/Models/**",), may=()), layering.Layer("views", ("Sources/*/Views/**",), may=("models",)), layering.Layer("sync", ("Sources/*/Sync/**",), forbidden=("views",))))
_LAYER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(file, '^Sources/[^/]+/{f}/') THEN '{n}'" for n, f in (("models", "Models"), ("views", "Views"), ("sync", "Sync"))) + " END"


@query(
    f"""WITH o AS (SELECT *, {_LAYER_SQL} AS layer FROM occurrences WHERE usr IS NOT NULL AND usr <> '' AND file IS NOT NULL),
    w AS (SELECT usr, module, min(layer) AS dst_layer FROM o WHERE roles & 3 <> 0 AND layer IS NOT NULL GROUP BY usr, module HAVING min(layer) = max(layer)),
    r AS (SELECT usr, module, file, layer AS src_layer, min((line, col)) AS place FROM o WHERE roles & 4 = 4 AND roles & 258 = 0 AND layer IS NOT NULL GROUP BY ALL)
    SELECT src_layer, dst_layer, file, struct_extract_at(place, 1) AS line, struct_extract_at(place, 2) AS col, r.usr FROM r JOIN w ON w.usr = r.usr AND w.module IS NOT DISTINCT FROM r.module
    WHERE (src_layer, dst_layer) IN (('models', 'views'), ('models', 'sync'), ('views', 'sync'), ('sync', 'views'))"""
)
def indexed_layering(spark, d):
    return dependencies.indexed_layering(table(spark, d, "occurrences"), _LAYERS)


@query("WITH RECURSIVE e AS (SELECT DISTINCT qualified_name AS usr, unnest(inherited) AS base FROM type_decls), r AS (SELECT usr FROM e WHERE base = 'Codable' UNION SELECT e.usr FROM r JOIN e ON e.base = r.usr) SELECT usr AS node FROM r WHERE usr <> 'Codable'")
def symbol_conformers(spark, d):
    rel = table(spark, d, "type_decls").select(F.col("qualified_name").alias("usr"), F.explode("inherited").alias("base"))
    return dependencies.conformers(rel, "Codable").select("node")


@query("SELECT DISTINCT qualified_name AS node FROM (SELECT qualified_name, unnest(inherited) AS base FROM type_decls) WHERE base = 'Codable'")
def symbol_direct_conformers(spark, d):
    rel = table(spark, d, "type_decls").select(F.col("qualified_name").alias("usr"), F.explode("inherited").alias("base"))
    return dependencies.conformers(rel, "Codable", direct=True).select("node")


@query("SELECT usr, name, kind, module, file, line, col, roles FROM occurrences WHERE usr IN (SELECT usr FROM occurrences WHERE name = 'Loadable' AND usr <> '')")
def occurrences_of(spark, d):
    return dependencies.occurrences_of(table(spark, d, "occurrences"), "Loadable").drop("recorded_at", "received_at")


@query("SELECT 'the index has no symbol named ''NoSuchSymbol''' AS message")
def index_query_warnings(spark, d):
    return dependencies.index_query(table(spark, d, "occurrences"), "Loadable", "NoSuchSymbol")[1]
