"""Queries of the join, graph, window, index, streaming, edit and report operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import edits, graph, index, layering, report, sequences
from factloom.session import table
from factloom.streaming import editor

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Joins.


@query(
    """SELECT type_id, observed_at, module, name FROM type_decls t WHERE keyword = 'class' AND name LIKE '%ViewModel'
    AND NOT EXISTS (SELECT 1 FROM type_decls p WHERE p.module = t.module AND p.name = replace(t.name, 'ViewModel', 'Screen'))"""
)
def corresponding_types(spark, d):
    t = table(spark, d, "type_decls")
    rows = t.where("keyword = 'class'").where(F.col("name").endswith("ViewModel")).withColumn("screen", F.replace("name", F.lit("ViewModel"), F.lit("Screen")))
    return layering.corresponding(rows, t.select("module", F.col("name").alias("screen")), ["module", "screen"]).select("type_id", "observed_at", "module", "name")


@query(
    r"""WITH t AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM type_decls WHERE path IS NOT NULL) SELECT type_id, observed_at, folder FROM t WHERE name LIKE '%Loader'
    AND NOT EXISTS (SELECT 1 FROM t p WHERE p.folder = t.folder AND p.name LIKE '%Kind' AND left(p.name, 4) = left(t.name, 4))"""
)
def corresponding_in_group(spark, d):
    """Loaders without a kind in their folder whose name begins alike."""
    t = table(spark, d, "type_decls").where("path is not null").withColumn("folder", paths.parent(F.col("path"))).withColumn("start", F.substring("name", 1, 4))
    rows, others = t.where(F.col("name").endswith("Loader")), t.where(F.col("name").endswith("Kind")).select("folder", "start")
    return layering.corresponding(rows, others, ["folder", "start"]).select("type_id", "observed_at", "folder")


@query(
    """SELECT t.type_id, count(f.name) AS n_functions FROM (SELECT DISTINCT type_id, path, qualified_name FROM type_decls) t
    LEFT JOIN (SELECT DISTINCT path, enclosing, seq, name FROM function_decls WHERE path IS NOT NULL) f ON f.path = t.path AND f.enclosing = t.qualified_name GROUP BY t.type_id"""
)
def members_join(spark, d):
    t = table(spark, d, "type_decls").select("type_id", "path", F.col("qualified_name").alias("enclosing")).distinct()
    f = table(spark, d, "function_decls").where("path is not null").select("path", "enclosing", "seq", "name").distinct()
    return t.join(f, ["path", "enclosing"], "left").groupBy("type_id").agg(F.count("name").alias("n_functions"))


_LAYERS = layering.Layering(
    (
        layering.Layer("data", ("Sources/*/Models/**", "Sources/*/Loading/**"), ("data",), may=()),
        layering.Layer("logic", ("Sources/*/Sync/**", "Sources/*/Flow/**"), ("logic",), may=("data",)),
        layering.Layer("views", ("Sources/*/Views/**", "Sources/*/Screens/**"), ("views",), may=("logic",), required=("logic",)),
    )
)
_USED_SQL = """
WITH o AS (SELECT usr, file, roles FROM occurrences WHERE usr IS NOT NULL AND usr <> '' AND file IS NOT NULL),
lay AS (SELECT DISTINCT file, CASE WHEN regexp_matches(file, '^Sources/[^/]+/(Models|Loading)/') THEN 'data' WHEN regexp_matches(file, '^Sources/[^/]+/(Sync|Flow)/') THEN 'logic'
  WHEN regexp_matches(file, '^Sources/[^/]+/(Views|Screens)/') THEN 'views' END AS layer FROM o),
owner AS (SELECT usr, min(layer) AS dst FROM o JOIN lay USING (file) WHERE roles & 3 <> 0 GROUP BY usr HAVING count(DISTINCT layer) = 1),
used AS (SELECT layer AS src, dst, count(DISTINCT (usr, file)) AS n FROM o JOIN lay USING (file) JOIN owner USING (usr) WHERE roles & 4 <> 0 AND layer IS NOT NULL GROUP BY 1, 2)"""


def _used(spark, d):
    """References between layers: a symbol belongs to the layer of its definitions, if that is one."""
    o = table(spark, d, "occurrences").where("usr is not null and usr <> '' and file is not null")
    lay = o.select("file").distinct().withColumn("layer", _LAYERS.layer_of(F.col("file")))
    owner = index.definitions(o).select("usr", "file").distinct().join(lay, "file").groupBy("usr").agg(F.min("layer").alias("dst_layer"), F.countDistinct("layer").alias("n")).where("n = 1").drop("n")
    refs = o.where(index.has_roles(F.col("roles"), "reference")).select("usr", "file").distinct().join(lay, "file").where("layer is not null")
    return refs.join(owner, "usr").groupBy(F.col("layer").alias("src_layer"), "dst_layer").agg(F.count(F.lit(1)).alias("n"))


@query(_USED_SQL + " SELECT src AS src_layer, dst AS dst_layer, n FROM used WHERE NOT (src = dst OR (src, dst) IN (('logic', 'data'), ('views', 'logic')))")
def layering_check(spark, d):
    return layering.layering_violations(_used(spark, d), _LAYERS).select("src_layer", "dst_layer", "n")


_MORE_LAYERS = layering.Layering(
    (
        layering.Layer("data", ("Sources/*/Models/**", "Sources/*/Loading/**"), may=()),
        layering.Layer("logic", ("Sources/*/Sync/**", "Sources/*/Flow/**"), required=("data",)),
        layering.Layer("views", ("Sources/*/Views/**", "Sources/*/Screens/**"), required=("logic", "storage")),
        layering.Layer("storage", ("Sources/*/NoSuchFolder/**",)),
    )
)


@query(_USED_SQL + " SELECT src_layer, dst_layer FROM (VALUES ('views', 'logic'), ('views', 'storage'), ('logic', 'data')) n(src_layer, dst_layer) WHERE NOT EXISTS (SELECT 1 FROM used WHERE src = src_layer AND dst = dst_layer)")
def layering_missing_required(spark, d):
    return layering.missing_required(_used(spark, d), _MORE_LAYERS)


@query("SELECT x.layer FROM (VALUES ('data', '(Models|Loading)'), ('logic', '(Sync|Flow)'), ('views', '(Views|Screens)'), ('storage', 'NoSuchFolder')) x(layer, p) WHERE NOT EXISTS (SELECT 1 FROM source_files WHERE regexp_matches(path, '^Sources/[^/]+/' || p || '/'))")
def layering_empty(spark, d):
    return layering.empty_layers(table(spark, d, "source_files").where("path is not null"), _MORE_LAYERS)


@query(
    r"""WITH m AS (SELECT DISTINCT regexp_extract(path, '^(Sources/[^/]+)/', 1) AS folder FROM source_files WHERE regexp_matches(path, '^Sources/[^/]+/')),
    held AS (SELECT DISTINCT regexp_extract(path, '^(Sources/[^/]+)/[^/]+/', 1) AS folder, regexp_extract(path, '^Sources/[^/]+/([^/]+)/', 1) AS child FROM source_files WHERE regexp_matches(path, '^Sources/[^/]+/[^/]+/')),
    want AS (SELECT folder, child FROM m CROSS JOIN (VALUES ('Views'), ('Models'), ('Search')) w(child))
    SELECT folder, child, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM held) UNION ALL SELECT folder, child, 'unexpected' FROM held WHERE child NOT IN ('Views', 'Models', 'Search')"""
)
def folder_layout(spark, d):
    return layering.folder_layout(table(spark, d, "source_files").where("path is not null"), "Sources/*", ["Views", "Models", "Search"])


@query(r"SELECT DISTINCT regexp_extract(path, '^(Sources/[^/]+/[^/]+)/', 1) AS folder FROM source_files WHERE regexp_matches(path, '^Sources/[^/]+/[^/]+/')")
def folder_groups(spark, d):
    return layering.folder_groups(table(spark, d, "source_files").where("path is not null"), "Sources/*/*")


def _offenders(spark, d):
    t = table(spark, d, "parse_diagnostics")
    return t.select(F.col("message").alias("rule"), F.col("swift_language_mode").alias("name"), "path")


@query("SELECT message AS rule, swift_language_mode AS name, path FROM parse_diagnostics p WHERE NOT EXISTS (SELECT 1 FROM parse_diagnostics b WHERE b.line < 20 AND b.message IS NOT DISTINCT FROM p.message AND b.swift_language_mode IS NOT DISTINCT FROM p.swift_language_mode AND b.path IS NOT DISTINCT FROM p.path)")
def baseline_accepted(spark, d):
    b = table(spark, d, "parse_diagnostics").where("line < 20").select(F.col("message").alias("rule"), F.col("swift_language_mode").alias("name"), "path")
    return layering.accepted(_offenders(spark, d), b)


@query("SELECT DISTINCT message AS rule, path FROM parse_diagnostics WHERE message IS NOT NULL AND path IS NOT NULL AND line < 20 EXCEPT SELECT message, path FROM parse_diagnostics WHERE line >= 20")
def baseline_stale(spark, d):
    """Entries of a baseline, the findings of the first lines, that no finding of the others matches."""
    p = table(spark, d, "parse_diagnostics").select(F.col("message").alias("rule"), "path", "line")
    base = p.where("rule is not null and path is not null and line < 20").drop("line").distinct()
    return layering.stale(base, p.where("line >= 20"), ["rule", "path"])


# Graphs.

def _module_edges(spark, d):
    """Modules whose files refer to symbols that one other module defines."""
    o = table(spark, d, "occurrences").where("usr is not null and usr <> '' and module is not null")
    owner = index.definitions(o).groupBy("usr").agg(F.min("module").alias("dst"), F.max("module").alias("hi")).where("dst = hi").drop("hi")
    refs = o.where(index.has_roles(F.col("roles"), "reference")).select("usr", "module").distinct()
    return graph.edges(refs.join(owner, "usr").where("module <> dst"), "module", "dst")


_MODULES_SQL = """o AS (SELECT * FROM occurrences WHERE usr IS NOT NULL AND usr <> '' AND module IS NOT NULL),
w AS (SELECT usr, min(module) AS dst FROM o WHERE roles & 3 <> 0 GROUP BY usr HAVING min(module) = max(module)),
e AS (SELECT DISTINCT o.module AS src, w.dst FROM o JOIN w USING (usr) WHERE roles & 4 = 4 AND o.module <> w.dst)"""


@query(f"WITH {_MODULES_SQL} SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def import_graph_degrees(spark, d):
    return graph.degrees(_module_edges(spark, d))


_INSTABILITY_SQL = "i AS (SELECT node, sum(o) / CAST(count(*) AS DOUBLE) AS v FROM (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node)"


@query(f"WITH {_MODULES_SQL}, {_INSTABILITY_SQL} SELECT node, v AS instability FROM i")
def instability(spark, d):
    return graph.instability(_module_edges(spark, d)).select("node", "instability")


_INDEX_SQL = """o AS (SELECT * FROM occurrences WHERE usr IS NOT NULL AND usr <> ''),
df AS (SELECT usr, max(roles & 2) = 2 AS has_def, min(file) FILTER (WHERE roles & 2 = 2) AS a, max(file) FILTER (WHERE roles & 2 = 2) AS b, min(file) AS c, max(file) AS d FROM o WHERE roles & 3 <> 0 GROUP BY usr),
ff AS (SELECT usr, CASE WHEN has_def THEN a ELSE c END AS lo, CASE WHEN has_def THEN b ELSE d END AS hi FROM df),
r AS (SELECT DISTINCT usr, file, line, col FROM o WHERE roles & 4 = 4 AND roles & 258 = 0 AND file IS NOT NULL),
fr AS (SELECT r.file AS src_file, lo AS dst_file, min((line, col)) AS at, count(*) AS n FROM r JOIN ff USING (usr) WHERE lo = hi AND r.file <> lo GROUP BY 1, 2)"""


@query(f"WITH {_INDEX_SQL} SELECT src_file, dst_file, at[1] AS line, at[2] AS col, n FROM fr".replace("at[1]", "struct_extract_at(at, 1)").replace("at[2]", "struct_extract_at(at, 2)").replace("AS at", "AS at_").replace("(at,", "(at_,"))
def file_references(spark, d):
    return index.file_references(table(spark, d, "occurrences"))


@query(f"WITH {_INDEX_SQL}, e AS (SELECT src_file AS src, dst_file AS dst FROM fr), {_INSTABILITY_SQL} SELECT src, dst, a.v AS src_instability, b.v AS dst_instability FROM e JOIN i a ON a.node = src JOIN i b ON b.node = dst WHERE a.v < b.v".replace("AS at", "AS at_"))
def stability_check(spark, d):
    """References from a more stable file to a less stable one."""
    e = index.file_references(table(spark, d, "occurrences")).select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), F.lit(0).alias("seq"))
    return graph.unstable_edges(e)


@query(f"WITH {_INDEX_SQL} SELECT usr, lo <> hi AS ambiguous FROM ff".replace("AS at", "AS at_"))
def definition_files(spark, d):
    return index.definition_files(table(spark, d, "occurrences")).select("usr", "ambiguous")


@query("SELECT usr, name, kind, module, file, line, col, roles, recorded_at FROM occurrences WHERE roles & 4 = 4 AND roles & 2 = 0 AND usr IN (SELECT usr FROM occurrences WHERE name IN ('note(_:)', 'Loadable'))")
def references_to(spark, d):
    return index.references_to(table(spark, d, "occurrences"), "note(_:)", "Loadable").drop("received_at")


@query("SELECT DISTINCT usr, module FROM occurrences WHERE roles & 3 <> 0")
def modules_defining(spark, d):
    return index.definitions(table(spark, d, "occurrences")).select("usr", "module").distinct()


@query("SELECT module_name, main_file, count(DISTINCT output_file) AS n_outputs FROM index_units GROUP BY 1, 2 HAVING count(DISTINCT output_file) > 1")
def mixed_configurations(spark, d):
    return index.mixed_configurations(table(spark, d, "index_units"))


@query("SELECT roles & 4 <> 0 AS is_reference, roles & 32 <> 0 AS is_call, roles & 36 = 36 AS is_called_reference, count(*) AS n FROM occurrences GROUP BY ALL")
def role_bits(spark, d):
    r = F.col("roles")
    return table(spark, d, "occurrences").groupBy(index.any_role(r, "reference").alias("is_reference"), index.any_role(r, "call").alias("is_call"), index.has_roles(r, "reference", "call").alias("is_called_reference")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_MODULES_SQL}, r AS (SELECT dst AS node FROM e WHERE src = (SELECT min(src) FROM e) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT node FROM r WHERE node <> (SELECT min(src) FROM e)")
def reachable(spark, d):
    e = _module_edges(spark, d)
    root = e.agg(F.min("src").alias("node"))
    return graph.reachable(e, root).select("node")


@query(
    f"""WITH RECURSIVE {_MODULES_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), ring AS (SELECT src AS node FROM r WHERE src = dst),
    held AS ((SELECT src AS node FROM r WHERE dst IN (FROM ring) UNION FROM ring) INTERSECT (SELECT dst FROM r WHERE src IN (FROM ring) UNION FROM ring)) SELECT src, dst FROM e WHERE src IN (FROM held) AND dst IN (FROM held)"""
)
def acyclic_core(spark, d):
    """Edges that may lie on a cycle: what is left without nodes that no edge enters or leaves."""
    return graph.trimmed(_module_edges(spark, d)).select("src", "dst")


#: From edges e (src, dst, k: their order): the walk over first edges to nodes that lead to a cycle, from the first such
#: node; its last node closes the cycle.
WALK_SQL = """rc AS (SELECT src, dst FROM e UNION SELECT rc.src, e.dst FROM rc JOIN e ON e.src = rc.dst), ri AS (SELECT src AS node FROM rc WHERE src = dst),
lv AS (SELECT src AS node FROM rc WHERE dst IN (FROM ri) UNION FROM ri), fe AS (SELECT src, arg_min(dst, k) AS nx FROM e WHERE dst IN (FROM lv) GROUP BY src),
sn AS (SELECT arg_min(node, (k, i)) AS node FROM (SELECT src AS node, k, 0 AS i FROM e UNION ALL SELECT dst, k, 1 FROM e) WHERE node IN (FROM lv)),
wk AS (SELECT node, [node] AS path, false AS done FROM sn WHERE node IS NOT NULL UNION ALL SELECT fe.nx, list_append(path, fe.nx), list_contains(path, fe.nx) FROM wk JOIN fe ON fe.src = wk.node WHERE NOT done),
cy AS (SELECT path[list_position(path, node):] AS c FROM wk WHERE done)"""


@query(f"WITH RECURSIVE {_MODULES_SQL.replace('SELECT DISTINCT o.module AS src, w.dst FROM', 'SELECT DISTINCT o.module AS src, w.dst, (o.module, w.dst) AS k FROM')}, {WALK_SQL} SELECT CAST(generate_subscripts(c, 1) - 1 AS INT) AS step, unnest(c) AS module FROM cy")
def first_cycle(spark, d):
    c = graph.first_cycle(_module_edges(spark, d))
    return spark.createDataFrame(list(enumerate(c)), "step int, module string")


# Windows.

@query("SELECT event_id, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def token_prev_next(spark, d):
    return sequences.with_neighbours(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous", "next")


@query("SELECT o_orderkey, coalesce(string_agg(CAST(o_orderstatus AS VARCHAR), ',') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM orders")
def preceding_conditions(spark, d):
    t = sequences.with_preceding(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return t.select("o_orderkey", F.array_join("preceding", ",").alias("before"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(l_partkey + CAST(l_quantity AS BIGINT)) OVER w AS hi, max(l_partkey) OVER w AS st FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_partkey + CAST(l_quantity AS BIGINT) DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE l_partkey < hi OR l_partkey = st"""
)
def overlap_edits(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"))
    return edits.conflicts(e, "l_orderkey", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, event_type, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY ALL")
def earliest_reference(spark, d):
    e = sequences.earliest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "ts", "event_id")
    return e.select("user_id", "event_type", F.col("ts").alias("first_at"), F.col("event_id").alias("first_event"))


@query("SELECT path, folder FROM (SELECT s.path, o.folder, row_number() OVER (PARTITION BY s.path ORDER BY length(o.folder) DESC) AS k FROM (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL) s JOIN (VALUES ('Sources'), ('Sources/RavenWharfUI'), ('Sources/RavenWharfUI/Views'), ('Scripts')) o(folder) ON starts_with(s.path, o.folder || '/')) WHERE k = 1")
def nearest_override(spark, d):
    o = spark.createDataFrame([("Sources",), ("Sources/RavenWharfUI",), ("Sources/RavenWharfUI/Views",), ("Scripts",)], "folder string")
    return layering.nearest(table(spark, d, "source_files").where("path is not null"), o)


@query(
    """SELECT path, CASE WHEN regexp_matches(path, '^Sources/[^/]+/Views/') AND starts_with(path, 'Sources/RavenWharfUI/Views/') THEN '6' WHEN starts_with(path, 'Sources/RavenWharfUI/') THEN '5' WHEN starts_with(path, 'Scripts/') THEN '4' ELSE 'none' END AS language_mode
    FROM (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL)"""
)
def language_modes(spark, d):
    o = spark.createDataFrame([("Sources/RavenWharfUI", "5"), ("Sources/RavenWharfUI/Views", "6"), ("Scripts", "4")], "folder string, language_mode string")
    return layering.language_modes(table(spark, d, "source_files").where("path is not null"), o, "none")


# Streaming operators, over tables.


@query(
    """SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 2 HOUR AS refresh_at, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def debounce_sessions(spark, d):
    return editor.debounced(table(spark, d, "events"), "user_id", "ts", "2 hours")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return editor.tumbling_counts(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("SELECT uri, seq FROM (SELECT user_id AS uri, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type IN ('click', 'view')")
def last_change_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "change").otherwise("close").alias("event"), F.col("props").alias("text"))
    return editor.last_change(e).select("uri", "seq")


_RULES = [("r1", "file", "Sources/RavenWharfUI"), ("r2", "descendants", "Sources/RavenWharfUI"), ("r3", "descendants", "Scripts/Nowhere"), ("r4", "descendants", "")]


@query("SELECT rule FROM (VALUES ('r1', 'file', 'Sources/RavenWharfUI'), ('r2', 'descendants', 'Sources/RavenWharfUI'), ('r3', 'descendants', 'Scripts/Nowhere'), ('r4', 'descendants', '')) x(rule, kind, p) WHERE EXISTS (SELECT 1 FROM source_files s WHERE (kind = 'file' AND s.path = p) OR (kind = 'descendants' AND (p = '' OR s.path = p OR starts_with(s.path, p || '/'))))")
def incremental_rules(spark, d):
    return editor.affected_rules(table(spark, d, "source_files").where("path is not null").select("path"), spark.createDataFrame(_RULES, "rule string, kind string, path string"))


# Edits and reports.


@query(
    """SELECT file_id, '// checked' || chr(10) || regexp_replace(text, 'let ', 'LET ') || chr(10) || '// end' AS text FROM (SELECT DISTINCT file_id, text FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL)"""
)
def edits_applied(spark, d):
    """Three edits of each file at byte offsets: before its text, in it (the first 'let ', if there is one) and after it."""
    f = table(spark, d, "source_files").where("file_id is not null and text is not null").select("file_id", "text").distinct()
    at = F.octet_length(F.substring_index("text", "let ", 1))
    end = F.octet_length("text")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("replacement"))
    inner = F.when(F.contains("text", F.lit("let ")), F.array(edit(at, at + 4, "LET "))).otherwise(F.array().cast("array<struct<start:int,end:int,replacement:string>>"))
    e = f.select("file_id", F.inline(F.concat(F.array(edit(F.lit(0), F.lit(0), "// checked\n")), inner, F.array(edit(end, end, "\n// end")))))
    return edits.apply_edits(f, e, "file_id")


def _events(spark, d):
    p = table(spark, d, "parse_diagnostics")
    return p.select(F.lit("parses").alias("rule"), F.lit("error").alias("level"), "message", "path", "line", F.col("col").alias("column"))


def _rules(spark):
    return spark.createDataFrame([("parses", "files parse", "mend the file", "error", "Rules/parses.swift", 3, 1)], "id string, name string, hint string, level string, path string, line int, column int")


_PLACE = "concat_ws(':', coalesce(path, '<unknown>'), CAST(line AS VARCHAR), CASE WHEN line IS NOT NULL THEN CAST(col AS VARCHAR) END)"
_FLAT = "replace(replace(replace(coalesce(message, ''), chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ')"
_URI = r"replace(replace(replace(replace(path, '%', '%25'), ' ', '%20'), '[', '%5B'), ']', '%5D')"


@query(
    f"""SELECT {_PLACE} || ': error: ' || {_FLAT} AS line FROM parse_diagnostics UNION ALL SELECT 'Rules/parses.swift:3:1: note: rule ''parses'' is declared here'
    UNION ALL SELECT 'Checked 1 rule: ' || count(*) || ' violation' || CASE WHEN count(*) = 1 THEN '.' ELSE 's.' END FROM parse_diagnostics"""
)
def report_compiler(spark, d):
    return report.compiler_lines(_events(spark, d), _rules(spark), quiet=False)


@query(
    """SELECT '::error' || CASE WHEN w = '' THEN '' ELSE ' ' || w END || '::' || replace(replace(replace(coalesce(message, ''), '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS line
    FROM (SELECT message, concat_ws(',', 'file=' || replace(replace(replace(path, '%', '%25'), ':', '%3A'), ',', '%2C'), 'line=' || line) AS w FROM parse_diagnostics)"""
)
def report_annotations(spark, d):
    return report.annotation_lines(_events(spark, d))


def _json(*pairs: tuple[str, str]) -> str:
    """A JSON object in SQL; what is null is left out."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || {v}""" for k, v in pairs) + ") || '}'"


_EVENT = _json(("kind", "'\"violation\"'"), ("level", "'\"error\"'"), ("message", "CAST(to_json(message) AS VARCHAR)"), ("path", "CAST(to_json(path) AS VARCHAR)"), ("line", "line"), ("column", "col"), ("ruleID", "'\"parses\"'"))


@query(f"SELECT {_EVENT} AS line FROM parse_diagnostics")
def report_json(spark, d):
    """The events of the JSON report; report_json_document has them in their document."""
    return report.json_events(_events(spark, d))


@query(
    """SELECT 0 AS part, CAST(1 AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_commas UNION ALL SELECT 1, 1, 0 UNION ALL SELECT 2, 1, 0 UNION ALL SELECT 3, count(*), greatest(0, count(*) - 1) FROM parse_diagnostics UNION ALL SELECT 4, 1, 0 UNION ALL SELECT 99, 1, 0"""
)
def report_json_document(spark, d):
    """The lines of the JSON document, counted by part; those after the first of a part start with a comma."""
    lines = report.json_document(_events(spark, d), _rules(spark))
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").startswith(",")).alias("n_commas"))


@query(
    "SELECT " + _json(("ruleId", "'\"parses\"'"), ("level", "'\"error\"'"), ("message", _json(("text", "CAST(to_json(message) AS VARCHAR)"))), ("locations", "'[' || " + _json(("physicalLocation", _json(("artifactLocation", _json(("uri", f"'\"' || {_URI} || '\"'"))), ("region", _json(("startLine", "line"), ("startColumn", "col")))))) + " || ']'")) + " AS line FROM parse_diagnostics"
)
def report_sarif(spark, d):
    return report.sarif_results(_events(spark, d))


@query(f"SELECT '- **parses** `' || concat_ws(':', coalesce(path, '<unknown>'), CAST(line AS VARCHAR)) || '` ' || {_FLAT} AS line FROM parse_diagnostics")
def report_markdown(spark, d):
    return report.markdown_lines(_events(spark, d))


@query("SELECT CAST(1 AS BIGINT) AS n_rules, count(*) AS n_violations FROM parse_diagnostics")
def report_summary(spark, d):
    return report.summary(_events(spark, d))


@query("SELECT DISTINCT message FROM parse_diagnostics")
def distinct_warnings(spark, d):
    return sequences.distinct_warnings(table(spark, d, "parse_diagnostics"), "message")
