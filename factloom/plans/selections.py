"""Queries of the selection, matcher and check operators over whole tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import docs, paths
from factloom.functions.versions import version_key
from factloom.operators import collections_ as c
from factloom.operators import matcher as m
from factloom.operators.selection import Roles, Selection, combined
from factloom.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TYPES = Roles("name", "path", ("path", "seq", "type_id", "observed_at"), "line", "col")


def types(spark, d):
    return Selection(table(spark, d, "type_decls"), TYPES, "types")


def functions(spark, d):
    return Selection(table(spark, d, "function_decls"), Roles("name", "path", ("path", "seq", "file_id"), "line", "col"), "functions")


def files(spark, d):
    return Selection(table(spark, d, "source_files"), Roles("name", "path", ("path", "file_id"), None, None), "files")


def nations(spark, d):
    return Selection(table(spark, d, "nation"), Roles("n_name", None, ("n_nationkey",), None, None), "nations")


def parts(spark, d):
    return Selection(table(spark, d, "part"), Roles("p_name", None, ("p_partkey",), None, None), "parts")


_KEY = ["type_id", "name", "path", "line"]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_7')")
def sel_named(spark, d):
    return nations(spark, d).named("NATION_1", "NATION_7").df.select("n_nationkey", "n_name")


@query("SELECT type_id, name, path, line FROM type_decls WHERE name LIKE '%Loader' OR name LIKE '%Store'")
def sel_suffixed(spark, d):
    return types(spark, d).suffixed("Loader", "Store").df.select(*_KEY)


@query("SELECT type_id, name, path, line FROM type_decls WHERE name LIKE 'Total%' OR name LIKE 'Base%'")
def sel_prefixed(spark, d):
    return types(spark, d).prefixed("Total", "Base").df.select(*_KEY)


@query("SELECT type_id, name, path, line FROM type_decls WHERE regexp_full_match(name, '[A-Z][a-z]+[A-Z][a-z]+(Row|Kind)')")
def sel_name_matching(spark, d):
    return types(spark, d).name_matching("[A-Z][a-z]+[A-Z][a-z]+(Row|Kind)").df.select(*_KEY)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_4')")
def sel_excluding(spark, d):
    return nations(spark, d).excluding("NATION_3", "NATION_4").df.select("n_nationkey", "n_name")


@query("SELECT file_id, path FROM source_files WHERE path = 'Sources' OR path LIKE 'Sources/%' OR path LIKE 'Scripts/%'")
def sel_under(spark, d):
    return files(spark, d).under("Sources", "Scripts/").df.select("file_id", "path")


@query("SELECT file_id, path FROM source_files WHERE NOT (path = 'Sources' OR path LIKE 'Sources/%')")
def sel_outside(spark, d):
    return files(spark, d).outside("./Sources", "../elsewhere").df.select("file_id", "path")


@query("SELECT file_id, path FROM source_files WHERE regexp_full_match(path, 'Sources/(.*/)?Views/[^/]*\\.swift')")
def sel_glob(spark, d):
    f = files(spark, d)
    return f.df.where(paths.matches_any(F.col("path"), ["Sources/**/Views/*.swift"])).select("file_id", "path")


@query("SELECT file_id, path FROM source_files WHERE NOT regexp_full_match(path, 'Sources/[^/]+/Views/.*')")
def violations_outside_paths(spark, d):
    return files(spark, d).violations(outside_paths=["Sources/*/Views/**"]).offenders.select("file_id", "path")


@query("SELECT type_id, name, path, line FROM type_decls WHERE is_final")
def where_column(spark, d):
    return types(spark, d).where("is_final").df.select(*_KEY)


@query(
    """SELECT count(*) FILTER (WHERE l_quantity <= 10) AS at_most, count(*) FILTER (WHERE l_quantity >= 40) AS at_least, count(*) FILTER (WHERE l_quantity < 2) AS under_two,
    count(*) FILTER (WHERE l_quantity > 49) AS over, count(*) FILTER (WHERE l_returnflag IS NOT DISTINCT FROM 'R') AS is_r, count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM 'R') AS not_r FROM lineitem"""
)
def where_compared(spark, d):
    t = table(spark, d, "lineitem")
    q, r = m.field("l_quantity"), m.field("l_returnflag")
    tests = {"at_most": q <= 10, "at_least": q >= 40, "under_two": q < 2, "over": q > 49, "is_r": r == "R", "not_r": r != "R"}
    return t.agg(*[F.count_if(x.ok()).alias(n) for n, x in tests.items()])


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR NOT (o_orderpriority = '1-URGENT' OR o_totalprice < 400000)")
def matcher_and_or_not(spark, d):
    s, p, u = m.field("o_orderstatus") == "F", m.field("o_totalprice"), m.field("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").where(((s & (p > 300000)) | ~(u | (p < 400000))).ok()).select("o_orderkey")


@query("SELECT type_id, name, path, line FROM type_decls WHERE visibility IN ('package', 'public', 'open')")
def visibility_at_least(spark, d):
    return types(spark, d).where(m.has_visibility("package")).df.select(*_KEY)


@query("SELECT type_id, name, path, line FROM type_decls WHERE visibility IN ('public', 'open') AND keyword IN ('class', 'struct')")
def public_classes_and_structs(spark, d):
    return types(spark, d).where(m.is_public() & (m.is_keyword("class") | m.is_keyword("struct"))).df.select(*_KEY)


@query(r"SELECT type_id, name, path, line FROM type_decls WHERE list_bool_or(list_transform(inherited, lambda x: coalesce(x = 'Sendable' OR regexp_replace(x, '^(@\S+\s+)*', '') = 'Sendable', false)))")
def directly_conforms(spark, d):
    return types(spark, d).where(m.directly_conforms("Sendable")).df.select(*_KEY)


@query("SELECT type_id, name, path, line FROM type_decls WHERE list_contains(inherited, '@unchecked Sendable')")
def declares_inheritance(spark, d):
    return types(spark, d).where(m.declares_inheritance("@unchecked Sendable")).df.select(*_KEY)


@query("SELECT file_id, seq, name FROM function_decls WHERE documentation IS NOT NULL AND (is_async OR is_throwing)")
def documented_effects(spark, d):
    return functions(spark, d).where(m.has_documentation() & (m.flag("async", "is_async") | m.flag("throwing", "is_throwing"))).df.select("file_id", "seq", "name")


@query("SELECT file_id, seq, name FROM function_decls WHERE return_type IS NOT DISTINCT FROM 'Bool'")
def returns_type(spark, d):
    return functions(spark, d).where(m.returns("Bool")).df.select("file_id", "seq", "name")


@query("SELECT file_id, seq, name FROM function_decls WHERE return_type LIKE '%?'")
def returns_optional(spark, d):
    return functions(spark, d).where(m.returns_optional()).df.select("file_id", "seq", "name")


@query("SELECT file_id, seq, name FROM function_decls WHERE len(list_filter(parameters, lambda p: p.type_text = 'Bool')) > 0")
def parameter_typed(spark, d):
    return functions(spark, d).where(m.has_parameter(typed="Bool")).df.select("file_id", "seq", "name")


@query("SELECT file_id, seq, name FROM function_decls WHERE len(list_filter(parameters, lambda p: p.label = 'with')) > 0")
def parameter_labelled(spark, d):
    return functions(spark, d).where(m.has_parameter(labelled="with")).df.select("file_id", "seq", "name")


@query(r"SELECT file_id, seq, name FROM function_decls WHERE len(list_filter(parameters, lambda p: regexp_matches(p.type_text, '\b(Row|Error)\b'))) > 0")
def parameter_referencing(spark, d):
    return functions(spark, d).where(m.has_parameter(referencing=["Row", "Error"])).df.select("file_id", "seq", "name")


@query(
    """SELECT count(*) FILTER (WHERE coalesce(list_bool_and(list_transform(parameters, lambda p: coalesce(p.label IS NOT NULL, false))), true)) AS all_labelled,
    count(*) FILTER (WHERE coalesce(list_bool_or(list_transform(parameters, lambda p: p.label IS NULL)), false)) AS any_bare,
    count(*) FILTER (WHERE NOT coalesce(list_bool_or(list_transform(parameters, lambda p: p.label IS NULL)), false)) AS none_bare FROM function_decls"""
)
def members_quantified(spark, d):
    t = table(spark, d, "function_decls")
    every = m.all_members("parameters", "be labelled", lambda p: p["label"].isNotNull())
    some = m.any_member("parameters", "be bare", lambda p: p["label"].isNull())
    none = m.no_member("parameters", "be bare", lambda p: p["label"].isNull())
    return t.agg(F.count_if(every.ok()).alias("all_labelled"), F.count_if(some.ok()).alias("any_bare"), F.count_if(none.ok()).alias("none_bare"))


@query("SELECT file_id, seq, name, list_filter(parameters, lambda p: p.label IS NULL)[1].name AS witness FROM function_decls WHERE len(list_filter(parameters, lambda p: p.label IS NULL)) > 0")
def member_witness(spark, d):
    v = functions(spark, d).violations(of=m.all_members("parameters", "be labelled", lambda p: p["label"].isNotNull()))
    return v.offenders.select("file_id", "seq", "name", F.col("witness.name").alias("witness"))


@query("SELECT type_id, name, path, line FROM type_decls WHERE name LIKE '%Presenter' AND NOT coalesce(is_final, false)")
def violations_of(spark, d):
    v = types(spark, d).suffixed("Presenter").violations(of=m.flag("final", "is_final"))
    return v.offenders.select(*_KEY)


@query("SELECT type_id, name, path, line FROM type_decls WHERE keyword = 'class' AND visibility = 'open'")
def violations_matching(spark, d):
    return types(spark, d).where(m.is_keyword("class")).violations(matching=m.field("visibility") == "open").offenders.select(*_KEY)


@query("SELECT count(*) AS checked_count, count(*) FILTER (WHERE p_size > 40) AS violation_count FROM part WHERE p_name LIKE '%e%'")
def violations_counts(spark, d):
    return parts(spark, d).name_matching(".*e.*").violations(of=m.field("p_size") <= 40).counts()


@query(
    """SELECT 'types suffixed ''Presenter'' should be final' AS rule, name, path, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column" FROM type_decls WHERE name LIKE '%Presenter' AND NOT coalesce(is_final, false)
    UNION ALL SELECT 'functions should have a documentation comment', name, path, CAST(line AS BIGINT), CAST(col AS BIGINT) FROM function_decls WHERE documentation IS NULL"""
)
def rule_results_combined(spark, d):
    return combined(types(spark, d).suffixed("Presenter").violations(of=m.flag("final", "is_final")), functions(spark, d).violations(of=m.has_documentation()))[0]


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 3")
def only_row(spark, d):
    s = Selection(table(spark, d, "region"), Roles("r_name", None, ("r_regionkey",), None, None), "regions").where(m.field("r_regionkey") == 3)
    s.only()
    return s.df.select("r_regionkey", "r_name")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 25")
def sorted_prefix(spark, d):
    return parts(spark, d).sorted("p_size").prefix(25).df.select("p_partkey", "p_size")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC")
def reversed_rows(spark, d):
    return nations(spark, d).reversed().df.select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 5")
def drop_first(spark, d):
    return nations(spark, d).drop_first(5).df.select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_and(l_quantity > 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ok FROM lineitem) WHERE ok")
def prefix_while(spark, d):
    s = Selection(table(spark, d, "lineitem"), Roles("l_orderkey", None, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), None, None), "lines")
    return s.prefix_while(m.field("l_quantity") > 5, by=["l_orderkey"]).df.select("l_orderkey", "l_linenumber")


@query("SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM part GROUP BY p_brand")
def group_dictionary(spark, d):
    g = c.grouped(table(spark, d, "part"), ["p_brand"], "p_partkey")
    return c.map_values(g, ["p_brand"], keys=F.array_join(F.col("values").cast("array<string>"), ","))


@query("SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand")
def map_values(spark, d):
    return c.reduced_groups(table(spark, d, "part"), ["p_brand"], n=F.count(F.lit(1)), largest=F.max("p_size"))


@query("SELECT DISTINCT event_type FROM events")
def set_distinct(spark, d):
    return c.distinct(table(spark, d, "events"), "event_type")


@query("SELECT module, bool_or(keyword = 'actor') AS any_actor, bool_and(visibility = 'internal') AS all_internal FROM type_decls GROUP BY module")
def bool_or_and(spark, d):
    return c.any_and_all(table(spark, d, "type_decls"), ["module"], {"any_actor": F.col("keyword") == "actor"}, {"all_internal": F.col("visibility") == "internal"})


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return c.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_difference(spark, d):
    return c.difference(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return c.intersection(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT type_id, observed_at, coalesce(list_has_all(['Sendable','Codable','Equatable'], inherited), true) AS subset FROM type_decls WHERE inherited IS NOT NULL")
def is_subset(spark, d):
    s = F.array(F.lit("Sendable"), F.lit("Codable"), F.lit("Equatable"))
    return table(spark, d, "type_decls").where("inherited is not null").select("type_id", "observed_at", c.is_subset(F.col("inherited"), s).alias("subset"))


@query(
    r"""SELECT p_partkey, starts_with(p_name, 'small') AS has_prefix, ends_with(p_name, 'ring') AS has_suffix, contains(p_name, 'e') AS has_e, regexp_matches(p_name, '[aeiou]{2}') AS has_vowels,
    upper(p_name) AS up, lower(p_type) AS low, CAST(length(p_name) AS INT) AS n, p_name || '/' || p_brand AS joined FROM part"""
)
def string_scalars(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", n.startswith("small").alias("has_prefix"), n.endswith("ring").alias("has_suffix"), n.contains("e").alias("has_e"), n.rlike("[aeiou]{2}").alias("has_vowels"),
        F.upper(n).alias("up"), F.lower("p_type").alias("low"), F.length(n).alias("n"), F.concat(n, F.lit("/"), F.col("p_brand")).alias("joined"),
    )


@query(r"SELECT file_id, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS last, regexp_extract(path, '[^./]\.([^./]+)$', 1) AS ext FROM source_files WHERE path IS NOT NULL")
def path_scalars(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").where("path is not null").select("file_id", paths.parent(p).alias("folder"), paths.last_component(p).alias("last"), paths.extension(p).alias("ext"))


@query("SELECT file_id, coalesce(language_mode, 'none') AS mode, language_mode IS NOT DISTINCT FROM '5' AS is_five, language_mode IS DISTINCT FROM '5' AS not_five FROM source_files")
def optional_coalesce(spark, d):
    v = F.col("language_mode")
    return table(spark, d, "source_files").select("file_id", F.coalesce(v, F.lit("none")).alias("mode"), v.eqNullSafe("5").alias("is_five"), (~v.eqNullSafe("5")).alias("not_five"))


@query("SELECT greatest(0, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN -2 ELSE 0 END)) AS weight, user_id FROM events GROUP BY user_id")
def weighted_sum(spark, d):
    w = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", -2).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.greatest(F.lit(0), F.sum(w)).alias("weight"))


@query(
    r"""SELECT file_id, seq, len(regexp_extract_all(documentation, '-\s+[Pp]arameter\s+(\w+)\s*:', 1)) + CASE WHEN regexp_matches(documentation, '-\s+[Pp]arameters:') THEN
    len(list_filter(string_split_regex(regexp_extract(documentation, '-\s+[Pp]arameters:([\s\S]*)$', 1), '\r\n|\r|\n'), lambda x: regexp_matches(x, '^[\s/*]*-\s+\w+\s*:') AND NOT regexp_matches(x, '-\s+(Parameters?|Returns?|Throws|Note|Warning|Important|SeeAlso|Complexity|Precondition|Postcondition|Requires|Since|Todo|Version|Attention|Bug|Remark|Tip)\b')))
    ELSE 0 END AS n_parameters, regexp_matches(documentation, '-\s+[Rr]eturns?\s*:') AS has_result FROM function_decls WHERE documentation IS NOT NULL"""
)
def documented_parameters(spark, d):
    t = table(spark, d, "function_decls").where("documentation is not null")
    return t.select("file_id", "seq", F.size(docs.documented_parameters(F.col("documentation"))).cast("bigint").alias("n_parameters"), docs.documents_result(F.col("documentation")).alias("has_result"))


@query("SELECT type_id, observed_at, list_sort(list_transform(list_filter(inherited, lambda x: contains(x, '<')), lambda x: length(x))) AS lengths, coalesce(inherited[1], 'none') AS first FROM type_decls WHERE inherited IS NOT NULL")
def array_scalars(spark, d):
    """filter, map and sorted(by:) on lists, and a subscript that may be out of range."""
    x = F.col("inherited")
    lengths = c.sorted_by(F.transform(F.filter(x, lambda e: e.contains("<")), lambda e: F.length(e).cast("bigint")), lambda a, b: a < b)
    return table(spark, d, "type_decls").where("inherited is not null").select("type_id", "observed_at", lengths.alias("lengths"), F.coalesce(F.when(F.size(x) > 0, c.subscript(x, F.lit(0))), F.lit("none")).alias("first"))


@query("SELECT line_count >= 10 AND line_count < 40 AS half_open, line_count BETWEEN 10 AND 40 AS closed, line_count >= 100 AS open_ended, count(*) AS n FROM (SELECT coalesce(line_count, -1) AS line_count FROM source_files) GROUP BY ALL")
def ranges(spark, d):
    v = F.coalesce(F.col("line_count"), F.lit(-1))
    t = table(spark, d, "source_files").select(c.in_range(v, F.lit(10), F.lit(40)).alias("half_open"), c.in_range(v, F.lit(10), F.lit(40), closed=True).alias("closed"), c.in_range(v, F.lit(100)).alias("open_ended"))
    return t.groupBy("half_open", "closed", "open_ended").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_size, p_size // 10 || '.' || p_size % 10 || '.0' AS version, p_size // 10 > 2 OR (p_size // 10 = 2 AND p_size % 10 >= 5) AS at_least FROM part")
def version_compare(spark, d):
    v = F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    return table(spark, d, "part").select("p_size", v.alias("version"), (version_key(v) >= version_key(F.lit("2.5.0"))).alias("at_least")).distinct()


def inspection(spark, d):
    """Rows kept by each step of a chain of filters."""
    return types(spark, d).suffixed("Loader").prefixed("Base").where(m.is_public()).inspect()


Q["inspection"] = inspection
SQL["inspection"] = """SELECT 0 AS step, 'types suffixed ''Loader''' AS query, count(*) AS selected FROM type_decls WHERE name LIKE '%Loader'
UNION ALL SELECT 1, 'types suffixed ''Loader'' prefixed ''Base''', count(*) FROM type_decls WHERE name LIKE 'Base%Loader'
UNION ALL SELECT 2, 'types suffixed ''Loader'' prefixed ''Base'' that be public', count(*) FROM type_decls WHERE name LIKE 'Base%Loader' AND visibility IN ('public', 'open')"""
