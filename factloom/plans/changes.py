"""Queries of corrections, editor state, inspections and small scalar operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import literals
from factloom.operators import corrections, dependencies, rules, sequences
from factloom.operators import matcher as m
from factloom.operators.selection import NameFilter
from factloom.plans.selections import types
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


def _any_text(text: str) -> bool:
    return True


def _proposals(f):
    """Three rules: a first line for each file, var for its first let, and VAR for the same one in views, which conflicts."""
    at = F.octet_length(F.substring_index("text", "let ", 1)).cast("int")
    edit = lambda rule, a, b, new: F.struct(F.lit(rule).alias("rule"), F.xxhash64(F.lit(rule), "path").alias("proposal"), a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"))
    head, zero = edit("head", F.lit(0), F.lit(0), "// checked\n"), F.contains("text", F.lit("let ")) & (at > 0)
    small, big = edit("var", at, at + 4, "var "), edit("VAR", at, at + 4, "VAR ")
    views = F.contains("path", F.lit("/Views/"))
    all_ = F.when(zero & views, F.array(head, small, big)).when(zero, F.array(head, small)).otherwise(F.array(head))
    return f.select("path", F.explode(all_).alias("e")).select("e.rule", "e.proposal", "path", "e.start", "e.end", "e.replacement")


def _plan(spark, d):
    f = table(spark, d, "source_files").where("file_id is not null and path is not null and text is not null")
    f = f.select(F.concat_ws("/", F.col("file_id").cast("string"), "path").alias("path"), "text").distinct()
    return corrections.plan(f, _proposals(f), readable=_any_text)


_FILES = "(SELECT DISTINCT file_id || '/' || path AS path, text FROM source_files WHERE file_id IS NOT NULL AND path IS NOT NULL AND text IS NOT NULL)"
_LET = "strpos(text, 'let ') > 1"


@query(f"SELECT path, '// checked' || chr(10) || CASE WHEN {_LET} AND NOT contains(path, '/Views/') THEN regexp_replace(text, 'let ', 'var ') ELSE text END AS text FROM {_FILES}")
def correction_plan(spark, d):
    return _plan(spark, d)[0].select("path", "text")


@query(f"SELECT rule, 'the correction overlaps another replacement' AS reason, count(*) AS n FROM {_FILES} CROSS JOIN (VALUES ('var'), ('VAR')) r(rule) WHERE {_LET} AND contains(path, '/Views/') GROUP BY 1")
def corrections_rejected(spark, d):
    return _plan(spark, d)[1].groupBy("rule", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT path AS uri, message, line FROM parse_diagnostics WHERE path IS NOT NULL AND message IS NOT NULL AND line IS NOT NULL), a AS (SELECT uri FROM p UNION SELECT path FROM source_files WHERE lang = 'c' AND path IS NOT NULL)
    SELECT a.uri, count(DISTINCT p.message) AS n FROM a LEFT JOIN p ON p.uri = a.uri AND p.line >= 20 GROUP BY a.uri"""
)
def published_snapshot(spark, d):
    """Diagnostics to publish where those of the first lines were known before, the others are new, and C files are open."""
    p = table(spark, d, "parse_diagnostics").where("path is not null and message is not null and line is not null")
    by = lambda df: df.groupBy(F.col("path").alias("uri")).agg(F.collect_set("message").alias("diagnostics"))
    open_ = table(spark, d, "source_files").where("lang = 'c' and path is not null").select(F.col("path").alias("uri"))
    return editor.snapshot(by(p.where("line < 20")), by(p.where("line >= 20")), open_).select("uri", F.size("diagnostics").cast("bigint").alias("n"))


@query("SELECT type_id, observed_at FROM type_decls WHERE name LIKE '%Loader' AND (path = 'Sources' OR starts_with(path, 'Sources/')) AND name NOT IN ('BaseLoader')")
def sel_filtering(spark, d):
    filters = [NameFilter("suffixed", ("Loader",)), NameFilter("under", ("Sources",)), NameFilter("excluding", ("BaseLoader",))]
    return types(spark, d).filtering(filters).df.select("type_id", "observed_at")


@query(
    """WITH t AS (SELECT DISTINCT type_id, name, visibility FROM type_decls), k AS (SELECT type_id, bool_or(coalesce(name LIKE '%Loader', false)) AS a, bool_or(coalesce(name LIKE '%Loader' AND visibility IN ('public', 'open'), false)) AS b FROM t GROUP BY 1)
    SELECT 0 AS step, a AS selected, count(DISTINCT type_id) AS n FROM k GROUP BY a UNION ALL SELECT 1, b, count(DISTINCT type_id) FROM k WHERE a GROUP BY b"""
)
def inspection_rows(spark, d):
    """How many types each step of a selection kept and left out, from the rows themselves."""
    s = types(spark, d).suffixed("Loader").where(m.is_public())
    rows = s.inspect_rows(table(spark, d, "type_decls"), ["type_id"]).distinct()
    return rows.groupBy("step", "selected").agg(F.countDistinct("type_id").alias("n"))


@query(r"SELECT file_id, len(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: length(x) > 100)) > 0 AS is_wide FROM source_files WHERE text IS NOT NULL")
def long_lines(spark, d):
    return table(spark, d, "source_files").where("text is not null").select("file_id", literals.has_line_longer_than(F.col("text"), 100, tab_width=1).alias("is_wide"))


@query("SELECT event_id, coalesce(event_type = 'click' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'click', false) AS separated FROM events")
def separators(spark, d):
    e = table(spark, d, "events")
    return sequences.separated(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "separated")


@query(
    """SELECT CASE WHEN regexp_matches(path, '^Sources/[^/]+/Views/') THEN 'views' WHEN starts_with(path, 'Sources/') THEN 'sources' ELSE 'other' END AS kind, count(*) AS n FROM source_files GROUP BY 1"""
)
def first_match_groups(spark, d):
    """Files by the first group that takes them, in the order of groups."""
    g = dependencies.first_match(F.col("path"), {"views": ["Sources/*/Views/**"], "sources": ["Sources/**"]}, "other")
    return table(spark, d, "source_files").groupBy(g.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH p AS (SELECT unnest(parameters).type_text AS t FROM function_decls) SELECT t, coalesce(regexp_matches(t, '^Set\s*<.*>$'), false) AS is_set, coalesce(regexp_matches(t, '^\[[^:\[\]]+:.+\]$|^Dictionary\s*<.*>$'), false) AS is_dictionary,
    regexp_extract(regexp_replace(t, '<.*>|[?!]+$', '', 'g'), '([^.]+)$', 1) AS simple, count(*) AS n FROM p GROUP BY 1, 2, 3, 4"""
)
def parameter_types(spark, d):
    t = F.col("t")
    p = table(spark, d, "function_decls").select(F.explode("parameters").alias("p")).select(F.col("p.type_text").alias("t"))
    return p.groupBy(t, literals.is_set_type(t).alias("is_set"), literals.is_dictionary_type(t).alias("is_dictionary"), literals.simple_type_name(t).alias("simple")).agg(F.count(F.lit(1)).alias("n"))


_RULES = {"final": m.flag("final", "is_final"), "documented": m.has_documentation(), "short": m.field("line") <= 200, "public": m.is_public()}


@query(
    """SELECT rule_id, CAST(count(*) AS BIGINT) AS checked_count, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS violation_count FROM (SELECT unnest([{'i': 'final', 'ok': coalesce(is_final, false)}, {'i': 'documented', 'ok': documentation IS NOT NULL},
    {'i': 'short', 'ok': coalesce(line <= 200, false)}, {'i': 'public', 'ok': coalesce(visibility IN ('public', 'open'), false)}]) AS x FROM type_decls) CROSS JOIN LATERAL (SELECT x.i AS rule_id, x.ok AS ok) GROUP BY rule_id"""
)
def rules_one_scan(spark, d):
    """Four rules over all types in one scan."""
    return rules.check_all(types(spark, d), _RULES).counts
