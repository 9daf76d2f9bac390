"""The base tables of a code base, read from the texts of source_files.

Texts are parsed once a session and the facts written to the shared folder; each query reads only its columns of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import inherit, members
from factloom.operators import matcher as m
from factloom.operators.selection import Roles, Selection
from factloom.sources import syntax
from factloom.sources.declarations import read_facts, view
from factloom.session import cut, table

Q: dict = {}

TABLES = {
    "types": ("type",), "classes": ("type", "class"), "structs": ("type", "struct"), "enums": ("type", "enum"), "actors": ("type", "actor"), "protocols": ("protocol",), "extensions": ("extension",), "functions": ("function",),
    "properties": ("property",), "initializers": ("initializer",), "enum_cases": ("enum_case",), "imports": ("import",), "typealiases": ("typealias",), "calls": ("call",), "variable_bindings": ("binding",), "assignments": ("assignment",), "compilation_branches": ("branch",),
}
_SHOWN = ["path", "seq", "line", "col", "name", "qualified_name", "enclosing", "keyword", "visibility", "return_type", "type_text", "value", "body_line_count", "cyclomatic_complexity", "owner"]


_written: dict[tuple[str, str], DataFrame] = {}


def code_facts(spark, sf_dir: str) -> DataFrame:
    """Facts of each distinct Swift text and its path, parsed and written once a session; all queries read that table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        f = table(spark, sf_dir, "source_files").where("lang = 'swift' and path is not null and text is not null")
        _written[key] = cut(read_facts(f.select("path", "text").distinct()))
    return _written[key]


def code_nodes(spark, sf_dir: str) -> DataFrame:
    """Syntax nodes of each Swift file, of a path with several texts those of the greatest; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir + " nodes")
    if key not in _written:
        f = table(spark, sf_dir, "source_files").where("lang = 'swift' and path is not null and text is not null")
        _written[key] = cut(syntax.read_nodes(f.groupBy("path").agg(F.max("text").alias("text"))))
    return _written[key]


def _table(name: str, kind: str, *keywords: str):
    def q(spark, sf_dir: str) -> DataFrame:
        return view(code_facts(spark, sf_dir), kind, *keywords).select(*_SHOWN)

    q.__name__ = f"facts_{name}"
    return q


for _name, _kinds in TABLES.items():
    Q[f"facts_{_name}"] = _table(_name, *_kinds)


def facts_long_functions(spark, sf_dir: str) -> DataFrame:
    """A rule over parsed facts: public functions have documentation and bodies of at most thirty lines."""
    f = Selection(view(code_facts(spark, sf_dir), "function"), Roles(), "functions")
    return f.where(m.is_public()).violations(of=m.has_documentation() & (m.field("body_line_count") <= 30)).erased()


def facts_module_imports(spark, sf_dir: str) -> DataFrame:
    """How many files import each module."""
    i = view(code_facts(spark, sf_dir), "import").select("path", F.substring_index("name", ".", 1).alias("module")).distinct()
    return i.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"))


Q |= {"facts_long_functions": facts_long_functions, "facts_module_imports": facts_module_imports}


def syntax_node_kinds(spark, sf_dir: str) -> DataFrame:
    """How many nodes of each kind there are, and how deep they lie."""
    return code_nodes(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


def syntax_if_expressions(spark, sf_dir: str) -> DataFrame:
    """Each if with the declarations around it."""
    n = code_nodes(spark, sf_dir)
    return syntax.enclosing(n, syntax.of_kind(n, "ifExpr"), "functionDecl", "classDecl", "structDecl", "enumDecl", "actorDecl", "extensionDecl").select("path", "line", "col", "enclosing")


def syntax_guarded_bodies(spark, sf_dir: str) -> DataFrame:
    """Functions whose bodies hold a guard or a defer statement."""
    n = code_nodes(spark, sf_dir)
    return syntax.containing(n, syntax.of_kind(n, "functionDecl"), "guardStmt", "deferStmt").select("path", "line", "name")


def syntax_call_arguments(spark, sf_dir: str) -> DataFrame:
    """Calls and how many arguments each has: children of the list that is a child of the call."""
    n = code_nodes(spark, sf_dir)
    calls, lists = syntax.of_kind(n, "functionCall"), syntax.of_kind(n, "argumentList").select("path", F.col("node_id").alias("list"), F.col("parent_id").alias("node_id"))
    args = syntax.of_kind(n, "argument").groupBy("path", F.col("parent_id").alias("list")).agg(F.count(F.lit(1)).alias("n"))
    return calls.join(lists, ["path", "node_id"]).join(args, ["path", "list"], "left").select("path", "line", "col", "name", F.coalesce("n", F.lit(0)).alias("n_arguments"))


def expression_values(spark, sf_dir: str) -> DataFrame:
    """Literals and arguments of calls with the values they say."""
    return syntax.expressions(code_nodes(spark, sf_dir)).drop("node_id", "parent_id")


def facts_callers(spark, sf_dir: str) -> DataFrame:
    """Functions that call write, wherever it stands in the callee: the matcher calls over functions with their calls."""
    f = code_facts(spark, sf_dir)
    rows = members.with_calls(view(f, "function"), view(f, "call"))
    return rows.where(m.calls("write").ok()).select("path", "line", "name")


def facts_importers(spark, sf_dir: str) -> DataFrame:
    """Files that import more than one module, with the modules."""
    f = code_facts(spark, sf_dir)
    files = members.with_imports(f.select("path").distinct(), view(f, "import"))
    return files.where(F.size("imports") > 1).select("path", F.array_join("imports", ",").alias("modules"))


def facts_closure(spark, sf_dir: str) -> DataFrame:
    """What each declaration inherits over protocols, extensions and typealiases."""
    f = code_facts(spark, sf_dir)
    types = view(f, "type").unionByName(view(f, "protocol")).select("qualified_name", "inherited")
    return inherit.closure(types, view(f, "extension").select("name", "inherited"), view(f, "typealias").select("name", "type_text", "path", "seq"))


Q |= {f.__name__: f for f in (syntax_node_kinds, syntax_if_expressions, syntax_guarded_bodies, syntax_call_arguments, expression_values, facts_callers, facts_importers, facts_closure)}


def _names(name: str, kind: str):
    def q(spark, sf_dir: str) -> DataFrame:
        return view(code_facts(spark, sf_dir), kind).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))

    q.__name__ = name
    return q


for _n, _k in (("facts_protocol_names", "protocol"), ("facts_extension_names", "extension")):
    Q[_n] = _names(_n, _k)

_HEAD = r"(?:(?:public|private|internal|fileprivate|open|package|final|nonisolated|@\w+(?:\([^)\n]*\))?)\s+)*"
_DECLARED = r"SELECT path, name, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[ \t]*{head}{word}[ \t]+([\w.]+)', 1)) AS name FROM (SELECT DISTINCT path, text FROM source_files WHERE lang = 'swift' AND path IS NOT NULL)) GROUP BY 1, 2"
_IMPORTED = r"unnest(regexp_extract_all(text, '(?m)(?:^|\r|\x{FEFF})\s*(?:@testable )?import (\w+)', 1)) AS module FROM source_files WHERE lang = 'swift' AND path IS NOT NULL"
SQL = {
    "facts_protocol_names": _DECLARED.replace("{head}", _HEAD).replace("{word}", "protocol"),
    "facts_extension_names": _DECLARED.replace("{head}", _HEAD).replace("{word}", "extension"),
    "facts_importers": f"SELECT path, string_agg(module, ',' ORDER BY module) AS modules FROM (SELECT DISTINCT path, {_IMPORTED}) GROUP BY path HAVING count(*) > 1",
}
