"""What the text of an expression says: values of literals, names of references. Null where it is something else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of string literals.
ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\0": "\0", '\\"': '"', "\\'": "'", "\\\\": "\\"}
_NAME = r"(?:[\p{L}_][\p{L}\p{N}_]*|`[^`]+`)"


def string_value(text: Column) -> Column:
    """The value of a string literal of one line without interpolation: escapes decoded, raw strings (#"..."#) as they are."""
    t = F.trim(text)
    inner = F.regexp_extract(t, r'^"((?:[^"\\]|\\[^(])*)"$', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"\\u\{[0-9A-Fa-f]{1,8}\}|\\[\s\S]|[^\\]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def decoded(p: Column) -> Column:
        code = F.lpad(F.regexp_extract(p, r"^\\u\{([0-9A-Fa-f]{1,8})\}$", 1), 8, "0")
        return F.when(p.rlike(r"^\\u\{"), F.decode(F.unhex(code), "UTF-32")).when(p.startswith("\\"), F.try_element_at(known, p)).otherwise(p)

    plain = F.aggregate(F.transform(parts, decoded), F.lit(""), lambda a, p: F.concat(a, p))
    raw = F.regexp_extract(t, r'^(#+)"([\s\S]*)"\1$', 2)
    return F.when(t.rlike(r'^"(?!"")(?:[^"\\\r\n]|\\[^(])*"$'), plain).when(t.rlike(r'^(#+)"[^\r\n]*"\1$'), raw)


def int_value(text: Column) -> Column:
    """Decimal, hexadecimal, octal and binary literals with underscores and a sign; beyond 64 bits null."""
    t = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(t, r"^[-+]", "")
    based = lambda p, n: F.conv(F.regexp_extract(body, f"^{p}(.+)$", 1), n, 10).try_cast("bigint")
    ok = F.trim(text).rlike(r"^[-+]?(?:\d[\d_]*|0x[0-9A-Fa-f][0-9A-Fa-f_]*|0o[0-7][0-7_]*|0b[01][01_]*)$")
    v = F.when(body.startswith("0x"), based("0x", 16)).when(body.startswith("0o"), based("0o", 8)).when(body.startswith("0b"), based("0b", 2)).otherwise(body.try_cast("bigint"))
    return F.when(ok, sign * v)


def double_value(text: Column) -> Column:
    t = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return F.when(t.rlike(r"^[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$"), t.try_cast("double"))


def bool_value(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def is_nil(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "nil", F.lit(False))


def key_path(text: Column) -> Column:
    """The parts of a key path literal after its backslash, the root type included if it is written."""
    t = F.regexp_extract(F.trim(text), rf"^\\((?:{_NAME})?(?:\.{_NAME}[?!]?)+)$", 1)
    return F.when(t != "", t)


def reference_name(text: Column) -> Column:
    """The last name of a reference such as a, a.b or .b; null for calls and other expressions."""
    t = F.trim(text)
    return F.when(t.rlike(rf"^(?:{_NAME}[?!]?)?(?:\.{_NAME}[?!]?)*$") & (t != "") & ~t.isin("true", "false", "nil"), F.regexp_replace(F.regexp_replace(t, r"^.*\.", ""), r"[`?!]", ""))


def reference_base(text: Column) -> Column:
    """What stands before the last dot of a reference; null without one."""
    t = F.regexp_extract(F.trim(text), rf"^((?:{_NAME}[?!]?)(?:\.{_NAME}[?!]?)*)\.{_NAME}[?!]?$", 1)
    return F.when(t != "", t)


def callee(text: Column) -> Column:
    """The called expression of a call whose callee is a reference."""
    t = F.regexp_extract(F.trim(text), rf"^((?:{_NAME}[?!]?)?(?:\.?{_NAME}[?!]?)(?:\.{_NAME}[?!]?)*)\s*(?:<[^()]*>)?\([\s\S]*\)$", 1)
    return F.when(t != "", t)


def without_generics(text: Column) -> Column:
    """The text without <...>, nested to any depth; the arrow of a function type closes nothing."""

    def step(a: Column, ch: Column) -> Column:
        closes = (ch == ">") & (a["before"] != "-") & (a["depth"] > 0)
        depth = F.when(ch == "<", a["depth"] + 1).when(closes, a["depth"] - 1).otherwise(a["depth"])
        kept = F.when((a["depth"] == 0) & (ch != "<"), F.concat(a["kept"], ch)).otherwise(a["kept"])
        return F.struct(depth.alias("depth"), kept.alias("kept"), ch.alias("before"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"), F.lit("").alias("before"))
    # A text of one level, the usual case, needs no walk over its signs.
    plain = F.regexp_replace(text, r"<[^<>]*>", "")
    return F.when(~plain.rlike("[<>]"), plain).otherwise(F.aggregate(F.split(text, ""), start, step, lambda a: a["kept"]))


def simple_type_name(text: Column) -> Column:
    """The last part of a type name without generic arguments and optional marks."""
    return F.regexp_extract(F.regexp_replace(text, r"<.*>|[?!]+$", ""), r"([^.]+)$", 1)


def is_array_type(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(t.rlike(r"^\[[^:\[\]]+(?:\[[^\]]*\][^:]*)?\]$|^Array\s*<.*>$"), F.lit(False))


def is_dictionary_type(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^\[[^:\[\]]+:.+\]$|^Dictionary\s*<.*>$"), F.lit(False))


def is_set_type(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^Set\s*<.*>$"), F.lit(False))


def has_line_longer_than(text: Column, width: int, tab_width: int = 4) -> Column:
    """Whether a line of the text is wider than width characters, tabs counted to the next stop."""
    lines = F.split(text, r"\r\n|\r|\n")

    def wide(line: Column) -> Column:
        parts = F.split(line, "\t")
        n = F.size(parts)
        # Each part but the last is filled up to the next stop by its tab.
        filled = F.aggregate(F.slice(parts, F.lit(1), n - 1), F.lit(0), lambda a, p: ((F.floor((a + F.length(p)) / F.lit(tab_width)) + 1) * tab_width).cast("int"))
        return filled + F.length(F.element_at(parts, -1)) > width

    return F.coalesce(F.exists(lines, wide), F.lit(False))


def grapheme_count(text: Column) -> Column:
    """Characters as a reader sees them: letters with their marks, and joined signs, count once."""
    return F.length(F.regexp_replace(text, r"\X", "x"))


def same_text(a: Column, b: Column) -> Column:
    """Canonical equality: composed and decomposed spellings are one text; nulls equal each other."""
    return F.collate(a, "UNICODE").eqNullSafe(F.collate(b, "UNICODE"))
