"""Globs and lexical paths: decided on the driver, applied as JVM expressions."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A regular expression for path + '/': * and ? within a part, ** for any number of parts, none included.

    Atomic groups keep patterns of many stars linear.
    """
    out = []
    for part in [p for p in glob.strip("/").split("/") if p != ""]:
        if part == "**":
            if not out or out[-1] != "(?:[^/]+/)*":
                out.append("(?:[^/]+/)*")
            continue
        lit = lambda s: "".join("[^/]" if c == "?" else re.escape(c) for c in s)
        pieces = part.split("*")
        if len(pieces) == 1:
            out.append(lit(part) + "/")
            continue
        middle = "".join(f"(?>[^/]*?{lit(p)})" for p in pieces[1:-1] if p)
        out.append(lit(pieces[0]) + middle + "[^/]*" + lit(pieces[-1]) + "/")
    return r"\A" + "".join(out) + r"\z"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether a root-relative path matches one of the globs; null paths match none."""
    if not globs:
        return F.lit(False)
    p = F.concat(path, F.lit("/"))
    return F.coalesce(reduce(lambda a, b: a | b, [p.rlike(glob_regex(g)) for g in globs]), F.lit(False))


def covers(path: Column, including: Sequence[str] = (), excluding: Sequence[str] = ()) -> Column:
    """Part of a code base: no includes or one that matches, and no exclude that matches."""
    inside = matches_any(path, including) if including else F.lit(True)
    return inside & ~matches_any(path, excluding)


def scope_directories(directories: Sequence[str]) -> tuple[list[str], list[str]]:
    """Directories as normal root-relative paths, and those that lead outside the root."""
    inside, outside = [], []
    for d in directories:
        n = posixpath.normpath(d.strip("/") or ".")
        if n == ".." or n.startswith("../"):
            outside.append(d)
        else:
            inside.append("" if n == "." else n)
    return inside, outside


def under(path: Column, directories: Sequence[str]) -> Column:
    """At or below one of the directories, by whole parts; the root '' holds every path."""
    tests = [F.lit(True) if d == "" else (path == d) | path.startswith(d + "/") for d in directories]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def uri(path: Column) -> Column:
    """A relative path as a URI reference: UTF-8 bytes beyond letters, digits and -._~!$&'()*+,;=@/ as percent escapes."""
    escaped = F.url_encode(path)
    for code, sign in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%40", "@")):
        escaped = F.replace(escaped, F.lit(code), F.lit(sign))
    return escaped


def last_component(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def parent(path: Column) -> Column:
    """The path without its last part; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*/*$", "")


def extension(path: Column) -> Column:
    """The part after the last dot of the last component, '' without one."""
    return F.regexp_extract(last_component(path), r"[^.]\.([^.]+)$", 1)


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first; a file at the top has none."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))
