"""Compilation conditions under an operating system: true, false or unknown, with the logic of SQL's nulls."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

# The systems that a manifest can be read on.
SYSTEMS = ("macOS", "Linux", "Windows")
_PART = re.compile(r"\s*(&&|\|\||!|\(|\)|os\s*\(\s*(\w+)\s*\)|[^\s()!&|]+(?:\s*\([^()]*\))?)")


def value(condition: str | None, system: str) -> bool | None:
    """os(...) with !, &&, || and parentheses; whatever else is unknown (None), as is a condition that does not parse."""
    parts, at = [], 0
    text = (condition or "").strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None
        parts.append(m.group(1) if m.group(2) is None else m.group(2) == system if m.group(2) in SYSTEMS else None)
        at = m.end()
    place = 0

    def one():
        nonlocal place
        if place >= len(parts):
            raise ValueError
        p = parts[place]
        place += 1
        if p == "!":
            v = one()
            return None if v is None else not v
        if p == "(":
            v = either()
            if place >= len(parts) or parts[place] != ")":
                raise ValueError
            place += 1
            return v
        if p in ("&&", "||", ")"):
            raise ValueError
        return p if isinstance(p, bool) else None

    def both():
        nonlocal place
        v = one()
        while place < len(parts) and parts[place] == "&&":
            place += 1
            w = one()
            v = False if v is False or w is False else None if v is None or w is None else True
        return v

    def either():
        nonlocal place
        v = both()
        while place < len(parts) and parts[place] == "||":
            place += 1
            w = both()
            v = True if v is True or w is True else None if v is None or w is None else False
        return v

    try:
        v = either()
    except ValueError:
        return None
    return v if place == len(parts) else None


def branch_value(condition: str | None, preceding: Sequence[str], system: str) -> bool | None:
    """Of a branch after others: false if one before it is true, unknown if one is unknown, else its own condition; an
    #else has none of its own."""
    before = [value(c, system) for c in preceding]
    if True in before:
        return False
    if None in before:
        return None
    return value(condition, system) if condition else True


def with_values(branches: DataFrame, system: str) -> DataFrame:
    """Branches of facts (name, preceding) with is_active BOOLEAN, null where it is unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["is_active"] = pd.array([branch_value(n, list(p) if p is not None else [], system) for n, p in zip(b["name"], b["preceding"])], dtype="boolean")
            yield b

    kept = branches.select("path", "line", "col", "name", "preceding")
    return kept.mapInPandas(run, "path string, line int, col int, name string, preceding array<string>, is_active boolean")
