"""Source edits: byte ranges replaced in texts, conflicts found before."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class EditConflict(ValueError):
    pass


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Applies (start, end, replacement) edits, given in UTF-8 bytes; overlaps and equal starts are an error."""
    raw, out, at, last = text.encode(), [], 0, -1
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start < at or start == last or end < start or end > len(raw):
            raise EditConflict(f"the edit at byte {start} meets another one or leaves the text")
        out += [raw[at:start], new.encode()]
        at, last = end, start
    return b"".join([*out, raw[at:]]).decode()


def conflicts(edits: DataFrame, path: str = "path", then: Sequence[str] = ()) -> DataFrame:
    """Edits that start before an earlier one of their file ends, or where one starts, in the order (start, end desc);
    then: columns that order equal edits."""
    w = Window.partitionBy(path).orderBy(F.col("start"), F.col("end").desc(), *then).rowsBetween(Window.unboundedPreceding, -1)
    e = edits.withColumn("_end", F.max("end").over(w)).withColumn("_start", F.max("start").over(w))
    return e.where((F.col("start") < F.col("_end")) | (F.col("start") == F.col("_start"))).drop("_end", "_start")


def _splice_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["text"] = [splice(t, [(e["start"], e["end"], e["replacement"]) for e in es]) for t, es in zip(b["text"], b["edits"])]
        yield b.drop(columns=["edits"])


def apply_edits(files: DataFrame, edits: DataFrame, key: str = "path") -> DataFrame:
    """The changed files: key, text. The edits of a file (bounded by its text) meet its text in one row."""
    e = edits.groupBy(key).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return files.select(key, "text").join(e, key).mapInPandas(_splice_batches, files.select(key, "text").schema)


# Edits of lists in brackets, such as arguments or array elements; offsets count UTF-8 bytes, as splice() takes them.

Edit = tuple[int, int, str]


def _parts(text: str, opening: int) -> tuple[list[tuple[int, int]], int]:
    """Start and end of each element between the bracket at opening and its closing one, and where that is."""
    raw, closers = text.encode(), {"(": ")", "[": "]", "{": "}"}
    stack, out, start, i = [], [], opening + 1, opening
    quote = None
    while i < len(raw):
        c = chr(raw[i])
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c == '"':
            quote = c
        elif c in closers:
            stack.append(closers[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                out.append((start, i))
                break
        elif c == "," and len(stack) == 1:
            out.append((start, i))
            start = i + 1
        i += 1
    else:
        raise EditConflict("the list is not closed")
    if stack:
        raise EditConflict("the list is not closed")
    trimmed = []
    for a, b in out:
        part = raw[a:b]
        if part.strip():
            trimmed.append((a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))))
    return trimmed, i


def insert_element(text: str, opening: int, at: int, element: str) -> Edit:
    """Inserts an element as the at-th of the list, with the list's own separation (its line breaks and indents)."""
    parts, closing = _parts(text, opening)
    raw = text.encode()
    if not 0 <= at <= len(parts):
        raise EditConflict(f"the list has no place {at}")
    if not parts:
        return opening + 1, closing, element
    lead = raw[opening + 1 : parts[0][0]].decode()
    gap = lead if "\n" in lead or "\r" in lead else " "
    if at == len(parts):
        return parts[-1][1], parts[-1][1], f",{gap}{element}"
    return parts[at][0], parts[at][0], f"{element},{gap}"


def remove_element(text: str, opening: int, at: int) -> Edit:
    """Takes the at-th element away with one separator."""
    parts, closing = _parts(text, opening)
    if not 0 <= at < len(parts):
        raise EditConflict(f"the list has no element {at}")
    if len(parts) == 1:
        return opening + 1, closing, ""
    return (parts[at][0], parts[at + 1][0], "") if at + 1 < len(parts) else (parts[at - 1][1], parts[at][1], "")


def replace(start: int, end: int, new: str) -> Edit:
    return start, end, new


def unwrap(text: str, opening: int) -> list[Edit]:
    """Takes the brackets at opening away; with braces on lines of their own those lines go as well."""
    raw = text.encode()
    parts, closing = _parts(text, opening)
    if not parts:
        raise EditConflict("nothing is wrapped")
    inner_a, inner_b = parts[0][0], parts[-1][1]
    return [(opening, inner_a, ""), (inner_b, closing + 1, "")] if raw[opening : opening + 1] in (b"(", b"{", b"[") else []


def wrapped(opening: str, elements: list[str], closing: str, indent: str = "", width: int = 100, step: str = "  ") -> str:
    """A list on one line if it fits the width, else one element a line, indented by step."""
    if width <= 0:
        raise ValueError("a width is positive")
    line = f"{opening}{', '.join(elements)}{closing}"
    if len(indent) + len(line) <= width and "\n" not in line:
        return line
    return opening + "\n" + ",\n".join(f"{indent}{step}{e}" for e in elements) + f"\n{indent}{closing}"
