"""Static reading of package manifests: nothing is run, and what cannot be known is marked as such.

Each row has a state: known, conditional (under an #if that may hold) or unresolved (an expression that is not
understood; its text is the name). Constants, + of strings and lists, package.field += [...], = and append are followed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.declarations import KINDS, _File

SCHEMA = "path string, kind string, name string, type string, owner string, value string, requirement string, position int, state string"
_FIELDS = ("name", "platforms", "products", "dependencies", "targets", "swiftLanguageModes", "traits")


@dataclass
class Node:
    """kind: text, number, list, call, name, plus, other. parts: list items, or (label, node) of a call."""

    kind: str
    text: str = ""
    parts: list = field(default_factory=list)
    state: str = "known"


class _Reader:
    def __init__(self, text: str):
        self.f = _File("Package.swift", text)
        self.s, self.kinds = self.f.s, self.f.t.kinds
        self.constants: dict[str, Node] = {}

    def expression(self, a: int, b: int) -> Node:
        """The tokens a .. b - 1."""
        cuts = [k for k in self.f._flat(a, b) if self.s[k] == "+"]
        if cuts:
            ends = [*cuts, b]
            return Node("plus", parts=[self.expression(p, q) for p, q in zip([a, *[c + 1 for c in cuts]], ends)])
        if b - a == 1 and self.kinds[a] == KINDS["STRING"]:
            raw = self.f.text[self.f.at[a] :]
            return Node("text", re.match(r'"((?:[^"\\]|\\.)*)"', raw).group(1) if raw.startswith('"') and not raw.startswith('"""') else self.f.source(a, b))
        if b - a == 1 and self.kinds[a] == KINDS["NUMBER"]:
            return Node("number", self.s[a])
        if self.s[a] == "[" and self.f.end_of(a) == b - 1:
            return Node("list", parts=[self.expression(p, q) for p, q in self.f.split(a + 1, b - 1) if q > p])
        opened = next((k for k in range(a, b) if self.s[k] == "("), None)
        head = self.f.source(a, opened if opened is not None else b)
        if re.fullmatch(r"\.?[\w.]+", re.sub(r"\s", "", head)):
            head = re.sub(r"\s", "", head)
            if opened is None:
                return Node("name", head)
            # A function of the manifest's own is not run.
            if self.f.end_of(opened) == b - 1 and ("." in head or head[0].isupper()):
                args = []
                for p, q in self.f.split(opened + 1, b - 1):
                    labelled = q - p > 1 and self.s[p + 1] == ":"
                    args.append((self.s[p] if labelled else None, self.expression(p + 2 if labelled else p, q)))
                return Node("call", head.split(".")[-1], args)
        return Node("other", self.f.without_comments(a, b))

    def resolve(self, n: Node, depth: int = 0) -> Node:
        if n.kind == "name" and n.text in self.constants and depth < 50:
            return self.resolve(self.constants[n.text], depth + 1)
        if n.kind == "plus":
            parts = [self.resolve(p, depth + 1) for p in n.parts]
            if all(p.kind == "text" for p in parts):
                return Node("text", "".join(p.text for p in parts))
            if any(p.kind == "list" for p in parts):
                return Node("list", parts=[x for p in parts for x in (p.parts if p.kind == "list" else [Node("other", p.text or "+")])])
            return Node("other", " + ".join(p.text for p in parts))
        return n

    def items(self, n: Node | None, state: str) -> list[Node]:
        if n is None:
            return []
        n = self.resolve(n)
        if n.kind != "list":
            return [Node("other", n.text, state="unresolved")]
        out = []
        for x in n.parts:
            x = self.resolve(x)
            x.state = state if x.kind not in ("other", "plus") and not (x.kind == "name" and not x.text.startswith(".")) else "unresolved"
            out.append(x)
        return out

    def read(self) -> dict[str, list[Node]]:
        held: dict[str, list[Node]] = {k: [] for k in _FIELDS}
        package, i, depth = None, 0, 0
        while i < self.f.n:
            x = self.s[i]
            if self.kinds[i] == KINDS["#if"]:
                depth += 1
            elif self.kinds[i] == KINDS["#endif"]:
                depth -= 1
            state = "conditional" if depth else "known"
            if x in ("let", "var") and i + 2 < self.f.n:
                j = i + 2
                if self.s[j] == ":":
                    j = self.f.type_end(j + 1, ("=", "{"))
                if self.s[j] == "=":
                    end = self.f.expression_end(j + 1, self.f.n)
                    node = self.expression(j + 1, end)
                    if node.kind == "call" and node.text == "Package":
                        package = self.s[i + 1]
                        for label, arg in node.parts:
                            if label == "name":
                                held["name"] = [self.resolve(arg)]
                            elif label in held:
                                held[label] += self.items(arg, state)
                    else:
                        self.constants[self.s[i + 1]] = node
                    i = end
                    continue
            if package and x == package and self.s[i + 1] == "." and self.s[i + 2] in held:
                name, j = self.s[i + 2], i + 3
                if self.s[j] in ("=", "+="):
                    end = self.f.expression_end(j + 1, self.f.n)
                    new = self.items(self.expression(j + 1, end), state)
                    if self.s[j] == "=" and state == "known":
                        held[name] = new
                    elif self.s[j] == "=":
                        for old in held[name]:
                            old.state = "unresolved" if old.state == "unresolved" else "conditional"
                        held[name] += new
                    else:
                        held[name] += new
                    i = end
                    continue
                if self.s[j] == "." and self.s[j + 2] == "(":
                    end = self.f.end_of(j + 2)
                    if self.s[j + 1] == "append":
                        for p, q in self.f.split(j + 3, end):
                            many = self.s[p] == "contentsOf"
                            node = self.expression(p + 2 if many else p, q)
                            held[name] += self.items(node if many else Node("list", parts=[node]), state)
                    else:
                        held[name] = [Node("other", f".{self.s[j + 1]}", state="unresolved")]
                    i = end + 1
                    continue
            elif package and x == package and self.s[i - 1] in ("(", ",", "=", ":"):
                # Whoever else holds the package may change anything.
                for k in held:
                    held[k] = held[k] if k == "name" else [*held[k], Node("other", "package", state="unresolved")]
            i += 1
        return held


def rows(path: str, text: str | None) -> list[tuple]:
    if not text:
        return []
    r = _Reader(text)
    held = r.read()
    out: list[tuple] = []

    def add(kind, name, type_=None, owner=None, value=None, requirement=None, state="known"):
        out.append((path, kind, name, type_, owner, value, requirement, len(out), state))

    def arg(n: Node, *labels: str) -> Node | None:
        return next((r.resolve(v) for k, v in n.parts if k in labels), None)

    def plain(n: Node | None) -> str | None:
        return None if n is None else n.text

    for n in held["name"]:
        add("package", n.text, state="known" if n.kind == "text" else "unresolved")
    for n in held["platforms"]:
        add("platform", n.text if n.kind == "call" else n.text.lstrip("."), value=plain(n.parts[0][1]).lstrip(".") if n.kind == "call" and n.parts else None, state=n.state)
    for n in held["products"]:
        name = plain(arg(n, "name")) if n.kind == "call" else n.text
        add("product", name, n.text if n.kind == "call" else None, state=n.state)
        for t in r.items(arg(n, "targets"), n.state) if n.kind == "call" and arg(n, "targets") else []:
            add("product_target", t.text, owner=name, state=t.state)
    for n in held["dependencies"]:
        if n.kind != "call":
            add("dependency", n.text, state=n.state)
            continue
        where = arg(n, "url", "path", "id")
        how = next(((k, v) for k, v in n.parts if k in ("from", "exact", "branch", "revision") or k is None), (None, None))
        name = plain(arg(n, "name")) or (re.sub(r"\.git$", "", plain(where).rstrip("/").rsplit("/", 1)[-1]) if where else None)
        needed = f"{how[0] or (how[1].text if how[1].kind == 'call' else 'range')}:{plain(how[1].parts[0][1]) if how[1].kind == 'call' and how[1].parts else how[1].text}" if how[1] is not None else None
        add("dependency", name, "path" if arg(n, "path") else "url", value=plain(where), requirement=needed, state=n.state)
    for n in held["targets"]:
        if n.kind != "call":
            add("target", n.text, state=n.state)
            continue
        name = plain(arg(n, "name"))
        default = {"testTarget": "Tests/", "plugin": "Plugins/"}.get(n.text, "Sources/")
        add("target", name, n.text, value=plain(arg(n, "path")) or (default + name if name else None), state=n.state)
        for d in r.items(arg(n, "dependencies"), n.state) if arg(n, "dependencies") else []:
            if d.kind == "text":
                add("target_dependency", d.text, "byName", name, state=d.state)
            elif d.kind == "call":
                under = "conditional" if arg(d, "condition") is not None and d.state == "known" else d.state
                add("target_dependency", plain(arg(d, "name")) or (plain(d.parts[0][1]) if d.parts else None), d.text, name, plain(arg(d, "package")), state=under)
            else:
                add("target_dependency", d.text, None, name, state="unresolved")
        for label in ("exclude", "sources"):
            for d in r.items(arg(n, label), n.state) if arg(n, label) else []:
                add(f"target_{label}", d.text, owner=name, state=d.state)
    return out


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for b in batches:
        yield pd.DataFrame([x for p, t in zip(b["path"], b["text"]) for x in rows(p, t)], columns=names)


def read_manifests(files: DataFrame) -> DataFrame:
    """The manifests of files (path, text): one row for each package, platform, product, dependency, target and so on."""
    return files.where("path is not null and text is not null").select("path", "text").mapInPandas(_batches, SCHEMA)


def is_complete(manifest: DataFrame, kind: str) -> DataFrame:
    """path, owner, complete: whether all rows of a kind are known; one that is not may hold more than is shown."""
    return manifest.where(F.col("kind") == kind).groupBy("path", "owner").agg((~F.bool_or(F.col("state") != "known")).alias("complete"))
