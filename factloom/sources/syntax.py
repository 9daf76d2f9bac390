"""Syntax nodes of Swift texts: declarations, statements, calls, closures, lists and literals as a tree.

Each node is a row with its interval of UTF-8 bytes, its parent and all its ancestors, outermost first, so parents,
children, ancestors and descendants are equi-joins on ids and never comparisons of intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import literals
from factloom.sources.declarations import _STATEMENTS, KINDS, _File

SCHEMA = "path string, node_id int, parent_id int, depth int, ancestors array<int>, kind string, name string, text string, start bigint, `end` bigint, line int, col int"
_NAMES = [c.split(" ")[0].strip("`") for c in SCHEMA.split(", ")]
_DECLS = {"class": "classDecl", "struct": "structDecl", "enum": "enumDecl", "actor": "actorDecl", "protocol": "protocolDecl", "extension": "extensionDecl", "func": "functionDecl", "init": "initializerDecl", "deinit": "deinitializerDecl", "subscript": "subscriptDecl", "var": "variableDecl", "let": "variableDecl", "typealias": "typealiasDecl", "import": "importDecl", "case": "enumCaseDecl", "associatedtype": "associatedtypeDecl"}
_STMTS = {"if": "ifExpr", "guard": "guardStmt", "for": "forStmt", "while": "whileStmt", "repeat": "repeatStmt", "switch": "switchExpr", "do": "doStmt", "defer": "deferStmt", "return": "returnStmt", "throw": "throwStmt"}
_TYPES = {"classDecl", "structDecl", "enumDecl", "actorDecl", "protocolDecl", "extensionDecl"}
_NAME = re.compile(r"[^\W\d]|`")


class _Tree(_File):
    def __init__(self, path: str, text: str):
        super().__init__(path, text)
        self.declarations(0, self.n, None)
        self.found: list[tuple[int, int, str, str | None]] = [(0, self.n, "sourceFile", None)]
        self.blocks: dict[int, str] = {}
        self.opener = {b: a for a, b in self.close.items()}
        self.comment_at = {b: a for a, b in self.t.comments}
        for word, a, b, name in self.spans:
            kind = _DECLS[word]
            self.found.append((a, b, kind, name))
            body = next((j for j in self._flat(a, b) if self.s[j] == "{"), None)
            if body is not None:
                self.blocks.setdefault(body, "memberBlock" if kind in _TYPES else "codeBlock")
        for i in range(self.n):
            self.token(i)

    def block_after(self, i: int) -> int | None:
        """The body that follows a head: the first brace outside other brackets."""
        return next((j for j in self._flat(i, self.n) if self.s[j] == "{"), None)

    def closed(self, brace: int | None, default: int) -> int:
        if brace is None:
            return default
        self.blocks[brace] = "codeBlock"
        return self.end_of(brace) + 1

    def statement_end(self, i: int) -> int:
        x = self.s[i]
        if x in ("return", "throw"):
            return self.expression_end(i + 1, self.n) if i + 1 < self.n and not self.line_break(i + 1) and self.s[i + 1] not in ("}", "case", "default") else i + 1
        k = self.closed(self.block_after(i + 1), i + 1)
        if x == "if":
            while k < self.n and self.s[k] == "else":
                again = self.s[k + 1] == "if"
                k = self.closed(self.block_after(k + 1), k + 1)
                if not again:
                    break
        elif x == "do":
            while k < self.n and self.s[k] == "catch":
                k = self.closed(self.block_after(k + 1), k + 1)
        elif x == "repeat" and k < self.n and self.s[k] == "while":
            k = self.expression_end(k + 1, self.n)
        return k

    def callee(self, p: int) -> int:
        """The first token of the dotted name that ends at token p."""
        q = p
        while q > 0 and self.s[q] in ("?", "!"):
            q -= 1
        while q >= 2 and self.s[q - 1] == "." and _NAME.match(self.s[q - 2] or "\n"):
            q -= 2
        return q - 1 if q >= 1 and self.s[q - 1] == "." and q == p else q

    def token(self, i: int) -> None:
        x, kind = self.s[i], self.t.kinds[i]
        if x in _STMTS and not (i and self.s[i - 1] == "." or i + 1 < self.n and self.s[i + 1] == ":"):
            if not (x == "if" and i and self.s[i - 1] == "else") and not (x == "while" and i and self.s[i - 1] == "}" and self.after_repeat(i)):
                self.found.append((i, self.statement_end(i), _STMTS[x], None))
        elif x == "(":
            close = self.end_of(i)
            before = self.s[i - 1] if i else ""
            if i and self.t.first[i] == 2 and (_NAME.match(before or "\n") and before not in _STATEMENTS - {"init", "self", "Self", "super"} or before in ("?", "!", ">", ")", "]", "}")) and not self.declares(i):
                q = self.callee(i - 1) if _NAME.match(before or "\n") or before in ("?", "!") else i - 1
                self.found.append((q, close + 1, "functionCall", re.sub(r"\s+", "", self.source(q, i))))
                self.found.append((i, close + 1, "argumentList", None))
                for a, b in self.split(i + 1, close):
                    label = self.s[a] if b - a > 1 and self.s[a + 1] == ":" else None
                    self.found.append((a, b, "argument", label))
            elif not self.declares(i):
                self.found.append((i, close + 1, "tuple", None))
            else:
                self.found.append((i, close + 1, "parameterList", None))
        elif x == "[":
            close = self.end_of(i)
            touches = i and self.at[i] == self.at[i - 1] + len(self.s[i - 1]) and (_NAME.match(self.s[i - 1] or "\n") or self.s[i - 1] in (")", "]"))
            kind_ = "subscript" if touches else "dictionary" if any(self.s[j] == ":" for j in self._flat(i + 1, close)) else "array"
            self.found.append((i, close + 1, kind_, None))
            if kind_ != "subscript":
                for a, b in self.split(i + 1, close):
                    self.found.append((a, b, "element", None))
        elif x == "{":
            self.found.append((i, self.end_of(i) + 1, self.blocks.get(i, "closure"), None))
        elif kind == KINDS["STRING"]:
            self.found.append((i, i + 1, "stringLiteral", None))
        elif kind == KINDS["NUMBER"]:
            self.found.append((i, i + 1, "numberLiteral", None))
        elif x in ("true", "false"):
            self.found.append((i, i + 1, "booleanLiteral", None))
        elif x == "nil":
            self.found.append((i, i + 1, "nilLiteral", None))
        elif kind == KINDS["REGEX"]:
            self.found.append((i, i + 1, "regexLiteral", None))

    def after_repeat(self, i: int) -> bool:
        """Whether the while at i ends a repeat: the block before it follows that word."""
        opener = self.opener.get(i - 1)
        return opener is not None and opener > 0 and self.s[opener - 1] == "repeat"

    def declares(self, i: int) -> bool:
        """Whether a parenthesis opens the parameters of a declaration or the arguments of an attribute."""
        j = i - 1
        if j >= 0 and self.s[j] == ">":
            depth = 0
            while j >= 0:
                depth += (self.s[j] == ">") - (self.s[j] == "<")
                j -= 1
                if not depth:
                    break
        if j >= 0 and self.s[j] in ("init", "subscript") and (j == 0 or self.s[j - 1] != "."):
            return True
        return j >= 1 and self.s[j - 1] in ("func", "@", "macro", "case")

    def end_offset(self, b: int) -> int:
        e = self.at[b] if b < len(self.at) else len(self.text)
        lo = self.at[b - 1] if b else 0
        while True:
            while e > lo and self.text[e - 1].isspace():
                e -= 1
            c = self.comment_at.get(e, -1)
            if c <= lo:
                return e
            e = c


def nodes(path: str, text: str | None) -> list[tuple]:
    """The nodes of one text in source order, the outermost first. A null or empty text has none."""
    if not text:
        return []
    t = _Tree(path, text)
    where = None
    if not t.ascii:
        where = [0]
        for ch in text:
            where.append(where[-1] + len(ch.encode("utf-8", "surrogatepass")))
    rows: list[tuple] = []
    stack: list[tuple[int, int]] = []
    for a, b, kind, name in sorted({x for x in t.found if x[1] > x[0]}, key=lambda x: (x[0], -x[1], x[2] != "sourceFile", x[2])):
        while stack and stack[-1][1] <= a:
            stack.pop()
        b = min(b, stack[-1][1]) if stack else b
        start, end = (t.at[a], t.end_offset(b)) if kind != "sourceFile" else (0, len(text))
        line, col = t.place(start)
        own = text[start:end] if kind.endswith("Literal") or kind in ("element", "argument") else None
        up = [n for n, _ in stack]
        rows.append((path, len(rows), up[-1] if up else None, len(up), up, kind, name, own, where[start] if where else start, where[end] if where else end, line, col))
        stack.append((len(rows) - 1, b))
    return rows


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = pd.DataFrame([r for p, t in zip(b["path"], b["text"]) for r in nodes(p, t)], columns=_NAMES)
        out["parent_id"] = out["parent_id"].astype("Int32")
        yield out


def read_nodes(files: DataFrame) -> DataFrame:
    """The syntax nodes of Swift files (path, text), each path once; write them as Parquet and query that."""
    return files.where("path is not null and text is not null").select("path", "text").mapInPandas(_nodes, SCHEMA)


def of_kind(all_: DataFrame, *kinds: str) -> DataFrame:
    return all_.where(F.col("kind").isin(*kinds))


def _ids(of: DataFrame, column: str) -> DataFrame:
    return of.select("path", F.col("node_id").alias(column)).distinct()


def parents(all_: DataFrame, of: DataFrame) -> DataFrame:
    return all_.join(of.where("parent_id is not null").select("path", F.col("parent_id").alias("node_id")).distinct(), ["path", "node_id"], "left_semi")


def children(all_: DataFrame, of: DataFrame) -> DataFrame:
    return all_.join(_ids(of, "parent_id"), ["path", "parent_id"], "left_semi")


def ancestors(all_: DataFrame, of: DataFrame) -> DataFrame:
    return all_.join(of.select("path", F.explode("ancestors").alias("node_id")).distinct(), ["path", "node_id"], "left_semi")


def descendants(all_: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes below any of the given ones; only ids are multiplied by their depth."""
    below = all_.select("path", "node_id", F.explode("ancestors").alias("up")).join(_ids(of, "up"), ["path", "up"], "left_semi").select("path", "node_id").distinct()
    return all_.join(below, ["path", "node_id"], "left_semi")


def containing(all_: DataFrame, of: DataFrame, *kinds: str) -> DataFrame:
    """Those of the given nodes that hold a node of one of the kinds at any depth."""
    held = of_kind(all_, *kinds).select("path", F.explode("ancestors").alias("node_id")).distinct()
    return of.join(held, ["path", "node_id"], "left_semi")


def enclosing(all_: DataFrame, of: DataFrame, *kinds: str) -> DataFrame:
    """of with enclosing ARRAY: kind and name of the nodes of these kinds around each, outermost first."""
    up = of.select("path", "node_id", F.posexplode("ancestors").alias("at", "up"))
    named = of_kind(all_, *kinds).select("path", F.col("node_id").alias("up"), "kind", "name")
    g = up.join(named, ["path", "up"]).groupBy("path", "node_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "name"))).alias("e"))
    kind = "array<struct<kind:string,name:string>>"
    return of.join(g, ["path", "node_id"], "left").withColumn("enclosing", F.coalesce(F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"))), F.array().cast(kind))).drop("e")


def expressions(all_: DataFrame) -> DataFrame:
    """Literals, elements and arguments with what they say: string_value, int_value, double_value, bool_value, is_nil,
    reference_name, reference_base and called, each null where it is something else."""
    label = F.when((F.col("kind") == "argument") & F.col("name").isNotNull(), F.regexp_replace("text", r"^[^:]*:\s*", "")).otherwise(F.col("text"))
    e = all_.where("text is not null").withColumn("value", label)
    v = F.col("value")
    return e.select(
        "path", "node_id", "parent_id", "kind", F.when(F.col("kind") == "argument", F.col("name")).alias("label"), "value", "line", "col", literals.string_value(v).alias("string_value"), literals.int_value(v).alias("int_value"),
        literals.double_value(v).alias("double_value"), literals.bool_value(v).alias("bool_value"), literals.is_nil(v).alias("is_nil"), literals.reference_name(v).alias("reference_name"), literals.reference_base(v).alias("reference_base"), literals.callee(v).alias("called"),
    )


def slices(of: DataFrame, files: DataFrame) -> DataFrame:
    """of with source, the bytes between start and end of the file's text, decoded."""
    t = files.select("path", F.encode("text", "UTF-8").alias("_bytes"))
    return of.join(t, "path").withColumn("source", F.decode(F.expr("substring(_bytes, cast(start + 1 as int), cast(`end` - start as int))"), "UTF-8")).drop("_bytes")
