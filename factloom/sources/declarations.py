"""Facts of Swift texts: types, protocols, extensions, functions, initializers, properties, enum cases, imports,
typealiases, calls, bindings, assignments and
compilation branches, in source order, from one pass over the tokens of each file."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.lexers import Places, swift_tokens

_WORDS = (
    "import class struct enum protocol extension func init deinit subscript var let typealias associatedtype if else guard switch case default for in while repeat do catch defer return throw throws rethrows try as is "
    "where break continue fallthrough self Self super nil true false inout public private internal fileprivate static Any _ actor macro async await some any open package final override mutating nonmutating lazy weak unowned required "
    "convenience dynamic optional indirect distributed prefix postfix infix nonisolated isolated borrowing consuming"
).split()
KINDS = {k: n for n, k in enumerate(["EOF", "IDENT", "NUMBER", "STRING", "STRING_OPEN", "STRING_MORE", "STRING_CLOSE", "REGEX", "MACRO", "POST", "PRE", "BINARY", "TERNARY", "AMP", *"()[]{},:;.@\\?!=<>&", "->", "...", "#if", "#elseif", "#else", "#endif", *_WORDS])}
VISIBILITY = ["private", "fileprivate", "internal", "package", "public", "open"]
MODIFIERS = set("public private internal fileprivate open package static class final override mutating nonmutating lazy weak unowned required convenience dynamic optional indirect distributed prefix postfix infix nonisolated isolated borrowing consuming".split())
TYPES = {"class", "struct", "enum", "actor"}
DECLARES = TYPES | {"protocol", "extension", "func", "init", "deinit", "subscript", "var", "let", "typealias", "import", "case", "associatedtype"}
_STATEMENTS = {"if", "guard", "for", "while", "switch", "return", "throw", "case", "catch", "in", "where", "is", "as", "func", "init", "subscript", "super", "self", "Self", "await", "try", "defer", "repeat", "do", "else", "let", "var", "throws", "rethrows", "async", "default", "some", "any"}
_COMPLEXITY = {"if", "guard", "for", "while", "repeat", "catch", "case"}

SCHEMA = (
    "kind string, path string, seq int, line int, col int, utf8_offset bigint, name string, qualified_name string, enclosing string, keyword string, visibility string, modifiers array<string>, "
    "attributes array<struct<name:string,arguments:string>>, inherited array<string>, generics array<string>, parameters array<struct<label:string,name:string,type_text:string>>, is_async boolean, is_throwing boolean, "
    "return_type string, type_text string, value string, documentation string, body_line_count int, await_count int, cyclomatic_complexity int, labels array<string>, owner string, preceding array<string>, end_line int, end_col int"
)
COLUMNS = [c.split(" ")[0] for c in re.split(r", (?=\w+ (?:string|int|bigint|boolean|array))", SCHEMA)]


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.t = swift_tokens(text, KINDS)
        self.s, self.at, self.n = self.t.texts, self.t.starts, len(self.t.kinds) - 2
        self.place = Places(text)
        self.rows: list[dict] = []
        self.comments = [c[0] for c in self.t.comments]
        self.ascii = text.isascii()
        # Each opening bracket's closing one, by token.
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i in range(self.n):
            x = self.s[i]
            if x in ("(", "[", "{"):
                stack.append(i)
            elif x in (")", "]", "}") and stack:
                self.close[stack.pop()] = i
        self.heads: set[int] = set()
        self.spans: list[tuple[str, int, int, str | None]] = []  # declarations: keyword, first token, token after, name

    def end_of(self, i: int) -> int:
        return self.close.get(i, self.n - 1)

    def source(self, a: int, b: int) -> str:
        """The text of the tokens a .. b - 1, without space at its ends."""
        return self.text[self.at[a] : self.at[b]].strip() if b > a else ""

    def without_comments(self, a: int, b: int) -> str:
        lo, hi, out = self.at[a], self.at[b], []
        for c in self.t.comments[bisect.bisect_left(self.comments, lo) : bisect.bisect_left(self.comments, hi)]:
            out.append(self.text[lo : c[0]])
            lo = c[1]
        return " ".join("".join([*out, self.text[lo:hi]]).split())

    def add(self, kind: str, i: int, **more) -> dict:
        i = more.pop("first", i)  # a declaration starts with its attributes and modifiers
        line, col = self.place(self.at[i])
        row = dict.fromkeys(COLUMNS)
        row |= {"kind": kind, "path": self.path, "seq": 0, "line": line, "col": col, "utf8_offset": self.at[i] if self.ascii else len(self.text[: self.at[i]].encode()), **more}
        self.rows.append(row)
        return row

    def documentation(self, first: int) -> str | None:
        lo = self.at[first - 1] if first else -1
        end = lo + max(1, len(self.s[first - 1])) if first else 0
        out = []
        for a, b in self.t.comments[bisect.bisect_left(self.comments, lo) : bisect.bisect_left(self.comments, self.at[first])]:
            if first and "\n" not in self.text[end:a] and "\r" not in self.text[end:a]:
                continue
            s = self.text[a:b]
            if (s.startswith("///") and not s.startswith("////")) or (s.startswith("/**") and len(s) > 4 and s[3] not in "*/"):
                out.append(s)
        return "\n".join(out) or None

    def head(self, i: int) -> tuple[int, list[tuple[str, str | None]], list[str]]:
        """Attributes and modifiers from token i on: the token after them, and both."""
        attributes, modifiers = [], []
        while i < self.n:
            if self.s[i] == "@" and i + 1 < self.n:
                j = i + 1
                while self.s[j + 1] == "." and j + 2 < self.n:
                    j += 2
                name, args = self.without_comments(i + 1, j + 1), None
                if self.s[j + 1] == "(" and self.t.first[j + 1] == 2:
                    k = self.end_of(j + 1)
                    args = self.text[self.at[j + 1] + 1 : self.at[k]].strip()
                    j = k
                attributes.append((name, args))
                i = j + 1
            elif self.s[i] in MODIFIERS and (self.s[i + 1] in DECLARES or self.s[i + 1] in MODIFIERS or self.s[i + 1] in ("@", "(")) and not (self.s[i] == "class" and self.s[i + 1] not in DECLARES | MODIFIERS):
                word = self.s[i]
                if self.s[i + 1] == "(":
                    k = self.end_of(i + 1)
                    if self.s[k + 1] not in DECLARES | MODIFIERS | {"@"}:
                        break
                    word += "(" + self.source(i + 2, k) + ")"
                    i = k
                modifiers.append(word)
                i += 1
            else:
                break
        return i, attributes, modifiers

    def skip_generics(self, i: int) -> int:
        """Past <...> that opens at i."""
        depth = 0
        while i < self.n:
            depth += (self.s[i] == "<") - (self.s[i] == ">")
            i += 1
            if not depth:
                break
        return i

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts between commas of the tokens a .. b - 1, brackets and generic arguments kept whole."""
        out, start, i, angle = [], a, a, 0
        while i < b:
            x = self.s[i]
            if x in ("(", "[", "{"):
                i = self.end_of(i)
            elif x == "<":
                angle += 1
            elif x == ">":
                angle = max(0, angle - 1)
            elif x == "," and not angle:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def parameters(self, i: int) -> list[dict]:
        out = []
        for a, b in self.split(i + 1, self.end_of(i)):
            a, _, _ = self.head(a)
            colon = next((k for k in range(a, b) if self.s[k] == ":"), None)
            if colon is None:
                continue
            names = [self.s[k].strip("`") for k in range(a, colon) if self.s[k]]
            stop = next((k for k in self._flat(colon + 1, b) if self.s[k] == "="), b)
            label = names[0] if names else None
            out.append({"label": None if label == "_" else label, "name": names[-1] if names else None, "type_text": self.without_comments(colon + 1, stop)})
        return out

    def _flat(self, a: int, b: int) -> Iterator[int]:
        while a < b:
            yield a
            a = self.end_of(a) + 1 if self.s[a] in ("(", "[", "{") else a + 1

    def line_break(self, i: int) -> bool:
        return self.t.first[i] == 1

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Where a type that starts at i ends: at a stop, or where the next line starts something new."""
        a = i
        while i < self.n:
            x = self.s[i]
            if x in stops or x in ("}", ")", "]", ";", ","):
                break
            if self.line_break(i) and i > a and x not in ("->", "&", ".") and self.s[i - 1] not in ("->", "&", ".", ":"):
                break
            i = self.skip_generics(i) if x == "<" else self.end_of(i) + 1 if x in ("(", "[") else i + 1
        return i

    def body(self, i: int) -> dict:
        """Metrics of a body that opens at i; nothing without one."""
        if i >= self.n or self.s[i] != "{":
            return {"body_line_count": 0, "await_count": 0, "cyclomatic_complexity": 1}
        k = self.end_of(i)
        inner = range(i + 1, k)
        weight = sum(self.s[j] in _COMPLEXITY and not (self.s[j] == "case" and self.s[j - 1] in ("if", "guard", ",", "for", "while")) for j in inner) - sum(self.s[j] == "fallthrough" for j in inner)
        weight -= sum(self.s[j] == "repeat" for j in inner)  # its while counts
        return {"body_line_count": self.place(self.at[k])[0] - self.place(self.at[i])[0] + 1, "await_count": sum(self.s[j] == "await" for j in inner), "cyclomatic_complexity": 1 + max(0, weight)}

    def declarations(self, i: int, end: int, enclosing: str | None, default: str = "internal", top: bool = True) -> None:
        """Declarations of a file or a body of a type, tokens i .. end - 1. Function bodies hold calls, no declarations."""
        while i < end:
            x = self.s[i]
            if x in ("#if", "#elseif", "#else", "#endif", ";"):
                i += 1
                continue
            first = i
            j, attributes, modifiers = self.head(i)
            x = self.s[j] if j < end else ""
            if x not in DECLARES or (x == "actor" and not (self.s[j + 1] and self.s[j + 1][0].isalpha() and self.s[j + 1] not in _STATEMENTS)):
                i = self.statement(max(j, i), end, enclosing)
                continue
            visibility = next((m for m in modifiers if m in VISIBILITY), default)
            common = {"first": first, "enclosing": enclosing, "visibility": visibility, "modifiers": modifiers, "attributes": [{"name": a, "arguments": b} for a, b in attributes], "documentation": self.documentation(first)}
            i = getattr(self, "_" + ("type" if x in TYPES else "property" if x in ("var", "let") else x))(j, end, enclosing, common)
            self.spans.append((x, first, i, self.s[j + 1].strip("`") if j + 1 < end and x not in ("init", "deinit", "subscript") else None))

    def _import(self, i, end, enclosing, common):
        j = i + 1
        kind = self.s[j] if self.s[j] in TYPES | {"protocol", "typealias", "func", "var", "let"} and not self.line_break(j + 1) and self.s[j + 1] != "." else None
        j += kind is not None
        k = j + 1
        while self.s[k] == "." and k + 1 < end:
            k += 2
        self.add("import", i, **common | {"name": self.without_comments(j, k), "keyword": kind})
        return k

    def _inheritance(self, i: int) -> tuple[list[str], int]:
        out = []
        if i < self.n and self.s[i] == ":":
            a = i + 1
            k = next((q for q in self._angles(a) if self.s[q] in ("{", "where")), self.n)
            out = [self.without_comments(p, q) for p, q in self.split(a, k)]
            i = k
        while i < self.n and self.s[i] != "{":
            i += 1
        return out, i

    def _angles(self, i: int) -> Iterator[int]:
        while i < self.n:
            yield i
            i = self.end_of(i) + 1 if self.s[i] in ("(", "[") else i + 1

    def _type(self, i, end, enclosing, common):
        word, name, j = self.s[i], self.s[i + 1].strip("`"), i + 2
        generics = []
        if self.s[j] == "<":
            k = self.skip_generics(j)
            generics = [self.without_comments(a, b) for a, b in self.split(j + 1, k - 1)]
            j = k
        inherited, b = self._inheritance(j)
        q = f"{enclosing}.{name}" if enclosing else name
        k = self.end_of(b)
        line, col = self.place(self.at[k])
        self.add("type", i, **common | {"name": name, "qualified_name": q, "keyword": word, "inherited": inherited, "generics": generics, "end_line": line, "end_col": col})
        self.declarations(b + 1, k, q, top=False)
        return k + 1

    def _protocol(self, i, end, enclosing, common):
        name, j = self.s[i + 1].strip("`"), i + 2
        j = self.skip_generics(j) if self.s[j] == "<" else j
        inherited, b = self._inheritance(j)
        q = f"{enclosing}.{name}" if enclosing else name
        self.add("protocol", i, **common | {"name": name, "qualified_name": q, "keyword": "protocol", "inherited": inherited})
        k = self.end_of(b)
        self.declarations(b + 1, k, q, top=False)
        return k + 1

    def _extension(self, i, end, enclosing, common):
        j = i + 1
        while j < self.n and self.s[j] not in (":", "{", "where"):
            j = self.skip_generics(j) if self.s[j] == "<" else j + 1
        name = re.sub(r"<.*", "", self.without_comments(i + 1, j))
        inherited, b = self._inheritance(j)
        self.add("extension", i, **common | {"name": name, "qualified_name": name, "keyword": "extension", "inherited": inherited})
        k = self.end_of(b)
        self.declarations(b + 1, k, name, top=False)
        return k + 1

    def _signature(self, j: int) -> tuple[dict, int]:
        """From the parameter list on: parameters, effects, result and body; the token after all."""
        row: dict = {"parameters": self.parameters(j) if self.s[j] == "(" else [], "is_async": False, "is_throwing": False}
        j = self.end_of(j) + 1 if self.s[j] == "(" else j
        while self.s[j] in ("async", "throws", "rethrows"):
            row["is_async"] |= self.s[j] == "async"
            row["is_throwing"] |= self.s[j] != "async"
            j = self.end_of(j + 1) + 1 if self.s[j] == "throws" and self.s[j + 1] == "(" and self.t.first[j + 1] == 2 else j + 1
        if self.s[j] == "->":
            k = self.type_end(j + 1, ("{", "where"))
            row["return_type"] = self.without_comments(j + 1, k)
            j = k
        if self.s[j] == "where":
            while j < self.n and self.s[j] != "{" and not (self.line_break(j) and self.s[j] in DECLARES | MODIFIERS | {"@"}) and self.s[j] != "}":
                j += 1
        row |= self.body(j)
        return row, j

    def _callable(self, kind, i, j, name, enclosing, common):
        row, b = self._signature(j)
        r = self.add(kind, i, **common | row | {"name": name})
        if b < self.n and self.s[b] == "{":
            k = self.end_of(b)
            self.calls(b + 1, k, f"{enclosing}.{r['name']}" if enclosing else r["name"])
            return k + 1
        return b

    def _func(self, i, end, enclosing, common):
        j = i + 1
        while j < self.n and self.s[j] not in ("(", "<") or j == i + 1:
            j += 1
        name = self.without_comments(i + 1, j).strip("`")
        j = self.skip_generics(j) if self.s[j] == "<" else j
        return self._callable("function", i, j, name, enclosing, common)

    def _init(self, i, end, enclosing, common):
        j = i + 1
        failable = self.s[j] in ("?", "!")
        j += failable
        j = self.skip_generics(j) if self.s[j] == "<" else j
        return self._callable("initializer", i, j, "init", enclosing, common | {"keyword": "failable" if failable else None})

    def _subscript(self, i, end, enclosing, common):
        j = i + 1
        j = self.skip_generics(j) if self.s[j] == "<" else j
        return self._callable("subscript", i, j, "subscript", enclosing, common)

    def _deinit(self, i, end, enclosing, common):
        return self._callable("deinitializer", i, i + 1, "deinit", enclosing, common)

    def _property(self, i, end, enclosing, common):
        j = i + 1
        while j < end:
            at, names = j, []
            if self.s[j] == "(":
                k = self.end_of(j)
                names = [self.s[q] for q in range(j + 1, k) if re.match(r"[^\W\d]", self.s[q] or "")]
                j = k + 1
            else:
                names = [self.s[j].strip("`")]
                j += 1
            kind, value = None, None
            if self.s[j] == ":":
                k = self.type_end(j + 1, ("{", "="))
                kind = self.without_comments(j + 1, k)
                j = k
            if self.s[j] == "=":
                k = self.expression_end(j + 1, end)
                value = self.without_comments(j + 1, k)
                self.calls(j + 1, k, f"{enclosing}.{names[0]}" if enclosing else names[0])
                j = k
            if j < end and self.s[j] == "{" and not self.line_break(j):
                k = self.end_of(j)
                self.calls(j + 1, k, f"{enclosing}.{names[0]}" if enclosing else names[0])
                j = k + 1
            for name in names:
                place = {} if at == i + 1 else {"first": at}
                self.add("property", i, **common | place | {"name": name, "keyword": self.s[i], "type_text": kind, "value": value})
            if j < end and self.s[j] == ",":
                j += 1
                continue
            break
        return j

    def expression_end(self, i: int, end: int) -> int:
        """An expression goes on over brackets, and over lines that start or end with an operator or a dot."""
        a = i
        while i < end:
            x, kind = self.s[i], self.t.kinds[i]
            if x in (",", ";", "}") or x in ("#if", "#elseif", "#else", "#endif"):
                break
            goes_on = (KINDS["BINARY"], KINDS["AMP"], KINDS["TERNARY"], KINDS["."], KINDS["="])
            if i > a and self.line_break(i) and kind not in goes_on and x not in ("?", ":", "as", "is", "else") and self.t.kinds[i - 1] not in goes_on:
                break
            i = self.end_of(i) + 1 if x in ("(", "[", "{") else i + 1
        return i

    def _typealias(self, i, end, enclosing, common):
        name, j = self.s[i + 1].strip("`"), i + 2
        j = self.skip_generics(j) if self.s[j] == "<" else j
        k = self.type_end(j + 1, ("where",)) if self.s[j] == "=" else j
        self.add("typealias", i, **common | {"name": name, "type_text": self.without_comments(j + 1, k) if k > j else None})
        return k

    def _associatedtype(self, i, end, enclosing, common):
        k = i + 2
        while k < end and not self.line_break(k) and self.s[k] not in (";", "}"):
            k += 1
        self.add("associatedtype", i, **common | {"name": self.s[i + 1].strip("`")})
        return k

    def _case(self, i, end, enclosing, common):
        j = i + 1
        while j < end:
            at, name, values, raw = j, self.s[j].strip("`"), None, None
            j += 1
            if j < end and self.s[j] == "(" and not self.line_break(j):
                k = self.end_of(j)
                values, j = self.without_comments(j + 1, k), k + 1
            if j < end and self.s[j] == "=":
                k = self.expression_end(j + 1, end)
                raw, j = self.without_comments(j + 1, k), k
            self.add("enum_case", at, **common | {"first": at, "name": name, "value": raw, "type_text": values})
            if j < end and self.s[j] == ",":
                j += 1
                continue
            break
        return j

    def statement(self, i: int, end: int, enclosing: str | None) -> int:
        """One statement outside bodies: its calls are facts too."""
        k = max(self.expression_end(i, end), i + 1)
        self.calls(i, k, enclosing)
        return k

    def locals(self, a: int, b: int, owner: str | None) -> None:
        """Bindings and assignments inside bodies: let x = 1, if let y, z = 2, z += 3."""
        i = a
        while i < b:
            if self.s[i] in ("let", "var") and i + 1 < b:
                j, kind, value = i + 2, None, None
                if self.s[i + 1] == "(" or not re.match(r"[^\W\d]|`", self.s[i + 1] or "\n"):
                    i += 1
                    continue
                if self.s[j] == ":":
                    k = self.type_end(j + 1, ("=", "{", "in", "else"))
                    kind, j = self.without_comments(j + 1, k), k
                if j < b and self.s[j] == "=":
                    k = min(self.expression_end(j + 1, b), next((q for q in self._flat(j + 1, b) if self.s[q] == "else"), b))
                    k = next((q for q in range(j + 1, k) if self.s[q] == "{" and self.s[i - 1] in ("if", "while", ",", "guard")), k)
                    value = self.without_comments(j + 1, k)
                self.add("binding", i, name=self.s[i + 1].strip("`"), keyword=self.s[i], type_text=kind, value=value, owner=owner)
            elif (self.s[i] == "=" or (self.t.kinds[i] == KINDS["BINARY"] and re.fullmatch(r"[-+*/%&|^]=|<<=|>>=|\?\?=", self.s[i] or ""))) and i > a:
                q = i - 1
                while q > a and not self.line_break(q) and self.s[q - 1] not in ("{", ";", "}", "let", "var", ":", ",", "(", "in"):
                    q -= 1
                # The value of a binding was seen with it.
                if self.s[q - 1] not in ("let", "var", ":", ",", "(") and self.s[q] not in ("let", "var", "if", "guard", "while", "case"):
                    self.add("assignment", q, name=self.without_comments(q, i), keyword=self.s[i], value=self.without_comments(i + 1, self.expression_end(i + 1, b)), owner=owner)
            i += 1

    def calls(self, a: int, b: int, owner: str | None) -> None:
        """Calls among the tokens a .. b - 1: callee as written, argument labels (null for none)."""
        self.locals(a, b, owner)
        for j in range(a, b):
            if self.s[j] != "(" or self.line_break(j) or j == a or j in self.heads:
                continue
            p = j - 1
            if (self.s[p] in _STATEMENTS and not (self.s[p] in ("init", "Self", "self") and self.s[p - 1] == ".")) or not re.match(r"[^\W\d`]|`|[>?!]", self.s[p] or "\n") or self.t.first[j] != 2:
                continue
            q = p
            while q >= a and self.s[q] in ("?", "!", ">"):
                q -= 1
            if q < a or not re.match(r"[^\W\d]|`", self.s[q] or "\n") or (q and self.s[q - 1] in ("func", "@", "case")):
                continue
            while q - 2 >= a and self.s[q - 1] in (".", "?", "!"):
                step = 1
                while q - step >= a and self.s[q - step] in (".", "?", "!"):
                    step += 1
                if not re.match(r"[^\W\d]|`", self.s[q - step] or "\n"):
                    break
                q -= step
            labels = [self.s[x].strip("`") if y - x > 1 and self.s[x + 1] == ":" else None for x, y in self.split(j + 1, self.end_of(j))]
            self.add("call", q, name=self.s[p].strip("`") if self.s[p] not in ("?", "!", ">") else None, value=re.sub(r"\s+", "", self.source(q, j)), labels=labels, owner=owner)

    def branches(self) -> None:
        stack: list[list[str]] = []
        open_: list[dict] = []
        for i in range(self.n):
            d = next((w for w in ("#if", "#elseif", "#else", "#endif") if self.t.kinds[i] == KINDS[w]), None)
            if d is None:
                continue
            line, col = self.place(self.at[i])
            if d != "#if" and open_ and stack:
                open_[-1] |= {"end_line": line, "end_col": col}
                open_.pop()
            if d == "#endif":
                stack and stack.pop()
                continue
            cond = re.sub(r"//.*|/\*.*?\*/", "", re.match(r"#\w+([^\r\n]*)", self.text[self.at[i] :]).group(1)).strip() if d != "#else" else ""
            if d == "#if":
                stack.append([])
            row = self.add("branch", i, name=cond, preceding=list(stack[-1]) if stack else [], end_line=line, end_col=col)
            open_.append(row)
            if stack:
                stack[-1].append(cond)


def facts(path: str, text: str | None) -> list[dict]:
    """All facts of one text, by place. A null or empty text has none; a text that is not valid gives what can be read."""
    if not text:
        return []
    f = _File(path, text)
    f.declarations(0, f.n, None)
    f.branches()
    rows = sorted(f.rows, key=lambda r: (r["utf8_offset"], r["kind"]))
    for n, r in enumerate(rows):
        r["seq"] = n
    return rows


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # A batch of texts has many times its rows in facts; few files at a time keep those of a worker small.
    for b in (b[k : k + 500] for b in batches for k in range(0, len(b), 500)):
        rows = [r for p, t in zip(b["path"], b["text"]) for r in facts(p, t)]
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in ("line", "col", "seq", "body_line_count", "await_count", "cyclomatic_complexity", "end_line", "end_col"):
            out[c] = out[c].astype("Int32")
        yield out


def read_facts(files: DataFrame) -> DataFrame:
    """The facts of Swift files (path, text), parsed where they are read; write them as Parquet and query that."""
    return files.where("path is not null and text is not null").select("path", "text").mapInPandas(_facts, SCHEMA)


def view(facts_: DataFrame, kind: str, *keywords: str) -> DataFrame:
    """One table of the facts, such as view(f, 'type', 'class')."""
    df = facts_.where(F.col("kind") == kind)
    return df.where(F.col("keyword").isin(*keywords)) if keywords else df
