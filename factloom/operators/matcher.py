"""Requirements on rows: trees of two-valued predicates with a description and a witness.

A matcher compiles to two columns: ok, never null, and witness, the place that decided (or null). Both are plain
expressions, so Catalyst pushes and fuses them like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

VISIBILITY = ["private", "fileprivate", "internal", "package", "public", "open"]


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def quoted(values: Sequence[str]) -> str:
    return " or ".join(f"'{v}'" for v in values)


@dataclass(frozen=True)
class Matcher:
    """kind: leaf, and, or, not."""

    kind: str
    phrase: str = ""
    test: Callable[[], Column] | None = None
    place: Callable[[], Column] | None = None
    parts: tuple["Matcher", ...] = ()

    def __and__(self, other: "Matcher") -> "Matcher":
        return Matcher("and", parts=(self, other))

    def __or__(self, other: "Matcher") -> "Matcher":
        return Matcher("or", parts=(self, other))

    def __invert__(self) -> "Matcher":
        return Matcher("not", parts=(self,))

    def ok(self) -> Column:
        if self.kind == "leaf":
            return two_valued(self.test())
        p = [x.ok() for x in self.parts]
        return p[0] & p[1] if self.kind == "and" else p[0] | p[1] if self.kind == "or" else ~p[0]

    def witness(self) -> Column:
        """Of 'and' the failing side's witness, the left one first; of 'or' the succeeding side's; 'not' keeps it."""
        if self.kind == "leaf":
            return self.place() if self.place else F.lit(None)
        if self.kind == "not":
            return self.parts[0].witness()
        a, b = self.parts
        left = ~a.ok() if self.kind == "and" else a.ok()
        wa, wb = a.witness(), b.witness()
        return F.when(left, wa).otherwise(wb)

    def description(self, inside_or: bool = False) -> str:
        if self.kind == "leaf":
            return self.phrase
        if self.kind == "and":
            s = " and ".join(p.description(inside_or) for p in self.parts)
            return f"({s})" if inside_or else s
        if self.kind == "or":
            return "(" + " or ".join(p.description(True) for p in self.parts) + ")"
        p = self.parts[0]
        return f"not {p.description()}" if p.kind in ("leaf", "or") else f"not ({p.description()})"


def matcher(phrase: str, test: Callable[[], Column] | Column, place: Callable[[], Column] | None = None) -> Matcher:
    return Matcher("leaf", phrase, test if callable(test) and not isinstance(test, Column) else lambda: test, place)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# Names.


def named(*names: str, name: str = "name") -> Matcher:
    return matcher(f"be named {quoted(names)}", lambda: F.col(name).isin(*names))


def suffixed(*suffixes: str, name: str = "name") -> Matcher:
    return matcher(f"have a name suffixed {quoted(suffixes)}", lambda: _any([F.col(name).endswith(s) for s in suffixes]))


def prefixed(*prefixes: str, name: str = "name") -> Matcher:
    return matcher(f"have a name prefixed {quoted(prefixes)}", lambda: _any([F.col(name).startswith(s) for s in prefixes]))


def whole_name(pattern: str) -> str:
    """Anchors a pattern to the whole name; a pattern that is no pattern is an error here, not in a task."""
    import re

    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no regular expression: {pattern}") from e
    return rf"\A(?:{pattern})\z"


def name_matching(pattern: str, name: str = "name") -> Matcher:
    p = whole_name(pattern)
    return matcher(f"have a name matching /{pattern}/", lambda: F.col(name).rlike(p))


# Members of a row compared with values; nulls are values.


def _rendered(v: Any) -> str:
    return f"'{v}'" if isinstance(v, str) else "nil" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


class field:
    """field('line_count') <= 400 and so on: matchers from comparisons of a column."""

    def __init__(self, path: str):
        self.path, self.label = path, path.split(".")[-1]

    def _leaf(self, how: str, v: Any, test: Callable[[Column], Column]) -> Matcher:
        article = "an" if self.label[:1] in tuple("aeiou") else "a"
        return matcher(f"have {article} {self.label} {how} {_rendered(v)}", lambda: test(F.col(self.path)))

    def __eq__(self, v: Any) -> Matcher:  # type: ignore[override]
        return self._leaf("of", v, lambda c: c.eqNullSafe(v))

    def __ne__(self, v: Any) -> Matcher:  # type: ignore[override]
        return ~(self == v)

    def __le__(self, v: Any) -> Matcher:
        return self._leaf("of at most", v, lambda c: c <= v)

    def __ge__(self, v: Any) -> Matcher:
        return self._leaf("of at least", v, lambda c: c >= v)

    def __lt__(self, v: Any) -> Matcher:
        return self._leaf("under", v, lambda c: c < v)

    def __gt__(self, v: Any) -> Matcher:
        return self._leaf("over", v, lambda c: c > v)

    def is_true(self) -> Matcher:
        return matcher(f"have {self.label} be true", lambda: F.col(self.path))

    __hash__ = None


# Members of a row that are arrays.


def all_members(column: str, phrase: str, test: Callable[[Column], Column]) -> Matcher:
    """Empty and null lists pass. The witness is the first member that fails."""
    f = lambda x: two_valued(test(x))
    return matcher(f"have all selected members {phrase}", lambda: F.coalesce(F.forall(F.col(column), f), F.lit(True)), lambda: F.try_element_at(F.filter(F.col(column), lambda x: ~f(x)), F.lit(1)))


def any_member(column: str, phrase: str, test: Callable[[Column], Column]) -> Matcher:
    """Empty and null lists fail. The witness is the first member that matches."""
    f = lambda x: two_valued(test(x))
    return matcher(f"have any selected members {phrase}", lambda: F.exists(F.col(column), f), lambda: F.try_element_at(F.filter(F.col(column), f), F.lit(1)))


def no_member(column: str, phrase: str, test: Callable[[Column], Column]) -> Matcher:
    return ~any_member(column, phrase, test)


# Declarations.


def bare(entry: Column) -> Column:
    """An inheritance entry without leading attributes."""
    return F.regexp_replace(entry, r"^(?:@\S+\s+)*", "")


def _holds(arrays: list[str], names: Sequence[str]) -> Column:
    return _any([F.coalesce(F.exists(F.col(a), lambda x: two_valued(x.isin(*names) | bare(x).isin(*names))), F.lit(False)) for a in arrays])


def inherits(*names: str, closure: str = "all_inherited") -> Matcher:
    return matcher(f"inherit from {quoted(names)}", lambda: _holds([closure], names))


def conforms(*names: str, closure: str = "all_inherited") -> Matcher:
    return matcher(f"conform to {quoted(names)}", lambda: _holds([closure], names))


def directly_inherits(*names: str, inherited: str = "inherited") -> Matcher:
    return matcher(f"directly inherit from {quoted(names)}", lambda: _holds([inherited], names))


def directly_conforms(*names: str, inherited: str = "inherited", ext_inherited: str | None = None) -> Matcher:
    return matcher(f"directly conform to {quoted(names)}", lambda: _holds([inherited, *([ext_inherited] if ext_inherited else [])], names))


def declares_inheritance(entry: str, inherited: str = "inherited") -> Matcher:
    return matcher(f"declare '{entry}' in the inheritance clause", lambda: F.array_contains(F.col(inherited), entry))


def is_public(visibility: str = "visibility") -> Matcher:
    return matcher("be public", lambda: F.col(visibility).isin("public", "open"))


def visibility_rank(visibility: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VISIBILITY]), visibility) - 1


def has_visibility(at_least: str, visibility: str = "visibility") -> Matcher:
    k = VISIBILITY.index(at_least)
    return matcher(f"be at least as visible as '{at_least}'", lambda: visibility_rank(F.col(visibility)) >= k)


def has_attribute(*names: str, attributes: str = "attributes") -> Matcher:
    plain = [n.lstrip("@") for n in names]
    return matcher("have the attribute " + " or ".join("@" + n for n in plain), lambda: F.exists(F.col(attributes), lambda a: two_valued(a["name"].isin(*plain))))


def flag(phrase: str, column: str) -> Matcher:
    """is_final, is_async and the like."""
    return matcher(f"be {phrase}", lambda: F.col(column))


def is_keyword(keyword: str, column: str = "keyword") -> Matcher:
    return matcher(f"be {'an' if keyword[0] in 'aeiou' else 'a'} {keyword}", lambda: F.col(column) == keyword)


def has_documentation(column: str = "documentation") -> Matcher:
    return matcher("have a documentation comment", lambda: F.col(column).isNotNull())


def returns(type_text: str, column: str = "return_type") -> Matcher:
    return matcher(f"return '{type_text}'", lambda: F.col(column).eqNullSafe(type_text))


def returns_optional(column: str = "return_type") -> Matcher:
    return matcher("return an optional", lambda: F.col(column).rlike(r"(?:\?|^Optional<.*>)$"))


def has_parameter(typed: str | None = None, labelled: str | None = None, referencing: Sequence[str] = (), parameters: str = "parameters") -> Matcher:
    """Exactly one of the three; referencing finds a type name at any depth of generic arguments."""
    if typed is not None:
        return matcher(f"have a parameter of type '{typed}'", lambda: F.exists(F.col(parameters), lambda p: p["type_text"].eqNullSafe(typed)))
    if labelled is not None:
        return matcher(f"have a parameter labelled '{labelled}'", lambda: F.exists(F.col(parameters), lambda p: p["label"].eqNullSafe(labelled)))
    return matcher(f"have a parameter referencing {quoted(referencing)}", lambda: F.exists(F.col(parameters), lambda p: two_valued(references_type(p["type_text"], referencing))))


def references_type(type_text: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(type_text, F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)), F.array(*[F.lit(n) for n in names]))


def has_type(*names: str, column: str = "type_text") -> Matcher:
    return matcher(f"have the type {quoted(names)}", lambda: F.regexp_extract(F.col(column), r"^\s*([\p{L}_][\p{L}\p{N}_.]*)", 1).isin(*names))


def calls(*identifiers: str, column: str = "calls") -> Matcher:
    """A call of one of the identifiers; the witness is the first such call."""
    test = lambda c: two_valued(_any([call_references(c["called"], c["labels"], i) for i in identifiers]))
    return matcher(f"call {quoted(identifiers)}", lambda: F.exists(F.col(column), test), lambda: F.try_element_at(F.filter(F.col(column), test), F.lit(1)))


def call_references(called: Column, labels: Column, identifier: str) -> Column:
    """'a', 'a.b' (a run of the callee's parts) or 'a(x:_:)' (labels must be equal); ? and ! are not looked at."""
    head, _, rest = identifier.partition("(")
    want = [p for p in head.replace("?", "").replace("!", "").split(".") if p]
    parts = F.split(F.regexp_replace(called, "[?!]", ""), r"\.")
    wanted = F.array(*[F.lit(w) for w in want])
    ok = F.array_contains(parts, want[0]) if len(want) == 1 else F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - len(want) + 1, F.lit(1))), lambda i: F.slice(parts, i, F.lit(len(want))) == wanted)
    if rest:
        expected = [x for x in rest.rstrip(")").split(":") if x]
        ok = ok & (F.transform(labels, lambda x: F.coalesce(x, F.lit("_"))) == (F.array(*[F.lit(x) for x in expected]) if expected else F.array().cast("array<string>")))
    return ok


# Modifiers, attributes and members of facts.


def has_modifier(word: str, phrase: str | None = None, modifiers: str = "modifiers") -> Matcher:
    """A modifier as written, or with its argument in parentheses: 'unowned' also takes 'unowned(safe)'."""
    return matcher(f"be {phrase or word}", lambda: F.exists(F.col(modifiers), lambda m: two_valued((m == word) | m.startswith(word + "("))))


def is_override() -> Matcher:
    return has_modifier("override", "an override")


def is_mutating() -> Matcher:
    return has_modifier("mutating")


def is_dynamic() -> Matcher:
    return has_modifier("dynamic")


def is_nonisolated(unsafe: bool | None = None, modifiers: str = "modifiers") -> Matcher:
    """unsafe: nonisolated(unsafe) alone (True), nonisolated alone (False), or either."""
    words = {True: ["nonisolated(unsafe)"], False: ["nonisolated"], None: ["nonisolated", "nonisolated(unsafe)"]}[unsafe]
    return matcher(f"be {quoted(words) if unsafe is None else words[0]}", lambda: F.exists(F.col(modifiers), lambda m: two_valued(m.isin(*words))))


def is_weak() -> Matcher:
    return has_modifier("weak")


def is_lazy() -> Matcher:
    return has_modifier("lazy")


def is_indirect() -> Matcher:
    return has_modifier("indirect")


def is_convenience() -> Matcher:
    return has_modifier("convenience", "a convenience initializer")


def is_static() -> Matcher:
    return has_modifier("static")


def has_attribute_argument(name: str, argument: str, attributes: str = "attributes") -> Matcher:
    """An attribute whose arguments, as written, hold this one as a whole."""
    plain = name.lstrip("@")
    held = lambda a: F.array_contains(F.transform(F.split(a["arguments"], r",(?![^(\[{]*[)\]}])"), lambda x: F.trim(x)), argument)
    return matcher(f"have the attribute @{plain} with '{argument}'", lambda: F.exists(F.col(attributes), lambda a: two_valued((a["name"] == plain) & held(a))))


def attribute(name: str, attributes: str = "attributes") -> Column:
    """The first attribute of a name, null without one."""
    return F.try_element_at(F.filter(F.col(attributes), lambda a: two_valued(a["name"] == name.lstrip("@"))), F.lit(1))


def has_optional_type(column: str = "type_text") -> Matcher:
    return matcher("have an optional type", lambda: F.col(column).rlike(r"(?:[?!]|^Optional\s*<.*>)\s*$"))


def has_argument_label(*labels: str, column: str = "labels") -> Matcher:
    return matcher(f"have an argument labelled {quoted(labels)}", lambda: F.exists(F.col(column), lambda x: two_valued(x.isin(*labels))))


def imports(*modules: str, column: str = "imports") -> Matcher:
    """Of a file with its imported modules, see with_imports."""
    return matcher(f"import {quoted(modules)}", lambda: F.exists(F.col(column), lambda x: two_valued(x.isin(*modules))))


def grouped(phrase: str, inner: Matcher) -> Matcher:
    """A named requirement: one phrase for a tree of matchers, its witness kept."""
    return matcher(phrase, inner.ok, inner.witness)
