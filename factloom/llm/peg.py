"""Packrat parsing-expression grammars over token streams, compiled to Python functions.

A grammar is text: one rule a line (continued on indented lines), Name = expression, with sequences, ordered choice /,
* + ?, the predicates & and !, groups, 'literal' tokens and upper-case token classes. NL, SL and TIGHT are zero-width:
the next token is the first of its line, is not, or touches the one before. Rules that are named in several places keep their results by position
(packrat), so parsing takes time linear in the tokens; alternatives whose possible first tokens exclude the next token
are skipped, which changes no result. A parse must consume the whole input; if it can't, the furthest token at which a
terminal failed is the position of the error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PART = re.compile(r"\s+|('(?:[^'\\]|\\.)+')|([A-Za-z_][A-Za-z_0-9]*)|([/*+?&!()])")

EOF = "EOF"


@dataclass
class Grammar:
    """A compiled grammar. parse(kinds, new_line) gives -1, or the index of the furthest token that did not fit."""

    name: str
    kinds: dict[str, int]
    source: str
    parse: object = field(repr=False)
    rules: dict = field(repr=False)
    sets: dict = field(repr=False)

    def expected(self, kinds: list[int], first: list[int], far: int) -> set[str]:
        """What would have fitted at the token far, where a parse failed: literals, token classes, and rules in place of
        all that they may begin with. Walks the grammar over the tokens before, with results kept by position."""
        return _Expected(self, kinds, first, far).found


class _Reader:
    def __init__(self, text: str):
        self.items = []
        at = 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            at = m.end()
            if m.lastgroup is None and m.lastindex:
                self.items.append((m.lastindex, m.group(m.lastindex)))
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else (0, "")

    def choice(self):
        alts = [self.seq()]
        while self.peek() == (3, "/"):
            self.at += 1
            alts.append(self.seq())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def seq(self):
        parts = []
        while self.peek()[0] and self.peek()[1] not in ("/", ")"):
            parts.append(self.prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix(self):
        kind, text = self.peek()
        if kind == 3 and text in "&!":
            self.at += 1
            return ("and" if text == "&" else "not", self.suffix())
        return self.suffix()

    def suffix(self):
        x = self.primary()
        while self.peek()[0] == 3 and self.peek()[1] in "*+?":
            x = ({"*": "star", "+": "plus", "?": "opt"}[self.peek()[1]], x)
            self.at += 1
        return x

    def primary(self):
        kind, text = self.peek()
        self.at += 1
        if kind == 1:
            return ("tok", text[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
        if kind == 2:
            return ("zero", text) if text in ("NL", "SL", "TIGHT") else ("tok", text) if text.isupper() else ("rule", text)
        if text == "(":
            x = self.choice()
            if self.peek()[1] != ")":
                raise ValueError("grammar: ) is missing")
            self.at += 1
            return x
        raise ValueError(f"grammar: unexpected {text!r}")


def compile_grammar(name: str, text: str, sets: dict[str, list[str]] | None = None) -> Grammar:
    """sets: upper-case names that stand for any of several tokens."""
    sets = sets or {}
    rules: dict[str, object] = {}
    for line in re.split(r"\n(?=\S)", text.strip()):
        if line.startswith("--"):
            continue
        head, _, body = line.partition("=")
        rules[head.strip()] = _Reader(body).choice()
    kinds: dict[str, int] = {EOF: 0}

    def kind(t: str) -> int:
        return kinds.setdefault(t, len(kinds))

    def members(t: str) -> list[int]:
        return [kind(x) for x in sets[t]] if t in sets else [kind(t)]

    uses: dict[str, int] = {}

    def count(x):
        if x[0] == "rule":
            if x[1] not in rules:
                raise ValueError(f"{name}: no rule {x[1]}")
            uses[x[1]] = uses.get(x[1], 0) + 1
        elif x[0] == "tok":
            members(x[1])
        elif x[0] in ("choice", "seq"):
            for y in x[1]:
                count(y)
        elif x[0] != "zero":
            count(x[1])

    for x in rules.values():
        count(x)
    #: name -> (first tokens, may be empty); None as first: any token
    firsts: dict[str, tuple[frozenset, bool]] = {r: (frozenset(), False) for r in rules}

    def first(x) -> tuple[frozenset, bool]:
        op = x[0]
        if op == "tok":
            return frozenset(members(x[1])), False
        if op == "rule":
            return firsts[x[1]]
        if op == "seq":
            out, empty = frozenset(), True
            for y in x[1]:
                f, e = first(y)
                out |= f
                if not e:
                    empty = False
                    break
            return out, empty
        if op == "choice":
            fs = [first(y) for y in x[1]]
            return frozenset().union(*[f for f, _ in fs]), any(e for _, e in fs)
        if op in ("star", "opt"):
            return first(x[1])[0], True
        if op == "plus":
            return first(x[1])
        return frozenset(), True  # predicates and zero-width

    changed = True
    while changed:
        changed = False
        for r, x in rules.items():
            f = first(x)
            if f != firsts[r]:
                firsts[r], changed = f, True

    def names_itself(r: str) -> bool:
        seen, todo = set(), [rules[r]]
        while todo:
            x = todo.pop()
            if x[0] == "rule":
                if x[1] == r:
                    return True
                # Only rules that are written out in this one could bring it into itself.
                if uses.get(x[1]) == 1 and x[1] not in seen:
                    seen.add(x[1])
                    todo.append(rules[x[1]])
            elif x[0] in ("choice", "seq"):
                todo += x[1]
            elif x[0] not in ("tok", "zero"):
                todo.append(x[1])
        return False

    consts: dict[frozenset, str] = {}
    out: list[str] = []
    fresh = iter(range(10**9))

    def const(s: frozenset) -> str:
        return consts.setdefault(s, f"S{len(consts)}")

    def test(s: frozenset, p: str) -> str:
        return f"K[{p}] == {next(iter(s))}" if len(s) == 1 else f"K[{p}] in {const(s)}"

    def gen(x, ind: str) -> None:
        """Code that takes p, the position, to the position after x or to -1."""
        op = x[0]
        w = lambda line: out.append(ind + line)
        if op == "tok":
            w(f"if {test(first(x)[0], 'p')}: p += 1")
            w("else:")
            w("    if p > far[0]: far[0] = p")
            w("    p = -1")
        elif op == "zero":
            w(f"if L[p] {dict(NL='!= 1', SL='== 1', TIGHT='!= 2')[x[1]]}:")
            w("    if p > far[0]: far[0] = p")
            w("    p = -1")
        elif op == "rule" and x[1] in inlined:
            gen(rules[x[1]], ind)
        elif op == "rule":
            w(f"p = r_{x[1]}(p)")
        elif op == "seq":
            for k, y in enumerate(x[1]):
                if k:
                    out.append(ind + "if p >= 0:")
                    ind += "    "
                gen(y, ind)
            if not x[1]:
                w("pass")
        elif op == "choice":
            s = f"s{next(fresh)}"
            w(f"{s} = p; p = -1")
            for k, y in enumerate(x[1]):
                f, e = first(y)
                guard = [] if e else [test(f, s)]
                if k:
                    guard.insert(0, "p < 0")
                if guard:
                    w(f"if {' and '.join(guard)}:")
                    w(f"    p = {s}")
                    gen(y, ind + "    ")
                else:
                    w(f"p = {s}")
                    gen(y, ind)
            w(f"if p < 0 and {s} > far[0]: far[0] = {s}")
        elif op in ("star", "plus"):
            if op == "plus":
                gen(x[1], ind)
                w("if p >= 0:")
                ind += "    "
            s = f"s{next(fresh)}"
            f, e = first(x[1])
            w2 = lambda line: out.append(ind + line)
            w2("while True:" if e else f"while {test(f, 'p')}:")
            w2(f"    {s} = p")
            gen(x[1], ind + "    ")
            w2("    if p < 0:")
            w2(f"        p = {s}")
            w2("        break")
            w2(f"    if p == {s}: break")
            w2("if p > far[0]: far[0] = p")
        elif op == "opt":
            s = f"s{next(fresh)}"
            f, e = first(x[1])
            w(f"{s} = p")
            if e:
                gen(x[1], ind)
                w(f"if p < 0: p = {s}")
            else:
                w(f"if {test(f, 'p')}:")
                gen(x[1], ind + "    ")
                w(f"    if p < 0: p = {s}")
                w(f"elif p > far[0]: far[0] = p")
        else:
            s, k = f"s{next(fresh)}", f"k{next(fresh)}"
            w(f"{s} = p; {k} = far[0]")
            gen(x[1], ind)
            w(f"far[0] = {k}")
            if op == "and":
                w("if p >= 0: p = " + s)
                w(f"elif {s} > far[0]: far[0] = {s}")
            else:
                w(f"if p < 0: p = {s}")
                w("else:")
                w(f"    if {s} > far[0]: far[0] = {s}")
                w("    p = -1")

    top = next(iter(rules))
    # A rule that is named in one place only is written out there, which saves the call.
    inlined = {r for r in rules if uses.get(r) == 1 and r != top and not names_itself(r)}
    out.append("def parse(K, L):")
    out.append("    far = [0]")
    for r, x in rules.items():
        if r in inlined:
            continue
        memo = uses.get(r, 0) > 1 and x[0] != "tok"
        if memo:
            out.append(f"    m_{r} = {{}}")
        out.append(f"    def r_{r}(p):")
        if memo:
            out.append(f"        o = m_{r}.get(p)")
            out.append("        if o is not None: return o")
            out.append("        o = p")
        gen(x, "        ")
        if memo:
            out.append(f"        m_{r}[o] = p")
        out.append("        return p")
    out.append(f"    return -1 if r_{top}(0) >= 0 else far[0]")
    source = "\n".join(out)
    scope: dict[str, object] = {v: s for s, v in consts.items()}
    exec(compile(source, f"<grammar {name}>", "exec"), scope)  # noqa: S102 - the code is made above from the grammar
    return Grammar(name, kinds, source, scope["parse"], rules, sets)


class _Expected:
    """The grammar interpreted, for one text that failed: slow, but it knows the names of what it tries."""

    def __init__(self, g: Grammar, kinds: list[int], first: list[int], far: int):
        self.g, self.k, self.l, self.far = g, kinds, first, far
        self.found: set[str] = set()
        self.memo: dict[tuple[str, int], int] = {}
        self.quiet = 0
        self.members = {n: frozenset(g.kinds[x] for x in m if x in g.kinds) for n, m in g.sets.items()}
        self.go(("rule", next(iter(g.rules))), 0)

    def go(self, x, p: int) -> int:
        op = x[0]
        if op == "tok":
            held = self.members.get(x[1])
            if self.k[p] in held if held is not None else self.k[p] == self.g.kinds[x[1]]:
                return p + 1
            if p == self.far and not self.quiet:
                self.found.add(x[1])
            return -1
        if op == "zero":
            return p if {"NL": self.l[p] == 1, "SL": self.l[p] != 1, "TIGHT": self.l[p] == 2}[x[1]] else -1
        if op == "rule":
            # A rule that starts at the place stands for what it begins with.
            here = p == self.far and not self.quiet and x[1] in _WHOLE
            if here:
                self.found.add(x[1])
            key = (x[1], p)
            if (got := self.memo.get(key)) is None or (p == self.far and not self.quiet):
                self.quiet += here
                got = self.memo[key] = self.go(self.g.rules[x[1]], p)
                self.quiet -= here
            return got
        if op == "seq":
            for y in x[1]:
                p = self.go(y, p)
                if p < 0:
                    return -1
            return p
        if op == "choice":
            for y in x[1]:
                if (q := self.go(y, p)) >= 0:
                    return q
            return -1
        if op in ("star", "plus", "opt"):
            n = 0
            while (q := self.go(x[1], p)) >= 0:
                n, moved, p = n + 1, q != p, q
                if not moved or op == "opt":
                    break
            return -1 if op == "plus" and not n else p
        self.quiet += 1
        q = self.go(x[1], p)
        self.quiet -= 1
        return p if (q >= 0) == (op == "and") else -1


#: Rules that are named as a whole.
_WHOLE = {"Expression", "HeadExpression", "Unary", "HeadUnary", "Statement", "Declaration", "Member", "External", "TypeName", "TypeCore", "Pattern", "Block", "Compound", "Closure", "Value", "Test", "Stars", "Named", "Or2", "Or", "Assign", "Conditional", "Cast", "Declarator", "Members"}
