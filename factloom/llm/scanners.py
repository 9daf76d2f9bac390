"""Tokens of Python, C and JSON texts: comment- and string-aware scanners for the grammars."""

from __future__ import annotations

import re
import unicodedata

from factloom.sources.lexers import _MARKER, BAD, MARKER, OPEN_COMMENT, OPEN_STRING, STRAY, Tokens, words_of

_JSON = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<mark>[{}\[\],:])|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true\b|false\b|null\b)')


def json_tokens(text: str, kinds: dict[str, int]) -> Tokens:
    t = Tokens()
    at, fresh, n = (1 if text.startswith("﻿") else 0), True, len(text)
    while at < n:
        m = _JSON.match(text, at)
        if m is None:
            marker = fresh and (at == 0 or text[at - 1] in "\r\n") and _MARKER.match(text, at)
            t.bad(at, fresh, MARKER if marker else OPEN_STRING if text[at] == '"' else STRAY)
            break
        what = m.lastgroup
        if what == "space":
            fresh = fresh or "\n" in m.group() or "\r" in m.group()
        else:
            t.add(kinds[m.group() if what == "mark" else what.upper()], at, fresh)
            fresh = False
        at = m.end()
    t.add(0, n, True)
    return t


_PY = re.compile(
    r"""(?P<space>[ \t\f]+|\\(?:\r\n|\r|\n))|(?P<line>\r\n|\r|\n)|(?P<note>\#[^\r\n]*)
|(?P<string>(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF]|[tT][rR]?)?(?:'''|\"{3}|'|\"))
|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))
|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=])""",
    re.X,
)
_PY_MORE = re.compile(r"\w*")
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_BODIES = {q: re.compile((r"(?:[^\\" + q[0] + r"]|\\[\s\S]|" + q[0] + r"(?!" + q[0] * 2 + r"))*" if len(q) == 3 else r"(?:[^\\\r\n" + q + r"]|\\(?:\r\n|[\s\S]))*") + q) for q in ("'", '"', "'''", '"""')}


_PY_FIELD = re.compile(r"""(?P<string>(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF]|[tT][rR]?)?(?:'''|\"{3}|'|\"))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)|(?P<note>\#[^\r\n]*)|(?P<rest>\w+|[\s\S])""")


def _field_string_end(text: str, at: int, quote: str, raw: bool) -> int:
    """The end of a string with replacement fields, whose expressions may hold strings of the same quotes; -1 without one.

    A stack holds what is open: strings, fields with their brackets, and formats, innermost last.
    """
    n = len(text)
    stack: list[list] = [["text", quote, raw, len(quote) == 3]]
    while at < n:
        top = stack[-1]
        if top[0] != "field":
            c = text[at]
            if top[0] == "text" and text.startswith(top[1], at):
                stack.pop()
                at += len(top[1])
                if not stack:
                    return at
            elif c == "\\" and not (top[2] and text[at + 1 : at + 2] in ("{", "}")):
                at += 3 if text.startswith("\r\n", at + 1) else 2
            elif c in "\r\n" and not top[3]:
                return -1
            elif top[0] == "text" and text.startswith("{{", at):
                at += 2
            else:
                if c == "{":
                    stack.append(["field", 0, top[2], top[3]])
                elif c == "}" and top[0] == "format":
                    stack.pop()
                at += 1
            continue
        m = _PY_FIELD.match(text, at)
        what, at = m.lastgroup, m.end()
        if what == "string":
            q = m.group().lstrip("rRbBuUfFtT")
            p = m.group()[: -len(q)].lower()
            if "f" in p or "t" in p:
                stack.append(["text", q, "r" in p, len(q) == 3])
            else:
                e = _PY_BODIES[q].match(text, at)
                if not e:
                    return -1
                at = e.end()
        elif what == "open":
            top[1] += 1
        elif what == "close":
            if top[1]:
                top[1] -= 1
            elif m.group() == "}":
                stack.pop()
            else:
                return -1
        elif what == "colon" and not top[1]:
            stack[-1] = ["format", None, top[2], top[3]]
    return -1


def python_tokens(text: str, kinds: dict[str, int]) -> Tokens:
    t = Tokens()
    at, n, depth, indents = (1 if text.startswith("﻿") else 0), len(text), 0, [0]
    newline, indent, dedent = kinds["NEWLINE"], kinds["INDENT"], kinds["DEDENT"]
    word, name_kind = words_of(kinds).get, kinds["NAME"]
    fresh, empty = True, True  # at a line's start; no token on this logical line yet
    while at < n:
        if fresh and not depth:
            m = _PY_INDENT.match(text, at)
            at = m.end()
            fresh = False
            if at < n and text[at] not in "#\r\n":
                if at == m.start() and _MARKER.match(text, at):
                    t.bad(at, True, MARKER)
                    break
                width = len(m.group().expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    t.add(indent, at, True)
                while width < indents[-1]:
                    indents.pop()
                    t.add(dedent, at, True)
                if width != indents[-1]:
                    t.bad(at, True, "this indentation fits no block")
                    break
            continue
        m = _PY.match(text, at)
        if m is None:
            t.bad(at, False, STRAY)
            break
        what, start, at = m.lastgroup, at, m.end()
        if what in ("space", "note"):
            continue
        if what == "line":
            if not depth:
                if not empty:
                    t.add(newline, start, False)
                fresh = empty = True
            elif _MARKER.match(text, at) and text[at] != "=":
                t.bad(at, True, MARKER)
                break
            continue
        empty = False
        if what == "string":
            q = m.group().lstrip("rRbBuUfFtT")
            prefix = m.group()[: -len(q)].lower()
            end = _field_string_end(text, at, q, "r" in prefix) if "f" in prefix or "t" in prefix else -1
            if end < 0:
                e = _PY_BODIES[q].match(text, at)
                end = e.end() if e else -1
            if end < 0:
                t.bad(start, False, OPEN_STRING)
                break
            at = end
            t.add(kinds["STRING"], start, False)
        elif what == "name":
            # Marks that combine with letters go on with a name.
            while at < n and text[at] > "\u02ff" and unicodedata.category(text[at])[0] == "M":
                at = _PY_MORE.match(text, at + 1).end()
            t.add(word(text[start:at], name_kind), start, False)
        elif what == "number":
            t.add(kinds["NUMBER"], start, False)
        else:
            s = m.group()
            depth += (s in "([{") - (s in ")]}")
            depth = max(depth, 0)
            t.add(kinds.get(s, BAD), start, False)
    if not t.errors:
        if not empty:
            t.add(newline, n, False)
        for _ in indents[1:]:
            t.add(dedent, n, False)
    t.add(0, n, True)
    return t


_C = re.compile(
    r"""(?P<space>[ \t\f\v]+|\\(?:\r\n|\r|\n))|(?P<line>\r\n|\r|\n)|(?P<note>//(?:[^\r\n\\]|\\(?:\r\n|[\s\S]))*)|(?P<block>/\*)
|(?P<string>(?:u8|[LuU])?\")|(?P<char>(?:[LuU])?'(?:[^'\\\r\n]|\\[^\r\n])+')
|(?P<number>(?:0[xX][0-9a-fA-F']*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|\.?\d(?:[\d']|\.|[eE][+-]?)*)[uUlLfFzZ]*(?!\w))
|(?P<name>[^\W\d]\w*)|(?P<hash>\#)|(?P<op><<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~<>()\[\]{},:.;=?!])""",
    re.X,
)
_C_STRING = re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"')
_C_DIRECTIVE = re.compile(r"#[ \t]*(\w*)((?:[^\r\n\\/]|\\(?:\r\n|[\s\S])|/(?![*/])|/\*[\s\S]*?\*/|//[^\r\n]*)*)")
_C_DIRECTIVES = {"", "include", "define", "undef", "pragma", "error", "warning", "line", "import", "include_next", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif"}


#: Names in capitals or with two underscores are written as macros, which may stand for anything.
_C_MACRO = re.compile(r"[A-Z_][A-Z0-9_]{2,}|__\w+")
_C_PLUS = re.compile(r"(?:ifdef|if\s+defined)\s*\(?\s*__cplusplus\s*\)?\s*$")
_C_ELSE = re.compile(r"^[ \t]*#[ \t]*(?:else|elif)", re.M)
_C_NEVER, _C_ALWAYS = re.compile(r"0+\s*$|false\s*$"), re.compile(r"0*1\s*$|true\s*$")


def c_tokens(text: str, kinds: dict[str, int], branch: int = 0) -> Tokens:
    """Preprocessor lines are checked here (known names, matched conditions). Of each condition one branch is taken: the
    first, or with branch = k the k-th after it, if it has so many; what #if 0 leaves out is never taken."""
    t = Tokens()
    at, n, fresh = (1 if text.startswith("﻿") else 0), len(text), True
    words, name_kind, macro = words_of(kinds), kinds["NAME"], kinds["MACROID"]
    word = words.get
    conditions: list[list[int]] = []  # the number of the branch that is read, and of the one that is taken
    while at < n:
        m = _C.match(text, at)
        if m is None:
            t.bad(at, fresh, STRAY)
            break
        what, start, at = m.lastgroup, at, m.end()
        if what == "space":
            continue
        if what == "line":
            fresh = True
            continue
        if what == "note":
            continue
        if what == "block":
            at = text.find("*/", at) + 2
            if at < 2:
                t.bad(start, fresh, OPEN_COMMENT)
                break
            continue
        if what == "hash" and fresh:
            d = _C_DIRECTIVE.match(text, start)
            at, name, rest = d.end(), d.group(1), d.group(2).strip()
            if name not in _C_DIRECTIVES or name in ("if", "ifdef", "ifndef", "elif", "define", "include", "undef") and not rest or name in ("ifdef", "ifndef", "undef") and not re.match(r"[A-Za-z_]\w*", rest):
                t.bad(start, True, "unknown compiler directive" if name not in _C_DIRECTIVES else "the directive is not complete")
                break
            if name.startswith("if"):
                never = name == "if" and _C_NEVER.match(rest) or _C_PLUS.match(f"{name} {rest}")
                taken = branch + 1 if never else 0 if name == "if" and _C_ALWAYS.match(rest) else branch
                conditions.append([0, taken])
            elif name in ("endif", "else") or name.startswith("elif"):
                if not conditions:
                    t.bad(start, True, f"#{name} without #if")
                    break
                if name == "endif":
                    conditions.pop()
                else:
                    conditions[-1][0] += 1
            continue
        other = any(a != b for a, b in conditions)
        if what == "string":
            e = _C_STRING.match(text, at)
            if not e:
                t.bad(start, fresh, OPEN_STRING)
                break
            at = e.end()
            if not other:
                t.add(kinds["STRING"], start, fresh)
        elif fresh and m.group()[0] in "<>=|" and _MARKER.match(text, start) and (start == 0 or text[start - 1] in "\r\n"):
            t.bad(start, True, MARKER)
            break
        elif not other:
            if what == "name":
                s = m.group()
                t.add(word(s, name_kind) if s in words or not _C_MACRO.fullmatch(s) else macro, start, fresh, s)
            elif what in ("number", "char"):
                t.add(kinds["NUMBER"], start, fresh)
            else:
                t.add(kinds.get(m.group(), BAD), start, fresh)
        fresh = False
    if conditions and not t.errors:
        t.bad(n, True, "#endif is missing")
    t.add(0, n, True)
    return t


def c_branches(text: str) -> int:
    """How many branches the condition with most of them has; 1 without #else and #elif."""
    if not _C_ELSE.search(text):
        return 1
    most, open_ = 1, []
    for m in re.finditer(r"^[ \t]*#[ \t]*(if\w*|elif\w*|else|endif)", text, re.M):
        if m.group(1).startswith("if"):
            open_.append(1)
        elif m.group(1) == "endif":
            open_ and open_.pop()
        elif open_:
            open_[-1] += 1
            most = max(most, open_[-1])
    return most
