"""Tokens of Swift texts: a comment- and string-aware scanner, and what scanners of other languages share.

A scanner gives kinds, starts and first-of-line flags for a grammar's token numbers, ending in EOF. What cannot be a
token (an open string, an open comment, a merge marker) becomes a token that no grammar takes, with a message.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

OPEN_STRING = "string literal is not closed"
OPEN_COMMENT = "block comment is not closed"
MARKER = "merge marker in source file"
STRAY = "this character starts no token"

BAD = 10**6
#: A merge marker stands at the start of a line: seven signs, then the end of the line or a space.
_MARKER = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?=[ \t\r\n]|$)")
_LINES = re.compile(r"\r\n|\r|\n")


@dataclass
class Tokens:
    kinds: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # 1: first of its line, 2: an opening parenthesis that touches the token before
    texts: list[str] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)  # start and end of each comment
    errors: dict[int, str] = field(default_factory=dict)  # by token index

    def add(self, kind: int, start: int, first: bool, text: str = "") -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.first.append(first)
        self.texts.append(text)

    def bad(self, start: int, first: bool, message: str) -> None:
        self.errors[len(self.kinds)] = message
        self.add(BAD, start, first)


class Places:
    """Line and column, from 1, of offsets; any of the three line ends counts once."""

    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in _LINES.finditer(text)]]

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


#: White space before a token belongs to its match, and a string without interpolation is one match.
_SWIFT = re.compile(
    r"""[ \t\f\v\x00 ]*(?:(?P<line>[\r\n  ]+)|(?P<note>//[^\r\n]*)|(?P<block>/\*)
|(?P<name>[^\W\d][\w]*|\$\w+|`[^`\r\n]+`)
|(?P<number>0x[0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]+)?(?:[pP][+-]?\d[\d_]*)?|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)
|(?P<str>\"(?!\"\")(?:[^\"\\\r\n]|\\[^(\r\n])*\")|(?P<quote>\#*(?:\"{3}|\"))|(?P<regex>\#+/)|(?P<hash>\#[A-Za-z_]\w*|\#!)|(?P<mark>[()\[\]{},;:@\\])|(?P<dots>\.\.[.<]|\.)
|(?P<op>(?:(?!//|/\*)[-+*/=<>!&|^~?%¡-§←-⏿─-❵])+)|(?P<end>\Z))""",
    re.X,
)
_NEST = re.compile(r"/\*|\*/")
_SWIFT_REGEX = re.compile(r"/(?![ \t*/])(?:[^/\\\r\n]|\\[^\r\n])+(?<![ \t])/")
_OPENERS, _CLOSERS = " \t\r\n([{,;:\0", " \t\r\n)]},;:\0"


def block_end(text: str, at: int) -> int:
    """The end of the nesting block comment that starts at at, or -1."""
    depth = 0
    for m in _NEST.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


class _Body:
    """The parts of a Swift string of one delimiter between interpolations."""

    def __init__(self) -> None:
        self.made: dict[tuple[int, bool], re.Pattern] = {}

    def __call__(self, hashes: int, many: bool) -> re.Pattern:
        if (p := self.made.get((hashes, many))) is None:
            h, q = "#" * hashes, '"""' if many else '"'
            plain = r'(?:[^"\\]|"(?!""))' if many and not hashes else r'[^"\\]' if many else r'[^"\\\r\n]'
            # The end, an interpolation, an escape, or one character more.
            p = self.made[(hashes, many)] = re.compile(rf"(?:{plain}|(?!{q}{h})\"|\\(?!{h}\()(?:{h}[\s\S])?)*?(?P<end>{q}{h}|\\{h}\()" if hashes else (
                rf"(?:{plain}|\\[^(])*(?P<end>{q}|\\\()"))
        return p


_body = _Body()


_words: dict[int, tuple[dict, dict]] = {}


def words_of(kinds: dict[str, int]) -> dict[str, int]:
    """The kinds that are words of the language. Classes of tokens are written in capitals; a name that is spelled like
    one is a name."""
    if (held := _words.get(id(kinds))) is None or held[0] is not kinds:
        held = _words[id(kinds)] = kinds, {k: v for k, v in kinds.items() if not k.isupper()}
    return held[1]


def swift_tokens(text: str, kinds: dict[str, int]) -> Tokens:
    t = Tokens()
    get, ident, n = words_of(kinds).get, kinds["IDENT"], len(text)
    at, fresh = (1 if text.startswith("﻿") else 0), True
    if text.startswith("#!", at):
        at = len(text.split("\n", 1)[0])
    match, add = _SWIFT.match, t.add
    put_kind, put_start, put_first, put_text = t.kinds.append, t.starts.append, t.first.append, t.texts.append
    #: open interpolations: (parentheses open, hashes, many)
    stack: list[list] = []
    number, string = kinds["NUMBER"], kinds["STRING"]
    post, pre, binary = kinds["POST"], kinds["PRE"], kinds["BINARY"]
    dot, plain = kinds["."], {"=": kinds["="], "->": kinds["->"]}

    def string_part(start: int, at: int, hashes: int, many: bool, began: bool) -> int:
        """Scans on to the end or an interpolation; gives the place after it, or -1."""
        nonlocal fresh
        m = _body(hashes, many).match(text, at)
        if not m:
            t.bad(start, fresh, OPEN_STRING)
            return -1
        if not many and ("\n" in m.group() or "\r" in m.group()):
            t.bad(start, fresh, OPEN_STRING)
            return -1
        if m.group("end").startswith("\\"):
            add(kinds["STRING_OPEN"] if began else kinds["STRING_MORE"], start, fresh)
            stack.append([0, hashes, many])
        else:
            if many and text[max(text.rfind("\n", 0, m.start("end")), text.rfind("\r", 0, m.start("end"))) + 1 : m.start("end")].strip(" \t"):
                t.bad(m.start("end"), False, "the end of a string of several lines starts its own line")
                return -1
            add(string if began else kinds["STRING_CLOSE"], start, fresh)
        fresh = False
        return m.end()

    while at < n:
        m = match(text, at)
        if m is None:
            t.bad(at, fresh, STRAY)
            break
        what = m.lastgroup
        start, at = m.span(what)
        if what == "name":
            s = m.group(what)
            put_kind(get(s, ident))
            put_start(start)
            put_first(fresh)
            put_text(s)
        elif what == "line":
            fresh = True
            continue
        elif what == "mark":
            s = m.group(what)
            if stack:
                if s == "(":
                    stack[-1][0] += 1
                elif s == ")":
                    if not stack[-1][0]:
                        _, hashes, many = stack.pop()
                        at = string_part(start, at, hashes, many, False)
                        if at < 0:
                            break
                        continue
                    stack[-1][0] -= 1
            put_kind(kinds[s])
            put_start(start)
            put_first(2 if s == "(" and start and text[start - 1] not in " \t\r\n/" else fresh)
            put_text(s)
        elif what == "str":
            add(string, start, fresh)
        elif what == "end":
            break
        elif what == "note":
            t.comments.append((start, at))
            continue
        elif what == "dots":
            s = m.group(what)
            if s == ".":
                put_kind(dot)
                put_start(start)
                put_first(fresh)
                put_text(s)
                fresh = False
                continue
            # Without a value before it, ..< stands before its only one.
            alone = s == "..<" and (start == 0 or text[start - 1] in _OPENERS) and at < n and text[at] not in _CLOSERS
            add(pre if alone else binary if s == "..<" else kinds["..."], start, fresh, s)
        elif what == "number":
            add(number, start, fresh, m.group(what))
        elif what == "quote":
            s = m.group(what)
            hashes, many = s.count("#"), s.endswith('"""')
            if many:
                rest = re.compile(r"[ \t]*(?=[\r\n])").match(text, at)
                if not rest:
                    t.bad(start, fresh, OPEN_STRING if _body(hashes, True).match(text, at) is None else "a string of several lines starts on the line below its quotes")
                    break
            at = string_part(start, at, hashes, many, True)
            if at < 0:
                break
            continue
        elif what == "op":
            s = m.group(what)
            # The commonest operators are the same wherever they stand.
            if s in plain:
                put_kind(plain[s])
                put_start(start)
                put_first(fresh)
                put_text(s)
                fresh = False
                continue
            # No operator of seven such signs stands alone at the start of a line, indented or not.
            if fresh and s[0] in "<>=|" and _MARKER.match(text, start):
                t.bad(start, True, MARKER)
                fresh = False
                at = start + 7
                while at < n and text[at] not in "\r\n":
                    at += 1
                continue
            left = start > 0 and text[start - 1] not in _OPENERS and not (text[start - 1] == "/" and text[start - 2 : start] == "*/")
            if s[0] == "/" and not left and (r := _SWIFT_REGEX.match(text, start)) and not (at < n and text[at] in " \t"):
                at = r.end()
                add(kinds["REGEX"], start, fresh)
                fresh = False
                continue
            if s[0] == ">" and s != ">=" and (left or at < n and text[at] not in " \t\r\n"):
                at, s = start + 1, ">"
            elif s[0] in "?!" and left and s not in ("!=", "??", "!==") or s in ("?", "!"):
                at, s = start + 1, s[0]
            elif s[0] == "<" and len(s) > 1 and left and s not in ("<=", "<<", "<<=", "<-", "<>"):
                at, s = start + 1, "<"
            elif s[0] == "=" and len(s) > 1 and s not in ("==", "===", "=~") and s[1] in "-!&~+" and (at < n and text[at] not in _CLOSERS) and left:
                at, s = start + 1, "="
            right = at < n and text[at] not in _CLOSERS and not text.startswith(("//", "/*"), at)
            if s in "?!" and left:
                add(kinds["?"] if s == "?" else kinds["!"], start, fresh, s)
            elif s == "?":
                add(kinds["TERNARY"], start, fresh, s)
            elif s in ("=", "<", ">", "&"):
                add(kinds[s] if s != "&" or (right and not left) else kinds["AMP"], start, fresh, s)
            else:
                add(binary if left == right else post if left else pre, start, fresh, s)
        elif what == "block":
            at = block_end(text, start)
            if at < 0:
                t.bad(start, fresh, OPEN_COMMENT)
                break
            t.comments.append((start, at))
            if "\n" in text[start:at] or "\r" in text[start:at]:
                fresh = True
            continue
        elif what == "hash":
            s = m.group(what)
            if s in ("#if", "#elseif"):
                line = re.compile(r"[^\r\n]*").match(text, at)
                cond = re.sub(r"//.*|/\*.*?\*/", "", line.group()).strip()
                at = line.end()
                if cond and cond.count("(") == cond.count(")"):
                    add(kinds[s], start, fresh, s)
                else:
                    t.bad(start, fresh, "the condition is missing or not closed")
            else:
                add(get(s, kinds["MACRO"]), start, fresh, s)
        else:  # an extended regular expression
            h = m.group(what)[:-1]
            end = text.find("/" + h, at)
            if end < 0:
                t.bad(start, fresh, "regular expression is not closed")
                break
            at = end + 1 + len(h)
            add(kinds["REGEX"], start, fresh)
        fresh = False
    if stack and (not t.kinds or t.kinds[-1] != BAD):
        t.bad(n, False, OPEN_STRING)
    t.add(0, n, True)
    t.add(0, n, True)
    return t
