"""Functions of Swift texts paired with their documentation comments.

The scanner tells strings and comments apart; braces are matched on its tokens, so a function is known to stand at file
level or in a type, extension or protocol; the documentation comments between the previous token and the function's
own attributes and modifiers belong to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from factloom.llm import grammars
from factloom.sources.lexers import Places, Tokens


@dataclass(frozen=True)
class Found:
    line: int
    col: int
    name: str
    signature: str
    labels: tuple[str | None, ...]
    names: tuple[str, ...]
    documentation: str  # as written
    code: str


_TYPES = {"class", "struct", "enum", "actor", "extension", "protocol"}
_MODIFIERS = set("public private internal fileprivate open package static class final override mutating nonmutating required convenience dynamic optional nonisolated isolated distributed prefix postfix infix borrowing consuming unsafe __owned __shared".split())
_DECLARES = {"func", "var", "let", "subscript", "init", "class", "struct", "enum", "actor", "protocol", "extension", "typealias", "case", "import"}


def _is_doc(text: str, start: int, end: int) -> bool:
    if text.startswith("///", start):
        return not text.startswith("////", start)
    return text.startswith("/**", start) and end - start > 4 and text[start + 3] not in "*/"


def functions(text: str, t: Tokens | None = None) -> list[Found]:
    """The functions outside function bodies that have a documentation comment, in order; the text has to be valid."""
    t = t or grammars.scan(text, "swift")
    k = grammars.grammar("swift")[0].kinds
    texts, starts, n = t.texts, t.starts, len(t.kinds) - 2
    lb, rb, lp, rp, at_sign = k["{"], k["}"], k["("], k[")"], k["@"]
    comment_starts = [c[0] for c in t.comments]
    place = None
    stack: list[bool] = []  # of each open brace: is it the body of a type?
    pending, found = False, []
    parens = 0
    for i in range(n):
        kind = t.kinds[i]
        if kind == lb:
            stack.append(pending and not parens)
            if not parens:
                pending = False
        elif kind == rb:
            if stack:
                stack.pop()
        elif kind == lp:
            parens += 1
        elif kind == rp:
            parens = max(0, parens - 1)
        elif parens and not stack:
            continue
        elif texts[i] in _TYPES and all(stack):
            nxt = texts[i + 1]
            before = texts[i - 1] if i else ""
            if nxt and nxt not in _MODIFIERS and nxt not in ("func", "var", "let", "subscript", "init", "case") and before not in (".", ":", ",") and (nxt[0].isalpha() or nxt[0] in "_`$"):
                pending = True
        elif texts[i] == "func" and all(stack) and (not i or texts[i - 1] not in (".", "import")):
            pending = False
            # Back over modifiers and attributes to where the declaration starts.
            first = i
            while first > 0:
                p = first - 1
                if texts[p] in _MODIFIERS:
                    first = p
                    continue
                if t.kinds[p] == rp:  # arguments of an attribute, or private(set)
                    depth, q = 1, p
                    while q > 0 and depth:
                        q -= 1
                        depth += (t.kinds[q] == rp) - (t.kinds[q] == lp)
                    if q > 0 and texts[q - 1] in _MODIFIERS:
                        first = q - 1
                        continue
                    p = q - 1
                # a possibly dotted attribute name
                q = p
                while q > 1 and texts[q] and t.kinds[q - 1] == k["."]:
                    q -= 2
                if q > 0 and t.kinds[q - 1] == at_sign and texts[q]:
                    first = q - 1
                    continue
                break
            low = starts[first - 1] if first else -1
            low_end = low + len(texts[first - 1]) if first else 0
            docs = []
            for c in t.comments[bisect_left(comment_starts, low) : bisect_left(comment_starts, starts[i])]:
                # A comment that ends the line of the previous token belongs to that token.
                if first and "\n" not in text[low_end : c[0]] and "\r" not in text[low_end : c[0]]:
                    continue
                if _is_doc(text, *c):
                    docs.append(c)
            if not docs:
                continue
            place = place or Places(text)
            # name, then parameters
            j = i + 1
            name = texts[j].strip("`")
            while t.kinds[j] != lp and j < n:
                j += 1
                if t.kinds[j] != lp and not name[:1].isalnum() and name[:1] not in "_$" and texts[j] != "<":
                    name += texts[j]
                if texts[j] == "<" and (name[:1].isalnum() or name[:1] in "_$"):
                    depth = 0
                    while j < n:
                        depth += (texts[j] == "<") - (texts[j] == ">")
                        if not depth:
                            break
                        j += 1
            labels, names, depth, words, at_name = [], [], 0, [], True
            while j < n:
                x = texts[j]
                if t.kinds[j] == lp or x in ("[", "{"):
                    depth += 1
                elif t.kinds[j] == rp or x in ("]", "}"):
                    depth -= 1
                    if not depth:
                        break
                elif depth == 1 and at_name:
                    if t.kinds[j] == at_sign:
                        j += 1
                        while t.kinds[j + 1] == k["."]:
                            j += 2
                        if t.kinds[j + 1] == lp and t.first[j + 1] == 2:
                            deep = 0
                            while j < n:
                                j += 1
                                deep += (t.kinds[j] == lp) - (t.kinds[j] == rp)
                                if not deep:
                                    break
                    elif x == ":":
                        words = words[-2:]
                        labels.append(None if words[0] == "_" else words[0].strip("`"))
                        names.append(words[-1].strip("`"))
                        at_name = False
                    elif x:
                        words.append(x)
                elif depth == 1 and x == ",":
                    words, at_name = [], True
                elif depth == 1 and x == "<":
                    deep = 0  # commas of generic arguments
                    while j < n:
                        deep += (texts[j] == "<") - (texts[j] == ">")
                        if not deep:
                            break
                        j += 1
                j += 1
            line, col = place(starts[i])
            # the code up to the end of its body
            end, depth = j, 0
            while end < n and t.kinds[end] != lb and (t.first[end + 1] != 1 or texts[end] in ("->", "where", ",", ")") or texts[end + 1] in ("{", "->", "where", "async", "throws")):
                end += 1
            if end < n and t.kinds[end] == lb:
                while end < n:
                    depth += (t.kinds[end] == lb) - (t.kinds[end] == rb)
                    if not depth:
                        break
                    end += 1
            stop = starts[end] + max(1, len(texts[end]))
            found.append(
                Found(line, col, name, f"{name}({''.join((x or '_') + ':' for x in labels)})", tuple(labels), tuple(names), "\n".join(text[a:b] for a, b in docs), text[starts[first] : stop])
            )
        elif texts[i] in _DECLARES and texts[i] not in _TYPES:
            pending = False
    return found


def comment_lines(documentation: str) -> list[str]:
    """The lines of documentation comments without their signs and common indentation."""
    lines: list[str] = []
    block: list[str] | None = None
    for raw in re.split(r"\r\n|\r|\n", documentation):
        s = raw.strip()
        if block is None and s.startswith("///"):
            lines.append(re.sub(r"^///+", "", s))
            continue
        if block is None:
            if not s.startswith("/**"):
                continue
            block, raw = [], raw.lstrip()[3:]
        end = raw.rstrip().endswith("*/")
        block.append(raw.rstrip()[:-2] if end else raw)
        if end:
            starred = [b for b in block[1:] if b.strip()]
            if starred and all(b.lstrip().startswith("*") for b in starred):
                block = [block[0], *[b.lstrip()[1:] if b.strip() else "" for b in block[1:]]]
            else:
                margin = min((len(b.expandtabs(4)) - len(b.expandtabs(4).lstrip()) for b in block[1:] if b.strip()), default=0)
                block = [block[0].lstrip(), *[b.expandtabs(4)[margin:] for b in block[1:]]]
            lines += block
            block = None
    margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return [x[margin:].rstrip() if x.strip() else "" for x in lines]


# The fields of documentation lists, and what stands for an unwritten comment.
FIELDS = "parameter parameters returns return throws attention author authors bug complexity copyright custom date example experiment important invariant keyword localizationkey mutatingvariant nonmutatingvariant note postcondition precondition recommended recommendedover remark remarks requires seealso since tag todo tip version warning".split()
_FIELD = re.compile(rf"^\s*[-*+]\s*(?:{'|'.join(FIELDS)})\b[^:]*:|^\s*[-*+]\s*parameters?\s*$|^\s*:(?:param|parameter|returns?|throws?)\b|^\s*@(?:param|returns?|throws?|see)\b", re.I)
_MARK = re.compile(r"^\W*(?:mark|todo|fixme|xxx|hack|note to self|swiftlint|swiftformat|lint|sourcery|periphery|swift-format|clang-format|codecov|sonar|nolint|noinspection|pragma)\b(?:\s*[:(-].*|\s*)$|^\W*[a-z-]+:(?:disable|enable|ignore|skip|next|this|previous|all|off|on|inline)\b.*$", re.I)
_TASK = re.compile(r"^\W*(?:todo|fixme|xxx|hack)\b(?:\s*[:(-]|\s*$)", re.I)
_PLACEHOLDER = {"", "description", "summary", "documentation", "docs", "doc", "tbd", "tba", "n a", "na", "none", "placeholder", "todo", "fixme", "write documentation", "add documentation", "add description", "documentation missing", "missing documentation", "no documentation", "undocumented", "to be documented", "to be written", "to be done", "to do", "coming soon", "document me", "document this", "lorem ipsum", "description here", "add a description", "add a description here", "your description", "a description", "the description", "no description", "not documented", "not documented yet", "needs documentation", "add docs", "empty", "nodoc", "pending", "see code", "summary goes here", "description goes here", "no overview available", "no description available", "no documentation available", "no summary available", "overview", "discussion", "insert description here", "insert documentation here", "text goes here", "documentation goes here", "comment", "comment goes here", "available"}
_REFERENCE = re.compile(
    r"^(?:please\s+)?(?:(?:see|cf|refer to|same as|like|as|compare|copy of|alias (?:for|of|to)|wrapper (?:for|of|around)|overload of|counterpart (?:of|to)|equivalent to|inherited from|inherits? (?:doc(?:umentation)?|comment) from|override[sn]?|implements?|implementation of|documentation (?:of|for)|identical to|forwards to|calls|related to)\s*(?:also)?\s*:?\s*(?:the\s+)?(?:(?:documentation|docs|description|function|method|comment|protocol|type|notes?)\s+(?:of|for|in|on|at)?\s*)?(?:the\s+)?)?(?:§+(?:\s*(?:,|and|or)\s*§+)*)(?:\s+(?:for|above|below|instead|function|method|documentation|too|there|protocol|conformance)(?:\s+(?:details|more|more details|documentation|information))?)?\W*$",
    re.I,
)
_FILLER = set("the a an this that of for to in on with by from and or is are it its function func method does do performs perform executes runs helper implementation".split())
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ies", "ied", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("ey") if len(w) > 3 else w


def plain_sentences(documentation: str) -> str:
    """What a comment says: without markup, code samples, field lists and marks of tasks and tools."""
    kept: list[str] = []
    fence, field, blank, task = None, -1, True, False
    for line in comment_lines(documentation):
        s = line.strip()
        if fence:
            if s.startswith(fence):
                fence = None
            continue
        if s.startswith(("```", "~~~")):
            fence, field = s[:3], -1
            continue
        if not s:
            blank, task = True, False
            continue
        if _TASK.match(s):
            task = True  # up to the end of its paragraph
        if task:
            blank = False
            continue
        depth = len(line) - len(line.lstrip())
        if _FIELD.match(line):
            field, blank = depth, False
            continue
        if field >= 0:
            # Continued lines and nested entries of the field.
            if depth > field or (not blank and not re.match(r"[-*+]\s", s)):
                blank = False
                continue
            field = -1
        if blank and depth >= 4:
            continue  # an indented code sample
        blank = False
        if _MARK.match(s):
            continue
        kept.append(s)
    return "\n".join(kept)


def is_trivial(documentation: str | None, name: str, plain: str | None = None) -> bool:
    """Whether a comment says nothing beyond the function's name; null and empty ones do so. plain: what plain_sentences
    gave for it, if that is known."""
    if not documentation:
        return True
    s = plain_sentences(documentation) if plain is None else plain
    s = re.sub(r"<#.*?#>", " ", s, flags=re.S)
    s = re.sub(r"<!--.*?-->", " ", s, flags=re.S)
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    refs = re.sub(r"``?[^`]+``?|<doc:[^>]*>|https?://\S+", "§", s)
    refs = re.sub(r"(?<![\w.])[A-Za-z_][\w.]*\([\w:]*\)", "§", refs)
    refs = re.sub(r"</?[A-Za-z][^<>]*>", " ", refs)
    refs = re.sub(r"[*_#>~]+", " ", refs)
    refs = " ".join(refs.split()).strip(" -–—.:;,!")
    if not refs or _REFERENCE.match(refs + " "):
        return True
    bare = " ".join(_WORD.findall(re.sub(r"</?[A-Za-z][^<>]*>", " ", s).lower()))
    if bare in _PLACEHOLDER:
        return True
    own = {_stem(w) for w in _CAMEL.findall(name)} | {_stem(name)}
    said = [w for w in _WORD.findall(s) if w.lower() not in _FILLER]
    said = [x for w in said for x in (_CAMEL.findall(w) or [w])]
    return all(_stem(w) in own or w.lower() in _FILLER for w in said)
