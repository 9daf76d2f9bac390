"""Layouts: pieces of source arranged on lines, rendered to a width.

A layout is a tree of Line, Lines, Joined, Indent, Wrap, Align, Newline and BlankLine over texts. Rendering goes left to
right with the column at hand; nothing is lost, repeated or reordered but by groups that say so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


class LayoutError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    width: int = 100
    tab_stop: int = 8
    step: str = "  "
    newline: str = "\n"

    def __post_init__(self):
        if self.width <= 0 or self.tab_stop <= 0:
            raise LayoutError("a width is positive")


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    value: object = None


def _nodes(parts) -> tuple:
    return tuple(p if isinstance(p, Node) else Node("text", value=p) for p in parts)


def line(*parts) -> Node:
    """The parts on one line, a space between them."""
    return Node("line", _nodes(parts))


def lines(*parts) -> Node:
    """Each part on a line of its own."""
    return Node("lines", _nodes(parts))


def joined(*parts) -> Node:
    """The parts without anything between them."""
    return Node("joined", _nodes(parts))


def indent(*parts) -> Node:
    """Lines that begin inside are indented by one step more."""
    return Node("indent", _nodes(parts))


def wrap(*parts, width: int | None = None) -> Node:
    """The parts with spaces, with a break before each that would pass the width."""
    return Node("wrap", _nodes(parts), width)


def align(*parts) -> Node:
    """Lines that begin inside start at the column where the part begins."""
    return Node("align", _nodes(parts))


NEWLINE, BLANK = Node("newline"), Node("blank")


def blank_between(items: Sequence, matches: Callable[[object], bool]) -> list:
    """The items with a blank line between neighbours that both match."""
    out: list = []
    for k, x in enumerate(items):
        if k and matches(items[k - 1]) and matches(x):
            out.append(BLANK)
        out.append(x)
    return out


def grouped(items: Sequence, groups: Sequence[Callable[[object], bool]], sort_keys: dict[int, Callable] | None = None) -> list[list]:
    """The items by the first group that takes each, in the order of groups, what none takes last; with a key a group is
    sorted, stably."""
    held: list[list] = [[] for _ in range(len(groups) + 1)]
    for x in items:
        held[next((k for k, g in enumerate(groups) if g(x)), len(groups))].append(x)
    for k, key in (sort_keys or {}).items():
        held[k].sort(key=key)
    return held


class _Writer:
    def __init__(self, o: Options, column: int):
        self.o, self.out, self.column, self.fresh = o, [], column, False

    def text(self, s: str, margin: str) -> None:
        if not s:
            return
        if self.fresh:
            self.out.append(margin)
            self.column = self.wide(margin, 0)
            self.fresh = False
        self.out.append(s)
        last = s.replace("\r\n", "\n").replace("\r", "\n").rsplit("\n", 1)
        self.column = self.wide(last[-1], 0 if len(last) > 1 else self.column)

    def wide(self, s: str, column: int) -> int:
        for c in s:
            column = (column // self.o.tab_stop + 1) * self.o.tab_stop if c == "\t" else column + 1
        return column

    def line_break(self, blank: bool = False) -> None:
        if self.out and not self.fresh:
            self.out.append(self.o.newline)
            self.fresh = True
            self.column = 0
        if blank and self.out and not (len(self.out) > 1 and self.out[-1] == self.out[-2] == self.o.newline):
            self.out.append(self.o.newline)


def _flat(n: Node) -> str | None:
    """A node on one line, None if it asks for a break."""
    if n.kind == "text":
        return None if "\n" in n.value or "\r" in n.value else n.value
    if n.kind in ("newline", "blank") or n.kind == "lines" and len(n.parts) > 1:
        return None
    parts = [_flat(p) for p in n.parts]
    return None if None in parts else ("" if n.kind in ("joined", "indent", "align") else " ").join(p for p in parts if p)


def _write(n: Node, w: _Writer, margin: str) -> None:
    if n.kind == "text":
        w.text(n.value, margin)
    elif n.kind in ("newline", "blank"):
        w.line_break(n.kind == "blank")
    elif n.kind == "indent":
        for p in n.parts:
            _write(p, w, margin + w.o.step)
    elif n.kind == "align":
        inner = margin if w.fresh else " " * w.column
        for p in n.parts:
            _write(p, w, inner)
    elif n.kind == "lines":
        for k, p in enumerate(n.parts):
            if k and p.kind != "blank" and n.parts[k - 1].kind != "blank":
                w.line_break()
            _write(p, w, margin)
    elif n.kind == "joined":
        for p in n.parts:
            _write(p, w, margin)
    else:
        limit = n.value or w.o.width
        if n.kind == "line" and _flat(n) is None:
            raise LayoutError("a line holds a line break")
        for k, p in enumerate(n.parts):
            if k and not w.fresh:
                size = _flat(p)
                if n.kind == "wrap" and (size is None or w.column + 1 + w.wide(size, 0) > limit):
                    w.line_break()
                else:
                    w.text(" ", margin)
            _write(p, w, margin)


def render(layout: Node, options: Options = Options(), margin: str = "", column: int = 0) -> str:
    """The text of a layout that begins at a column, with lines that begin inside at the margin."""
    w = _Writer(options, column)
    _write(layout, w, margin)
    return "".join(w.out)


def longest_line(text: str, tab_stop: int = 8) -> int:
    w = _Writer(Options(tab_stop=tab_stop), 0)
    return max((w.wide(x, 0) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")), default=0)


def if_fits(text: str, layout: Node, low: int, high: int, options: Options = Options(), margin: str = "") -> str:
    """The rendered layout if the longest line of the text lies between low and high, else the text as it is."""
    return render(layout, options, margin) if low <= longest_line(text, options.tab_stop) <= high else text


def arranged(elements: Sequence[str], make: Callable[[Sequence[str]], Node], options: Options = Options(), margin: str = "") -> str:
    """A list laid out anew: each element must come out exactly once."""
    if not elements:
        raise LayoutError("there is nothing to lay out")
    n = make(elements)
    seen: list[str] = []

    def walk(x: Node) -> None:
        if x.kind == "text":
            seen.append(x.value)
        for p in x.parts:
            walk(p)

    walk(n)
    counts = {e: [list(elements).count(e), seen.count(e)] for e in elements}
    if wrong := [e for e, (a, b) in counts.items() if a != b]:
        raise LayoutError(f"'{wrong[0]}' does not come out as often as it went in")
    return render(n, options, margin)
