"""A small parsing-expression-grammar engine.

Expressions are built from terminals (compiled regular expressions), sequences, ordered choices, repetitions, negative look-ahead and
references to named rules; a rule may carry a predicate on the parser's state.  A parse gives a tree of ``Node``.  References between rules
go as deep as the rules refer to each other; text that nests without bound is for ``brackets``, which needs no stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(slots=True)
class Node:
    rule: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


Expression = Callable[["Grammar", str, int, list], int]  # the end of the match, -1 for none; nodes go to the list


def term(pattern: str, flags: int = 0) -> Expression:
    match = re.compile(pattern, flags).match

    def run(g: Grammar, text: str, at: int, out: list) -> int:
        m = match(text, at)
        return m.end() if m else -1

    return run


def seq(*parts: Expression) -> Expression:
    def run(g: Grammar, text: str, at: int, out: list) -> int:
        mark = len(out)
        for part in parts:
            at = part(g, text, at, out)
            if at < 0:
                del out[mark:]
                return -1
        return at

    return run


def alt(*parts: Expression) -> Expression:
    def run(g: Grammar, text: str, at: int, out: list) -> int:
        for part in parts:
            end = part(g, text, at, out)
            if end >= 0:
                return end
        return -1

    return run


def many(part: Expression) -> Expression:
    def run(g: Grammar, text: str, at: int, out: list) -> int:
        while True:
            end = part(g, text, at, out)
            if end <= at:
                return at
            at = end

    return run


def absent(part: Expression) -> Expression:
    def run(g: Grammar, text: str, at: int, out: list) -> int:
        return -1 if part(g, text, at, []) >= 0 else at

    return run


def first(chars: str, part: Expression) -> Expression:
    """``part``, tried only where one of ``chars`` or a character beyond ASCII stands: what cannot match is not begun."""
    allowed = frozenset(chars)

    def run(g: Grammar, text: str, at: int, out: list) -> int:
        if at >= len(text):
            return -1
        c = text[at]
        return part(g, text, at, out) if c in allowed or c > "\x7f" else -1

    return run


_MARKS = re.compile(r"[\[\](){}<>*]")
_OPENINGS = re.compile(r"[\[({<*]")
_BLANKS = re.compile(r"[ \t]*")
_FLAT = {"<": re.compile(r"<[^<>\n]*>"), "*": re.compile(r"\*[^*\n]+\*(?!\*)")}
_CLOSING = {"[": "]", "{": "}", "(": ")"}


def brackets(but: str) -> Expression:
    """An annotation within a line in ``[]``, ``{}``, ``()``, ``(())``, ``<>`` or ``**`` with whatever annotations it holds, and blanks behind it.

    ``but`` is a pattern of what in parentheses is none.  The ends of all annotations of a line are found from its right end to its left, each
    from those within it, so nesting may go to any depth.
    """
    none = re.compile(but).match

    def close(text: str, at: int, stop: int, pair: str, ends: dict[int, int]) -> int:
        while (m := _MARKS.search(text, at, stop)) is not None:
            at = m.start()
            if at in ends:
                at = ends[at]
            elif text[at] in pair:
                return at
            else:
                at += 1
        return -1

    def fill(text: str, at: int, stop: int, ends: dict[int, int]) -> None:
        for p in [m.start() for m in _OPENINGS.finditer(text, at, stop)][::-1]:
            c = text[p]
            end = -1
            if c in _FLAT:
                m = _FLAT[c].match(text, p)
                end = m.end() if m else -1
            else:
                if c == "(" and text[p + 1 : p + 2] == "(":
                    q = close(text, p + 2, stop, "()", ends)
                    end = q + 2 if q >= 0 and text.startswith("))", q) else -1
                if end < 0 and not (c == "(" and none(text, p)):
                    q = close(text, p + 1, stop, c + _CLOSING[c], ends)
                    end = q + 1 if q >= 0 and text[q] == _CLOSING[c] else -1
            if end >= 0:
                ends[p] = _BLANKS.match(text, end).end()

    def run(g: Grammar, text: str, at: int, out: list) -> int:
        if at >= len(text) or text[at] not in "[({<*":
            return -1
        if not g.line_start <= at < g.line_end:
            stop = text.find("\n", at)
            g.line_start, g.line_end = at, len(text) if stop < 0 else stop
            g.ends.clear()
            fill(text, at, g.line_end, g.ends)
        return g.ends.get(at, -1)

    return run


def ref(name: str) -> Expression:
    def run(g: Grammar, text: str, at: int, out: list) -> int:
        return g.apply(name, text, at, out)

    return run


class Grammar:
    """Named rules; ``when`` has predicates that a rule needs, ``after`` what to do to the state once a rule has matched."""

    def __init__(self, rules: dict[str, Expression], when: dict[str, Callable[[dict], bool]] | None = None, after: dict[str, Callable[[dict, str, int, int], None]] | None = None):
        self.rules, self.when, self.after = rules, when or {}, after or {}
        self.state: dict = {}
        self.ends: dict[int, int] = {}  # of the annotations between line_start and line_end
        self.line_start = self.line_end = -1

    def apply(self, name: str, text: str, at: int, out: list) -> int:
        test = self.when.get(name)
        if test and not test(self.state):
            return -1
        kids: list[Node] = []
        end = self.rules[name](self, text, at, kids)
        if end >= 0:
            out.append(Node(name, at, end, kids))
            if name in self.after:
                self.after[name](self.state, text, at, end)
        return end

    def parse(self, name: str, text: str, **state: object) -> Node:
        self.state, self.line_start, self.line_end = dict(state), -1, -1
        out: list[Node] = []
        end = self.apply(name, text, 0, out)
        return Node(name, 0, max(end, 0), out[0].children if out else [])
