"""Which trigrams must a text hold so that a regular expression can match it?

The expression's parse tree is folded into a Boolean query over trigrams of the lower-cased UTF-8 text.  Every subtree is described
by the strings it can begin and end with (as long as they are few) and by a query its matches satisfy; where two subtrees meet, the
trigrams that straddle them are added.  What is not understood counts as "anything", which only makes the query weaker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# The standard library's own regex parser; its tree is the only thing used here.
from re import _constants as op
from re import _parser as parser

MOST = 24


@dataclass(frozen=True)
class Query:
    """``all`` and ``any`` of parts (trigrams or queries); an empty ``all`` is satisfied by every text."""

    kind: str
    parts: frozenset

    def trigrams(self) -> frozenset[bytes]:
        return frozenset(t for p in self.parts for t in (p.trigrams() if isinstance(p, Query) else (p,)))


ANYTHING = Query("all", frozenset())


def both(a: Query, b: Query) -> Query:
    parts: set = set()
    for q in (a, b):
        parts |= q.parts if q.kind == "all" else {q}
    return Query("all", frozenset(parts))


def either(queries: list[Query]) -> Query:
    if ANYTHING in queries or not queries:
        return ANYTHING
    distinct = frozenset(queries)
    return next(iter(distinct)) if len(distinct) == 1 else Query("any", distinct)


def holding(strings: frozenset[bytes]) -> Query:
    """One of these strings occurs."""
    return either([Query("all", frozenset(s[i : i + 3] for i in range(len(s) - 2))) for s in strings])


@dataclass(frozen=True)
class Shape:
    """``exact``: all strings a subtree matches, or None; else strings it begins and ends with, and a query it implies."""

    exact: frozenset[bytes] | None
    begin: frozenset[bytes]
    end: frozenset[bytes]
    query: Query

    def loose(self) -> Shape:
        """Without the exact set: its knowledge moves into the ends and the query."""
        if self.exact is None:
            return self
        return Shape(None, self.exact, self.exact, holding(self.exact))

    def trimmed(self) -> Shape:
        s = self
        if s.exact is not None:
            if len(s.exact) <= MOST and max(map(len, s.exact), default=0) <= MOST:
                return s
            s = s.loose()
        query = both(both(s.query, holding(s.begin)), holding(s.end))
        begin = frozenset(x[:2] for x in s.begin)
        end = frozenset(x[-2:] for x in s.end)
        nothing = frozenset({b""})
        return replace(
            s, query=query, begin=begin if len(begin) <= MOST else nothing, end=end if len(end) <= MOST else nothing
        )


NOTHING = Shape(frozenset({b""}), frozenset(), frozenset(), ANYTHING)
UNKNOWN = Shape(None, frozenset({b""}), frozenset({b""}), ANYTHING)


def of(strings: set[bytes]) -> Shape:
    return Shape(frozenset(strings), frozenset(), frozenset(), ANYTHING)


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(x + y for x in a for y in b)


def then(a: Shape, b: Shape) -> Shape:
    if a.exact is not None and b.exact is not None:
        return replace(NOTHING, exact=_cross(a.exact, b.exact)).trimmed()
    x, y = a.loose(), b.loose()
    query = both(both(x.query, y.query), holding(_cross(x.end, y.begin)))
    begin = _cross(a.exact, y.begin) if a.exact is not None else x.begin
    end = _cross(x.end, b.exact) if b.exact is not None else y.end
    return Shape(None, begin, end, query).trimmed()


def _alternatives(shapes: list[Shape]) -> Shape:
    if all(s.exact is not None for s in shapes):
        return replace(NOTHING, exact=frozenset().union(*(s.exact for s in shapes))).trimmed()
    loose = [s.loose() for s in shapes]
    joined = lambda sets: frozenset().union(*sets)
    return Shape(
        None, joined(s.begin for s in loose), joined(s.end for s in loose), either([s.query for s in loose])
    ).trimmed()


def _letter(code: int) -> Shape:
    return of({chr(code).lower().encode()}) if code < 128 else UNKNOWN


def _class(items: list) -> Shape:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE:
            codes |= set(range(value[0], min(value[1], value[0] + 2 * MOST) + 1))
        else:
            return UNKNOWN
    if len(codes) > 8 or any(c >= 128 for c in codes):
        return UNKNOWN
    return of({chr(c).lower().encode() for c in codes})


def _shape(tree) -> Shape:
    whole = NOTHING
    for kind, value in tree:
        if kind is op.LITERAL:
            part = _letter(value)
        elif kind is op.IN:
            part = _class(value)
        elif kind is op.BRANCH:
            part = _alternatives([_shape(t) for t in value[1]])
        elif kind is op.SUBPATTERN:
            part = _shape(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _shape(inner)
            if (least, most) == (1, 1):
                part = once
            elif (least, most) == (0, 1):
                part = _alternatives([NOTHING, once])
            else:
                part = once.loose() if least else UNKNOWN
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = NOTHING
        else:
            part = UNKNOWN
        whole = then(whole, part)
    return whole


def derive(pattern: re.Pattern) -> Query:
    """The trigram query that every match of ``pattern`` satisfies."""
    return _shape(parser.parse(pattern.pattern, pattern.flags)).loose().query
