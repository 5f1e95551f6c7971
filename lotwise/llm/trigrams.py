"""Boolean trigram queries: what every match of a regex must contain.

A query is a disjunction of sets of trigrams. A text can only match if it holds
all trigrams of one of the sets. Text and trigrams are lower-cased, so a query
may let a text pass that does not match, never the other way round.
"""

from __future__ import annotations

from itertools import product
from re import _constants as token
from re import _parser as parser

Query = frozenset[frozenset[str]]

#: Holds for every text.
ANY: Query = frozenset([frozenset()])
#: More strings or sets than this are given up for ``ANY``, which is always safe.
LIMIT = 64


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def simplest(sets) -> Query:
    """Without the sets that hold another one."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept) if len(kept) <= LIMIT else ANY


def both(a: Query, b: Query) -> Query:
    return simplest(x | y for x, y in product(a, b)) if len(a) * len(b) <= LIMIT * LIMIT else a


def asked(exact: set[str] | None) -> Query:
    return ANY if exact is None else simplest(grams(s) for s in exact)


def _class(items) -> set[str] | None:
    """The characters of a small class, else None."""
    found: set[str] = set()
    for kind, value in items:
        if kind is token.LITERAL:
            found.add(chr(value).lower())
        elif kind is token.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _node(kind, value) -> tuple[set[str] | None, Query]:
    """The strings a part can match if they are few, and the query if not."""
    if kind is token.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is token.IN:
        return _class(value), ANY
    if kind is token.AT:
        return {""}, ANY
    if kind is token.SUBPATTERN:
        return _sequence(value[-1])
    if kind is token.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), ANY
        return None, simplest(s for exact, query in parts for s in both(asked(exact), query))
    if kind in (token.MAX_REPEAT, token.MIN_REPEAT, token.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if least == 0:
            return (exact | {""}, ANY) if most == 1 and exact is not None else (None, ANY)
        if least == most == 1:
            return exact, query
        return None, both(asked(exact), query)
    return None, ANY


def _sequence(parts) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    query, whole = ANY, True
    for kind, value in parts:
        exact, inner = _node(kind, value)
        if exact is not None and len(run) * len(exact) <= LIMIT:
            run = {a + b for a, b in product(run, exact)}
            continue
        query = both(both(query, asked(run)), both(inner, asked(exact)))
        run, whole = {""}, False
    return (run, query) if whole else (None, both(query, asked(run)))


def derive(pattern: str) -> Query:
    """The Boolean trigram query of a regex; ``ANY`` if it has no mandatory trigram."""
    exact, query = _sequence(parser.parse(pattern))
    return both(query, asked(exact))
