"""Boolean trigram queries from regular expressions: which trigrams a text must hold before a pattern can match it."""

from __future__ import annotations

import re

_parser = re._parser  # the standard library's regular-expression parser
MOST = 16

#: A query in disjunctive form: a set of conjunctions, each a set of trigrams. {frozenset()} holds for any text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    if len(joined) > 4 * MOST:  # keep the more selective side; a weaker query only adds candidates
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return _least(joined)


def _least(terms: set[frozenset[str]]) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in terms if not any(y < x for y in terms))


def _of(strings: set[str]) -> Query:
    """The query of a text that holds one of `strings`."""
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(node) -> tuple[set[str] | None, Query]:
    """The strings that `node` matches if they are few (else None), and what each match must hold."""
    strings: set[str] | None = {""}
    whole, query = True, ANY
    for op, arg in node:
        name = str(op)
        own, own_query = None, ANY
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN":
            singles = [chr(a).lower() for o, a in arg if str(o) == "LITERAL"]
            if len(singles) == len(arg) <= 4:
                own = set(singles)
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            own = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
            own_query = _least({t for s, q in parts for t in (_and(q, _of(s)) if s is not None else q)})
        elif name == "SUBPATTERN":
            own, own_query = _walk(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            inner_strings, inner_query = _walk(inner)
            if inner_strings is not None and (low, high) in ((0, 1), (1, 1)):
                own = inner_strings | ({""} if low == 0 else set())
            elif low:
                own_query = _and(inner_query, _of(inner_strings)) if inner_strings is not None else inner_query
        elif name == "AT":
            own = {""}
        if own is not None and len(own) * len(strings) <= MOST:
            strings = {a + b for a in strings for b in own}
        else:
            query = _and(_and(query, _of(strings)), _of(own) if own is not None else own_query)
            strings, whole = {""}, False
    return (strings, query) if whole else (None, _and(query, _of(strings)))


def trigram_query(pattern: str) -> Query:
    """The query of `pattern` over lower-cased text; ANY if the pattern has no mandatory trigram and must scan fully.

    Each match of the pattern, lower-cased, holds all trigrams of at least one conjunction.
    """
    strings, query = _walk(_parser.parse(pattern))
    query = _and(query, _of(strings)) if strings is not None else query
    return ANY if frozenset() in query else query
