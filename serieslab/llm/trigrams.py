"""Boolean trigram queries of regular expressions: which three-character strings a matching text must hold.

A query is a conjunction of clauses; a clause is a disjunction of trigram sets, of which one must be present whole. An empty
query means that the pattern has no mandatory trigram, so that every text has to be scanned.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

Clause = tuple[frozenset[str], ...]

#: More alternatives than this in one stretch of literals end the stretch; the query only becomes weaker.
MOST = 64


def grams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def clause(strings: set[str]) -> Clause:
    """One of the strings occurs. Sets that hold another one are redundant; a string under three characters says nothing."""
    sets = {grams(s) for s in strings}
    if frozenset() in sets:
        return ()
    return tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))


def finite(node) -> set[str] | None:
    """The strings of a node, folded to lower case, if they are few."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        if any(k not in (op.LITERAL, op.RANGE) for k, _ in arg):
            return None
        if sum(1 if k is op.LITERAL else a[1] - a[0] + 1 for k, a in arg) > 4:
            return None
        return {chr(c).lower() for k, a in arg for c in ([a] if k is op.LITERAL else range(a[0], a[1] + 1))}
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return joined(arg[-1])
    if kind is op.BRANCH:
        parts = [joined(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 8:
        inner = joined(arg[2])
        if inner is None:
            return None
        out = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n) if len(inner) ** n <= MOST}
        return out if len(out) <= MOST else None
    return None


def joined(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        own = finite(n)
        if own is None or len(out) * len(own) > MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> tuple[Clause, ...]:
    """The Boolean query of a pattern, in lower case."""
    out: list[Clause] = []

    def walk(nodes) -> None:
        held = {""}

        def flush() -> None:
            nonlocal held
            if c := clause(held):
                out.append(c)
            held = {""}

        for n in nodes:
            own = finite(n)
            if own is not None and len(held) * len(own) <= MOST:
                held = {a + b for a in held for b in own}
                continue
            flush()
            kind, arg = n
            if own is not None:
                held = own
            elif kind is op.SUBPATTERN:
                walk(arg[-1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush()

    walk(parser.parse(pattern))
    return tuple(dict.fromkeys(out))
