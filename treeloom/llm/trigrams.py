"""Boolean trigram queries of regular expressions.

A query is None (no mandatory trigram: scan everything) or a conjunction of disjunctions of trigram sets: a tuple of clauses,
each a tuple of alternatives, each a frozenset of trigrams that all have to occur. Letters are folded to lower case, so the
query holds for the lower-cased text whatever the rule's flags.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

MAX_STRINGS = 64
_REPEATS = (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT)
Query = tuple[tuple[frozenset[str], ...], ...]


def _fold(s: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s)


def _strings(node) -> set[str] | None:
    """All strings that a node of a parsed pattern matches, if they are few."""
    op, arg = node
    if op is c.LITERAL:
        return {_fold(chr(arg))}
    if op is c.IN and all(o is c.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {_fold(chr(v)) for _, v in arg}
    if op is c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is c.BRANCH:
        found: set[str] = set()
        for branch in arg[1]:
            part = _sequence(branch)
            if part is None:
                return None
            found |= part
        return found if len(found) <= MAX_STRINGS else None
    if op in _REPEATS and arg[1] is not c.MAXREPEAT and arg[1] <= 4:
        one = _sequence(arg[2])
        if one is None:
            return None
        found, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                found |= power
            power = {a + b for a in power for b in one}
            if len(power) > MAX_STRINGS:
                return None
        return found if len(found) <= MAX_STRINGS else None
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _strings(node)
        if part is None:
            return None
        found = {a + b for a in found for b in part}
        if len(found) > MAX_STRINGS:
            return None
    return found


def _clause(strings: set[str]) -> tuple[frozenset[str], ...] | None:
    """One of the strings occurs, so all trigrams of one do; None if a string has no trigram."""
    if not strings or min(map(len, strings)) < 3:
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(o < s for o in sets)]  # a superset is implied by its subset
    return tuple(sorted(least, key=sorted))


def trigram_query(pattern: str) -> Query | None:
    clauses: list[tuple[frozenset[str], ...]] = []

    def add(strings: set[str]) -> None:
        clause = _clause(strings)
        if clause and clause not in clauses:
            clauses.append(clause)

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            part = _strings(node)
            joined = None if part is None else {a + b for a in run for b in part}
            if joined is not None and len(joined) <= MAX_STRINGS:
                run = joined
                continue
            add(run)
            run = part if part is not None else {""}
            op, arg = node
            if part is None and op is c.SUBPATTERN:
                walk(arg[-1])
            elif part is None and op in _REPEATS and arg[0] >= 1:
                walk(arg[2])
        add(run)

    walk(parser.parse(pattern))
    return tuple(clauses) or None


def trigrams_of(queries: list[Query | None]) -> list[str]:
    return sorted({g for q in queries if q for clause in q for alternative in clause for g in alternative})
