"""Syntax trees as text again."""

from __future__ import annotations

from treeloom.dsl.ast import And, Compare, Condition, Not, Query, Relate


def show_atom(c: Compare) -> str:
    if c.op == "==" and c.literal.text == "true" and c.literal.kind == "boolean":
        return str(c.path)
    return f"{c.path} {c.op} {c.literal.text}"


def show_condition(c: Condition, depth: int = 0) -> str:
    pad = "\t" * depth
    if isinstance(c, Compare):
        return pad + show_atom(c)
    if isinstance(c, Relate):
        return f"{pad}{c.path} {c.op} {show_query(c.query, depth)}"
    if isinstance(c, Not):
        return f"{pad}not(\n{show_condition(c.part, depth + 1)}\n{pad})"
    word = "and" if isinstance(c, And) else "or"
    parts = ",\n".join(show_condition(p, depth + 1) for p in c.parts)
    return f"{pad}{word}(\n{parts}\n{pad})"


def show_query(q: Query, depth: int = 0) -> str:
    head = " ".join(x for x in (q.node_type, q.alias) if x)
    return head if q.where is None else f"{head} where\n{show_condition(q.where, depth + 1)}"


def show(q: Query) -> str:
    """The text of an outermost query."""
    return show_query(q) + ";"
