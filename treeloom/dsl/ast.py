"""The tree query language's syntax tree. Literals keep their source text; typing happens when a query is planned."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

VALUE_OPS = ("match", "is", "==", "!=")
NODE_OPS = ("contain", "in", "notIn")


@dataclass(frozen=True)
class Literal:
    """kind: string, number, boolean or name (a bare word)."""

    kind: str
    text: str

    @property
    def value(self) -> str | float | int | bool:
        if self.kind == "string":
            return unquote(self.text)
        if self.kind == "number":
            return float(self.text) if any(c in self.text for c in ".eE") else int(self.text)
        return self.text == "true" if self.kind == "boolean" else self.text


@dataclass(frozen=True)
class Path:
    alias: str
    steps: tuple[str, ...] = ()

    def __str__(self) -> str:
        return ".".join((self.alias, *self.steps))


@dataclass(frozen=True)
class Compare:
    path: Path
    op: str
    literal: Literal


@dataclass(frozen=True)
class Relate:
    path: Path
    op: str
    query: Query


@dataclass(frozen=True)
class Not:
    part: Condition


@dataclass(frozen=True)
class And:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Condition, ...]


Condition = Compare | Relate | Not | And | Or


@dataclass(frozen=True)
class Query:
    """node_type is None for an alias-only query, whose type its condition states. at: offset in the source."""

    node_type: str | None
    alias: str | None
    where: Condition | None = None
    at: int = 0

    @property
    def name(self) -> str:
        return self.alias or self.node_type or ""

    def condition(self) -> Condition:
        """The condition; a query without one asks for its own type."""
        return self.where or Compare(Path(self.name), "is", Literal("name", self.node_type or ""))


def unquote(text: str) -> str:
    """A string literal's value: a doubled quote or a backslash and a quote give the quote; other backslashes stay, for regexes."""
    quote, inner = text[0], text[1:-1]
    return inner.replace(quote * 2, quote).replace("\\" + quote, quote)


def quote(value: str) -> str:
    """A literal that unquote() turns into value again."""
    return '"' + value.replace('"', '""') + '"'


def children(c: Condition) -> tuple[Condition, ...]:
    if isinstance(c, Not):
        return (c.part,)
    return c.parts if isinstance(c, (And, Or)) else ()


def atoms(c: Condition | None) -> Iterator[Compare | Relate]:
    """The atomic conditions of one query, not of the queries nested in it."""
    if isinstance(c, (Compare, Relate)):
        yield c
    elif c is not None:
        for part in children(c):
            yield from atoms(part)


def queries(q: Query) -> Iterator[Query]:
    """q and the queries nested in it, outermost first."""
    yield q
    for a in atoms(q.where):
        if isinstance(a, Relate):
            yield from queries(a.query)


def join(kind: type[And] | type[Or], parts: list[Condition]) -> Condition | None:
    """Parts under one And or Or: nested ones of the kind are flattened, repeats go, one part stands for itself."""
    flat: list[Condition] = []
    for p in parts:
        for x in p.parts if isinstance(p, kind) else (p,):
            if x not in flat:
                flat.append(x)
    return None if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


def rebuild(c: Condition | None, change: Callable[[Compare | Relate], Condition | None]) -> Condition | None:
    """c with every atomic condition changed, or removed (None); empty nots vanish, single parts stand for themselves."""
    if c is None:
        return None
    if isinstance(c, (Compare, Relate)):
        return change(c)
    if isinstance(c, Not):
        part = rebuild(c.part, change)
        return None if part is None else Not(part)
    parts = [x for x in (rebuild(p, change) for p in c.parts) if x is not None]
    return join(type(c), parts)


def map_queries(q: Query, change: Callable[[Query], Query]) -> Query:
    """q with every query, the innermost first, changed once."""
    inner = rebuild(q.where, lambda a: replace(a, query=map_queries(a.query, change)) if isinstance(a, Relate) else a)
    return change(replace(q, where=inner))
