"""Queries of the tree language as DataFrame plans.

Conditions on a node's own columns become filters, relations to other nodes become left semi joins, and their negations left anti
joins, so Catalyst pushes the filters down and picks the joins. Below `or`, or a `not` around more than a relation, each
relation is a distinct set of node ids, joined once as a flag, and the condition is a Boolean expression over flags.

Two-valued logic: a comparison with a missing property is false, `!=` included; `not` turns it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.dsl.analyzer import errors
from treeloom.dsl.ast import And, Compare, Condition, Not, Or, Query, Relate, atoms, join
from treeloom.dsl.parser import parse
from treeloom.plans.structural import holding, inside
from treeloom.tree.relational import RelationalForest


class PlanError(ValueError):
    """A query that can't be planned over this source."""


def compare(column: Column | None, op: str, value, plain: bool = False) -> Column:
    """A comparison as a condition that is never null; plain leaves nulls, which a filter takes as false, so that it can be pushed down."""
    if column is None:
        return F.lit(False)
    if op == "match":
        made = F.rlike(column.cast("string"), F.lit(f"^(?:{value})$"))
    elif op == "==":
        made = column == F.lit(value)
    elif op == "!=":
        made = column != F.lit(value)
    else:
        raise PlanError(f"{op} asks for a node type")
    return made if plain else F.coalesce(made, F.lit(False))


def typed(q: Query) -> Query:
    """An alias-only query with the type that its first `is` condition names, which is then dropped."""
    if q.node_type is not None:
        return q
    for a in atoms(q.where):
        if isinstance(a, Compare) and a.op == "is" and a.path.alias == q.alias and not a.path.steps:
            rest = [p for p in (q.where.parts if isinstance(q.where, And) else (q.where,)) if p != a]
            return replace(q, node_type=a.literal.text, where=join(And, rest))
    return q


def hoist(q: Query, outer: frozenset[str] = frozenset()) -> tuple[Query, list[Condition]]:
    """q without the conjuncts that only concern outer aliases, and those conjuncts: they hold or fail for the outer node alone."""
    names = outer | {q.name}
    parts = list(q.where.parts) if isinstance(q.where, And) else [q.where] if q.where is not None else []
    kept, out = [], []
    for p in parts:
        used = {a.path.alias for a in atoms(p)}
        if used and q.name not in used and used <= outer:
            out.append(p)
            continue
        if isinstance(p, Relate):
            inner, up = hoist(p.query, names)
            p = replace(p, query=inner)
            for u in up:
                (kept if {a.path.alias for a in atoms(u)} == {q.name} else out).append(u)
        kept.append(p)
    return replace(q, where=join(And, kept)), out


class Planner:
    """Plans over a source; subclasses say how nodes, properties and relations are found."""

    def plan(self, q: Query) -> DataFrame:
        """The matching nodes with all columns of their source."""
        q, left = hoist(q)
        if left:
            raise PlanError("a condition concerns no query around it")
        return self.matching(q)

    def matching(self, q: Query) -> DataFrame:
        q = typed(q)
        df = self.source(q)
        flat = join(And, [q.where]) if q.where is not None else None
        parts = flat.parts if isinstance(flat, And) else (flat,) if flat is not None else ()
        # own columns first: they are filters on the scan
        for p in sorted(parts, key=lambda p: any(isinstance(a, Relate) or a.path.steps[1:] for a in atoms(p))):
            df = self.apply(df, q, p)
        return df

    def apply(self, df: DataFrame, q: Query, c: Condition) -> DataFrame:
        negative, inner = False, c
        while isinstance(inner, Not):
            negative, inner = not negative, inner.part
        if isinstance(inner, Relate):
            df, ids, key = self.related(df, q, inner)
            if inner.op == "notIn":
                negative = not negative
            return df.join(ids, key, "left_anti" if negative else "left_semi")
        flags: list[str] = []
        df, made = self.value(df, q, c, flags, plain=True) if isinstance(c, Compare) else self.expression(df, q, c, flags)
        return df.where(made).drop(*flags)

    def expression(self, df: DataFrame, q: Query, c: Condition, flags: list[str]) -> tuple[DataFrame, Column]:
        if isinstance(c, Not):
            df, part = self.expression(df, q, c.part, flags)
            return df, ~part
        if isinstance(c, (And, Or)):
            made = None
            for p in c.parts:
                df, one = self.expression(df, q, p, flags)
                made = one if made is None else (made & one) if isinstance(c, And) else (made | one)
            return df, made
        if isinstance(c, Relate):
            name = f"_flag{len(flags)}"
            flags.append(name)
            df, ids, key = self.related(df, q, c)
            df = df.join(ids.distinct().withColumn(name, F.lit(True)), key, "left")
            found = F.coalesce(F.col(name), F.lit(False))
            return df, ~found if c.op == "notIn" else found
        return self.value(df, q, c, flags)

    # what a source has to say

    def source(self, q: Query) -> DataFrame:
        raise NotImplementedError

    def related(self, df: DataFrame, q: Query, c: Relate) -> tuple[DataFrame, DataFrame, list[str]]:
        """df, the ids for which the relation holds, and the columns to join them on."""
        raise NotImplementedError

    def value(self, df: DataFrame, q: Query, c: Compare, flags: list[str], plain: bool = False) -> tuple[DataFrame, Column]:
        """df, with a flag if need be, and the comparison; plain: it is a filter by itself, so null may stand for false."""
        raise NotImplementedError


class RelationalPlanner(Planner):
    """Plans over tables: containment follows foreign keys."""

    def __init__(self, forest: RelationalForest):
        self.forest = forest

    def source(self, q: Query) -> DataFrame:
        if q.node_type not in self.forest.entities:
            raise PlanError(f"unknown type {q.node_type!r}")
        return self.forest.nodes(q.node_type)

    def related(self, df, q, c):
        end = self.forest.path_end(q.node_type, c.path.steps) if c.path.alias == q.name else None
        if end is None:
            raise PlanError(f"no such path: {c.path}")
        inner = typed(c.query)
        if c.path.steps:  # the relation is that of a row above: its ids, met by each row's own
            held, ids, key = self.related(self.forest.nodes(end), replace(q, node_type=end), replace(c, path=replace(c.path, steps=())))
            ids = held.join(ids, key, "left_semi").select(self.forest.key_column(end).alias("_up"))
            return self.forest.owner_ids(df, end, q.node_type), ids, ["_up"]
        if c.op == "contain":
            if self.forest.chain(q.node_type, inner.node_type) is None:
                return df, df.sparkSession.createDataFrame([], df.select("_id").schema), ["_id"]
            found = self.forest.owner_ids(self.matching(inner), q.node_type, inner.node_type)
            return df, found.select(F.col("_up").alias("_id")), ["_id"]
        if self.forest.chain(inner.node_type, q.node_type) is None:
            return df.withColumn("_up", F.lit(None).cast("long")), df.sparkSession.createDataFrame([], "_up long"), ["_up"]
        up = self.forest.owner_ids(df, inner.node_type, q.node_type)
        ids = self.matching(inner).select(self.forest.key_column(inner.node_type).alias("_up"))
        return up, ids, ["_up"]

    def value(self, df, q, c, flags, plain=False):
        if c.path.alias != q.name:
            raise PlanError(f"alias {c.path.alias!r} is not the query's own")
        if not c.path.steps:
            if c.op != "is":
                raise PlanError(f"no property: {c.path}")
            return df, F.lit(c.literal.text == q.node_type)
        steps, prop, value = c.path.steps[:-1], c.path.steps[-1], c.literal.value
        if c.op == "is":
            steps, prop = c.path.steps, ""
        if steps:  # a property of a row above, met by its id; the table above is read for it once
            end = self.forest.path_end(q.node_type, steps)
            if end is None:
                raise PlanError(f"no such path: {c.path}")
            made = F.lit(c.literal.text == end) if c.op == "is" else compare(self.forest.column(end, prop), c.op, value)
            name = f"_flag{len(flags)}"
            flags.append(name)
            hits = self.forest.nodes(end).where(made).select(self.forest.key_column(end).alias("_up"), F.lit(True).alias(name))
            df = self.forest.owner_ids(df, end, q.node_type).join(hits, "_up", "left").drop("_up")
            return df, F.coalesce(F.col(name), F.lit(False))
        if plain and c.op == "==" and value is True and prop in self.forest.entities[q.node_type].flags:
            return df, F.expr(self.forest.entities[q.node_type].flags[prop])
        return df, compare(self.forest.column(q.node_type, prop), c.op, value, plain)

    def apply(self, df, q, c):
        out = super().apply(df, q, c)
        return out.drop("_up") if "_up" in out.columns else out


class NodePlanner(Planner):
    """Plans over a node table (tree.nodes): containment by one pass over sorted ranks (structural.py).

    What a relation is joined with starts from the node table, never from the plan so far, so a plan grows with its query.
    """

    KEY = ["tree_id", "node_id"]

    def __init__(self, nodes: DataFrame, vocabulary=None):
        self.nodes, self.vocabulary = nodes, vocabulary

    def _role(self, step: str) -> list[str]:
        v = self.vocabulary
        if v is None:
            return [step]
        name = v.canonical(step)
        return sorted({name, step, *(a for a, b in v.synonyms.items() if b == name)})

    def source(self, q: Query) -> DataFrame:
        return self.nodes if q.node_type is None else self.nodes.where(F.col("dsl_type") == q.node_type)

    def walk(self, ids: DataFrame, steps: tuple[str, ...]) -> DataFrame:
        """(tree_id, start, node_id): from each of ids along the roles."""
        at = ids.select("tree_id", F.col("node_id").alias("start"), "node_id")
        for step in steps:
            child = self.nodes.where(F.col("role").isin(self._role(step))).select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("_child"))
            at = at.join(child, self.KEY).select("tree_id", "start", F.col("_child").alias("node_id"))
        return at

    def related(self, df, q, c):
        inner = self.matching(typed(c.query))
        every = self.source(q)
        ends = self.walk(every, c.path.steps) if c.path.steps else None
        own = self.nodes.join(ends.select(self.KEY).distinct(), self.KEY, "left_semi") if c.path.steps else every
        if c.op == "contain":
            found = holding(own, inner)
            if ends is None:
                return df, found, self.KEY
            found = found.unionByName(inner.select(self.KEY))  # with a path the match may be what the path leads to
        else:
            found = inside(own, inner)
            if ends is None:
                return df, found, self.KEY
        hit = ends.join(found, self.KEY, "left_semi")
        return df, hit.select("tree_id", F.col("start").alias("node_id")), self.KEY

    def value(self, df, q, c, flags, plain=False):
        if c.path.alias != q.name:
            raise PlanError(f"alias {c.path.alias!r} is not the query's own")
        *steps, last = c.path.steps or ("",)
        if c.op == "is":
            steps, last = list(c.path.steps), ""
        if not steps:
            return df, self._test(last, c, plain)
        ends = self.walk(self.source(q), tuple(steps)).join(self.nodes, self.KEY).where(self._test(last, c))
        name = f"_flag{len(flags)}"
        flags.append(name)
        hit = ends.select("tree_id", F.col("start").alias("node_id")).distinct().withColumn(name, F.lit(True))
        return df.join(hit, self.KEY, "left"), F.coalesce(F.col(name), F.lit(False))

    def _test(self, prop: str, c: Compare, plain: bool = False) -> Column:
        if c.op == "is":
            return compare(F.col("dsl_type"), "==", c.literal.text, plain)
        if isinstance(c.literal.value, bool) and c.literal.kind == "boolean" and prop.startswith("is"):
            found = F.coalesce(F.try_element_at("flags", F.lit(prop)), F.lit(False))
            return found == c.literal.value if c.op == "==" else found != c.literal.value
        text = F.col("name") if prop == "name" else F.col("value") if prop == "value" else F.try_element_at("props", F.lit(prop))
        value = c.literal.text if c.literal.kind in ("number", "boolean", "name") else c.literal.value
        return compare(text, c.op, value, plain)


def run(text: str, planner: Planner, vocabulary=None) -> DataFrame:
    """Parses, checks and plans a query."""
    q = parse(text)
    found = errors(q, vocabulary) if vocabulary is not None else []
    if found:
        raise PlanError("; ".join(f.message for f in found))
    return planner.plan(q)
