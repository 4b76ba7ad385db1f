import random

import pytest

from treeloom.dsl.ast import And, Not, Or, Relate
from treeloom.dsl.parser import parse
from treeloom.plans.compiler import NodePlanner, PlanError, hoist, run, typed
from treeloom.tree.nodes import NODE_FIELDS, Node, preorder, rows_of

TYPES, ROLES, NAMES = ["A", "B", "C"], ["x", "y"], ["p", "q", None]


def random_tree(rng, depth=0):
    n = Node(rng.choice(TYPES), rng.choice(ROLES), name=rng.choice(NAMES), flags={"isF": rng.random() < 0.5})
    n.dsl_type = n.node_type
    n.props = {"k": rng.choice("12")} if rng.random() < 0.7 else {}
    if depth < 4:
        n.children = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return n


class Brute:
    """The language's meaning, said once more in plain Python."""

    def __init__(self, root):
        self.order = [n for n, _ in preorder(root)]
        self.up = {id(n): p for n, p in preorder(root)}

    def above(self, n):
        p = self.up[id(n)]
        return [] if p is None else [p, *self.above(p)]

    def below(self, n):
        return [x for c in n.children for x, _ in preorder(c)]

    def walk(self, n, steps):
        out = [n]
        for s in steps:
            out = [c for x in out for c in x.children if c.role == s]
        return out

    def holds(self, n, name, c):
        if isinstance(c, Not):
            return not self.holds(n, name, c.part)
        if isinstance(c, And):
            return all(self.holds(n, name, p) for p in c.parts)
        if isinstance(c, Or):
            return any(self.holds(n, name, p) for p in c.parts)
        if isinstance(c, Relate):
            ends = self.walk(n, c.path.steps)
            if c.op == "contain":
                return any(self.matches(x, c.query) for e in ends for x in self.below(e) + ([e] if c.path.steps else []))
            hit = any(self.matches(x, c.query) for e in ends for x in self.above(e))
            return hit if c.op == "in" else not hit
        *steps, last = c.path.steps or ("",)
        if c.op == "is":
            return any(e.dsl_type == c.literal.text for e in self.walk(n, c.path.steps))
        return any(self.test(e, last, c) for e in self.walk(n, steps))

    def test(self, e, prop, c):
        if prop.startswith("is"):
            return e.flags.get(prop, False) == c.literal.value
        v = e.name if prop == "name" else e.props.get(prop)
        if v is None:
            return False
        import re

        w = str(c.literal.value)
        return bool(re.fullmatch(w, v)) if c.op == "match" else (v == w) == (c.op == "==")

    def matches(self, n, q):
        q = typed(q)
        return (q.node_type is None or n.dsl_type == q.node_type) and (q.where is None or self.holds(n, q.name, q.where))


QUERIES = [
    "A a where a contain B;",
    'A a where and(a.name == "p", not(a contain C c where c.name match "[pq]"));',
    "B b where b in A a where a.k == \"1\";",
    "B b where b notIn A a where a.isF;",
    "C c where or(c.isF, c.x contain B, not(or(c.name == \"q\", c in B)));",
    'A a where a.x.y.name == "p";',
    "A a where a.x is B;",
    "A a where and(a.y contain alias_1 where alias_1 is C, a.k != \"2\");",
    "A a where not(and(a contain B b where b contain C, a.name == \"p\"));",
    'A a where a contain B b where and(b.name == "q", a.isF);',
    "A a where not(not(a in C));",
]


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(11)
    made = {f"t{k}": random_tree(rng) for k in range(25)}
    rows = [r for k, t in made.items() for r in rows_of(k, t)]
    return made, spark.createDataFrame(rows, NODE_FIELDS).cache()


@pytest.mark.parametrize("text", QUERIES)
def test_planner_against_the_language(trees, text):
    made, nodes = trees
    q = hoist(parse(text))[0]
    brutes = {k: Brute(t) for k, t in made.items()}
    want = {(k, i) for k, b in brutes.items() for i, n in enumerate(b.order) if b.matches(n, q)}
    got = [(r.tree_id, r.node_id) for r in NodePlanner(nodes).plan(parse(text)).select("tree_id", "node_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_containment_is_an_equi_join(trees, spark):
    _, nodes = trees
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = NodePlanner(nodes).plan(parse("A a where and(a contain B, not(a in C));"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "LeftSemi" in plan and "LeftAnti" in plan


def test_unplannable(spark):
    from treeloom.tree.relational import STAR, RelationalForest

    empty = {e.table: spark.createDataFrame([], ", ".join(f"{c} long" for c in {e.key or "l_orderkey", *([e.parent[1]] if e.parent else []), *(e.prefix + c for c in e.columns)})) for e in STAR.values()}
    f = RelationalForest(empty)
    from treeloom.plans.compiler import RelationalPlanner

    assert run("region r where r contain customer;", RelationalPlanner(f), f.vocabulary).count() == 0
    with pytest.raises(PlanError):
        run("galaxy g where g contain region;", RelationalPlanner(f), f.vocabulary)
    with pytest.raises(PlanError):
        run("region r where r contain customer c where or(c.name == \"a\", r.name == \"b\");", RelationalPlanner(f))
