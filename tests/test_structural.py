import random

import pytest
from pyspark.sql import functions as F

from treeloom.plans.compiler import NodePlanner, run
from treeloom.plans.structural import holding, innermost, inside
from treeloom.tree.html import parse_html
from treeloom.tree.nodes import NODE_FIELDS, Node, methods, rows_of

SLIM = "tree_id string, node_id long, parent_id long, pre long, post long, depth int, node_type string"


def grown(rng, n):
    """A random tree of n nodes of three types."""
    made = [Node("a")]
    for _ in range(n - 1):
        made.append(rng.choice(made[-6:]).add(Node(rng.choice("abc"))))
    return made[0]


def above(rows):
    parent = {r["node_id"]: r["parent_id"] for r in rows}
    out = {}
    for k in parent:
        out[k], up = [], parent[k]
        while up is not None:
            out[k].append(up)
            up = parent[up]
    return out


@pytest.mark.parametrize("segment", [1, 7, 1 << 18])
def test_containment_against_paths_of_parents(spark, segment):
    rng = random.Random(5)
    trees = {f"t{k}": rows_of(f"t{k}", grown(rng, rng.randint(1, 120))) for k in range(12)}
    rows = [r for t in trees.values() for r in t]
    nodes = spark.createDataFrame([tuple(r[f.split()[0]] for f in SLIM.split(", ")) for r in rows], SLIM)
    outer, inner = nodes.where("node_type = 'a'"), nodes.where("node_type IN ('b', 'a')")
    is_outer = {(r["tree_id"], r["node_id"]) for r in rows if r["node_type"] == "a"}
    chains = {(t, k): [(t, u) for u in ups] for t, own in trees.items() for k, ups in above(own).items()}
    own = [(r["tree_id"], r["node_id"]) for r in rows if r["node_type"] in "ab"]
    assert {tuple(r) for r in holding(outer, inner, segment).collect()} == {u for k in own for u in chains[k] if u in is_outer}
    assert sorted(map(tuple, inside(inner, outer, segment).collect())) == sorted(k for k in own if any(u in is_outer for u in chains[k]))
    points = inner.select("tree_id", F.col("node_id").alias("point_id"), F.col("pre").alias("at"))
    ranges = outer.select("tree_id", F.col("node_id").alias("range_id"), F.col("pre").alias("start"), (F.col("post") + F.col("depth")).alias("end"))
    want = {}
    for k in own:
        nearest = next((u for u in [k, *chains[k]] if u in is_outer), None)
        if nearest is not None:
            want[k] = nearest[1]
    assert {(r[0], r[1]): r[2] for r in innermost(points, ranges, ["tree_id"], segment).collect()} == want
    assert {tuple(r) for r in methods(nodes, "a").select("tree_id", "node_id").collect()} == {k for k in is_outer if not any(u in is_outer for u in chains[k])}


@pytest.mark.parametrize("segment", [4, 1 << 18])
def test_innermost_of_ranges_that_overlap(spark, segment):
    rng = random.Random(9)
    ranges = [(rng.choice("xy"), k, s := rng.randint(0, 40), s + rng.randint(0, 15)) for k in range(150)]
    points = [(rng.choice("xyz"), k, a := rng.randint(0, 60), a + rng.choice((0, 0, 3))) for k in range(200)]
    got = innermost(spark.createDataFrame(points, "name string, point_id long, at long, until long"), spark.createDataFrame(ranges, "name string, range_id long, start long, end long"), ["name"], segment)
    want = {}
    for name, k, at, until in points:
        able = [(e - s, s, i) for n, i, s, e in ranges if n == name and s <= at and e >= until]
        if able:
            want[name, k] = min(able)[2]
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_very_deep_trees_stay_linear(spark):
    depth = 50_000
    rows = rows_of("deep", parse_html("<div>" * depth + "<p>end</p>"))
    assert len(rows) == depth + 3 and max(len(r["tokens"]) for r in rows) == 1
    nodes = spark.createDataFrame([{k: r[k] for k in r if k not in ("props", "flags")} | {"props": {}, "flags": {}} for r in rows], NODE_FIELDS)
    found = run("div d where d contain p q;", NodePlanner(nodes))
    assert found.count() == depth
    assert run("p q where q in div d;", NodePlanner(nodes)).count() == 1
    assert run("div d where d notIn div;", NodePlanner(nodes)).count() == 1


def test_empty_sides(spark):
    nodes = spark.createDataFrame([("t", 0, None, 0, 0, 0, "a")], SLIM)
    none = nodes.limit(0)
    assert holding(nodes, none).collect() == [] and holding(none, nodes).collect() == []
    assert inside(nodes, none).collect() == [] and inside(none, nodes).collect() == []
    assert holding(nodes, nodes).collect() == [] and inside(nodes, nodes).collect() == []


def test_no_python_and_no_paths_in_containment(spark):
    nodes = spark.createDataFrame([], NODE_FIELDS)
    assert "ancestors" not in nodes.columns
    plan = run("div d where d contain p q;", NodePlanner(nodes))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
