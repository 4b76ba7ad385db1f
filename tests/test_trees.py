import copy
import random

import pytest
from pyspark.sql import functions as F

from treeloom.dsl.analyzer import validate
from treeloom.dsl.parser import parse
from treeloom.dsl.printer import show
from treeloom.dsl.vocabulary import JAVA
from treeloom.operators import generate, patch, patterns
from treeloom.operators.treediff import apply_script, diff, edit_counts, edit_scripts, items, simplify
from treeloom.plans.compiler import NodePlanner
from treeloom.tree import html, java
from treeloom.tree.nodes import NODE_FIELDS, Node, methods, neighbourhood, preorder, rows_of, tree_of

BEFORE = """class A {
  public static int size(java.util.List<String> xs, int k) throws Exception {
    String s = xs.get(0);
    if (s.isEmpty() && k > 0x1F) { return -1; }
    for (int i = 0; i < k; i++) { s += i; }
    try (Reader r = open(s)) { return r.read(); } catch (IOException | Error e) { throw new RuntimeException("x", e); } finally { k--; }
  }
}"""
AFTER = BEFORE.replace("String s = xs.get(0);", "if (xs == null) return 0;\n    String t = xs.get(0);").replace("(s.", "(t.").replace("{ s += i; }", "{ t += i; }")


def random_tree(rng, depth=0):
    n = Node(rng.choice("ABC"), rng.choice(["x", "y", ""]), label=rng.choice("pqr"))
    if depth < 4:
        n.children = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return n


def mutated(rng, root):
    n = copy.deepcopy(root)
    every = [x for x, _ in preorder(n)]
    for _ in range(rng.randint(1, 5)):
        x, how = rng.choice(every), rng.random()
        if how < 0.3:
            x.label = rng.choice("pqrs")
        elif how < 0.6 and x.children:
            x.children.pop(rng.randrange(len(x.children)))
        elif how < 0.8:
            x.children.insert(rng.randint(0, len(x.children)), random_tree(rng, 3))
        else:
            rng.shuffle(x.children)
    return n


def test_script_turns_before_into_after():
    rng = random.Random(6)
    for k in range(400):
        a = random_tree(rng)
        b = mutated(rng, a) if k % 3 else random_tree(rng)
        for moves in (True, False):
            edits, _ = diff(a, b, moves)
            assert apply_script(a, edits).shape() == items(b)[0].shape()
            assert moves or all(e.kind != "move" for e in edits)


def test_equal_trees_need_no_edit_and_subtrees_collapse():
    a, b = java.parse_method(BEFORE), java.parse_method(AFTER)
    assert diff(a, a)[0] == []
    edits, pairs = diff(a, b)
    assert pairs and len(simplify(edits, a)) <= len(edits)
    assert any(e.kind == "tree-insert" for e in simplify(edits, a))
    leaf = Node("B", "x", label="l")
    big = Node("A", children=[Node("B", "x", children=[Node("C", "y"), leaf])])
    gone = simplify(diff(big, Node("A"))[0], big)
    assert [e.kind for e in gone] == ["tree-delete"]


def test_pattern_applied_to_its_own_before_tree_gives_the_after_tree():
    a, b = java.parse_method(BEFORE), java.parse_method(AFTER)
    edits, _ = diff(a, b)
    own = {i: i for i, _ in enumerate(preorder(a))}
    assert patch.apply_pattern(a, edits, own).shape() == items(b)[0].shape()
    other = java.parse_method(BEFORE.replace("String s ", "String word ").replace(" s ", " word ").replace("(s", "(word"))
    renames = patch.variable_renames(a, other, own)
    assert renames["s"] == "word"


def test_java_front_end():
    m = java.parse_method(BEFORE)
    kinds = [n.node_type for n, _ in preorder(m)]
    assert "Opaque" not in kinds
    for kind in ("IfStatement", "InfixExpression", "ForStatement", "TryStatement", "CatchClause", "ThrowStatement", "ClassInstanceCreation", "PostfixExpression"):
        assert kind in kinds
    assert m.flags == {"isPublic": True, "isStatic": True} and m.props["signature"] == "int?size?java.util.List<String>,int"
    assert java.signature("static <T> String[] f(final Map<String, T> a, int... b)") == ("String[]", "f", ["Map<String,T>", "int..."])
    odd = java.parse_unit("class B { void f() { switch (x) { case 1 -> y(); } z(); } int g() { return (a) -> b; } enum }")
    assert any(n.node_type == "MethodDeclaration" and n.name == "f" for n, _ in preorder(odd))
    types = {n.label: n.expr_type for n, _ in preorder(m) if n.node_type == "SimpleName"}
    assert types["k"] == "int" and types["s"] == "String"
    with pytest.raises(java.JavaError):
        java.parse_unit("  // nothing")


def test_rows_and_back():
    m = java.parse_method(BEFORE)
    rows = rows_of("t", m)
    assert [r["pre"] for r in rows] == list(range(len(rows))) and sorted(r["post"] for r in rows) == list(range(len(rows)))
    for r in rows:
        inside = {x["node_id"] for x in rows if r["pre"] < x["pre"] and x["post"] < r["post"]}
        assert inside == {x["node_id"] for x in rows if r["pre"] < x["pre"] <= r["post"] + r["depth"]}
    again = rows_of("t", tree_of(rows))
    assert [r["subtree_hash"] for r in again] == [r["subtree_hash"] for r in rows]
    assert rows[0]["tokens"][:3] == ["public", "static", "int"]


def test_generated_query_finds_the_before_tree_only(spark):
    a, b = java.parse_method(BEFORE), java.parse_method(AFTER)
    order = [n for n, _ in preorder(a)]
    considered = {i for i, n in enumerate(order) if n.node_type in ("MethodInvocation", "SimpleName", "VariableDeclarationStatement", "InfixExpression")}
    inserted = [(next(i for i, n in enumerate(order) if n.node_type == "Block"), Node("NullLiteral", dsl_type="nullLiteral"))]
    q = generate.generate(a, considered, inserted=inserted)
    assert [f for f in validate(parse(show(q)), JAVA) if f.severity == "error"] == []
    rows = rows_of("before", a) + rows_of("after", b)
    nodes = spark.createDataFrame(rows, NODE_FIELDS)
    assert [r.tree_id for r in NodePlanner(nodes, JAVA).plan(parse(show(q))).collect()] == ["before"]
    bare = generate.generate_text(a, set())
    assert bare.split() == 'functionDeclaration fundecl_1 where fundecl_1.name == "size";'.split()


def test_match_and_detect(spark):
    a, b = java.parse_method(BEFORE), java.parse_method("void f() { g(); }")
    nodes = spark.createDataFrame(rows_of("same", a) + rows_of("other", b), NODE_FIELDS)
    attrs = F.create_map(*[x for n in ("location", "name", "exprType", "type", "token") for x in (F.lit(n), F.lit(True))])
    wanted = nodes.where("tree_id = 'same' AND node_type IN ('MethodInvocation', 'IfStatement')").withColumn("pattern_id", F.lit("p")).withColumn("considered_attrs", attrs)
    pairs = patterns.candidates(wanted, nodes)
    own = pairs.where("p_node = t_node AND tree_id = 'same'").collect()
    assert len(own) == wanted.count() and all(r.score == 1.0 for r in own)
    found = patterns.match_instances(pairs, wanted)
    assert [r.tree_id for r in patterns.detect(found).collect()] == ["same"]
    first = {(r.p_node, r.t_node) for r in found.where("instance = 0").collect()}
    assert all(p == t for p, t in first)


def test_assignments_are_one_to_one_and_capped():
    every = patterns.assignments({k: list(range(6)) for k in range(6)}, {}, {})
    assert len(every) == patterns.MAX_INSTANCES and all(len(set(a.values())) == 6 for a in every)
    assert patterns.assignments({1: [5], 2: [5]}, {}, {}) == [] and patterns.assignments({}, {}, {}) == []
    kept = patterns.assignments({1: [10], 2: [11, 12]}, {2: 1}, {11: 10, 12: 99})
    assert kept == [{1: 10, 2: 11}, {1: 10, 2: 12}]
    assert patterns.assignments({1: [10, 20], 2: [21]}, {2: 1}, {21: 20}) == [{2: 21, 1: 10}, {2: 21, 1: 20}]


def test_consideration(spark):
    a = java.parse_method(BEFORE)
    nodes = spark.createDataFrame(rows_of("t", a), NODE_FIELDS)
    freq = spark.createDataFrame([("api", "get", 6086), ("api", "isEmpty", 6087)], "kind string, token string, cnt int")
    near = nodes.where("node_id = -1").select("tree_id", "node_id")
    out = {r["name"]: r for r in patterns.consider(nodes, freq, near).where("node_type = 'MethodInvocation'").collect()}
    assert out["get"].considered_attrs["name"] and not out["isEmpty"].considered_attrs["name"] and out["open"].considered_attrs["name"]
    assert not out["get"].considered
    n = patterns.random_consider(nodes).where("considered").count()
    assert n == nodes.count() // 10


def test_methods_skip_nested_ones(spark):
    unit = java.parse_unit("class A { void f() { new B() { void g() {} }; } void h() {} }")
    nodes = spark.createDataFrame(rows_of("t", unit), NODE_FIELDS)
    assert sorted(r["name"] for r in methods(nodes).collect()) == ["f", "h"]
    seed = nodes.where("name = 'h'").select("tree_id", "node_id")
    assert {r.hops for r in neighbourhood(nodes, seed, 2).collect()} == {0, 1, 2}


def test_edits_of_pairs(spark):
    pairs = spark.createDataFrame([("a", BEFORE, AFTER), ("b", BEFORE, BEFORE), ("c", "", AFTER)], "case_id string, before string, after string")
    edits = edit_scripts(pairs, java.parse_unit)
    counts = {r.case_id: r for r in edit_counts(edits).collect()}
    assert counts["a"].insert > 0 and "b" not in counts and counts["c"].total_edits == 0
    assert edits.where("error IS NOT NULL").count() == 1


def test_edits_leave_a_task_as_they_come(spark):
    """One batch of many pairs: few are read before the first edits go, however large the batch and its scripts are."""
    import pyarrow as pa

    class Caught:  # what the mapping runs in a task
        select = lambda self, *_: self
        mapInArrow = mapInPandas = lambda self, run, _: run  # noqa: E731, N815

    n, read = 400, []

    def parse_counted(text):
        read.append(text)
        return html.parse_html(text)

    texts = [(str(k), f"<p>{k}</p>", "<ul>" + f"<li>{k}</li>" * 20 + "</ul>") for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*texts)], names=["case_id", "before", "after"])
    out = edit_scripts(Caught(), parse_counted, held_chars=4096)(iter([batch]))
    found = [next(out)]
    assert len(read) < 20 and found[0].num_rows <= 64
    found += out
    assert len(read) == 2 * n and max(b.num_rows for b in found) <= 64
    pairs = spark.createDataFrame(texts, "case_id string, before string, after string")
    want = edit_scripts(pairs, html.parse_html)
    assert sorted(map(str, pa.Table.from_batches(found).to_pylist())) == sorted(str(r.asDict()) for r in want.collect())
    few = edit_scripts(pairs, html.parse_html, columns=("case_id", "kind"))
    assert few.columns == ["case_id", "kind"] and sorted(edit_counts(few).collect()) == sorted(edit_counts(want).collect())


def test_html():
    t = html.parse_html("<ul><li>a<li>b<br><p>c<p>d</ul>&amp; <img src=x/>")
    shape = [(n.node_type, n.label) for n, _ in preorder(t)]
    assert shape == [("document", ""), ("ul", "ul"), ("li", "li"), ("text", "a"), ("li", "li"), ("text", "b"), ("br", "br"), ("p", "p"), ("text", "c"), ("p", "p"), ("text", "d"), ("text", "&"), ("img", "img")]
    assert html.parse_html(None).children == []


def test_definitions_take_the_innermost_scope(spark):
    uses = spark.createDataFrame([("t", 1, "x", 10, 10), ("t", 2, "x", 50, 50), ("t", 3, "y", 5, 5)], "tree_id string, use_id int, name string, start int, end int")
    defs = spark.createDataFrame([("t", 7, "x", 1, 99, False), ("t", 8, "x", 8, 20, False), ("t", 9, "x", 9, 12, True)], "tree_id string, def_id int, name string, scope_start int, scope_end int, is_global boolean")
    got = {r.use_id: r.def_id for r in patterns.identifier_definitions(uses, defs).collect()}
    assert got == {1: 8, 2: 7, 3: None}


def grown(rng, n):
    made = [Node(rng.choice("abc"), label=rng.choice("xyz"))]
    for _ in range(n - 1):
        made.append(rng.choice(made[-8:]).add(Node(rng.choice("abc"), label=rng.choice("xyz")), rng.choice("rs")))
    return made[0]


def test_bijection_is_kept_through_the_script():
    import random

    from treeloom.operators.treediff import full_diff

    rng = random.Random(4)
    for _ in range(120):
        before, after = grown(rng, rng.randint(1, 60)), grown(rng, rng.randint(1, 60))
        found = full_diff(before, after)
        both = found.pairs + found.inserted
        assert len({x for x, _ in both}) == len({y for _, y in both}) == len(both)
        assert sorted(y for _, y in both) == list(range(len(items(after)) - 1))  # every after node has its partner
        gone = {e.node for e in found.edits if e.kind == "delete"}
        assert {x for x, _ in found.pairs} | gone == set(range(len(items(before)) - 1))
        to = dict(both) | {-1: -1}
        assert all(to[e.parent] == e.after for e in found.edits if e.kind in ("insert", "move"))
        assert apply_script(before, found.edits).shape() == items(after)[0].shape()


def test_large_and_deep_trees():
    def page(n, changed):
        top = Node("ul")
        for i in range(n):
            if not (changed and i % 7 == 0):
                top.add(Node("li"), "children").add(Node("t", label=f"text {i + 100_000 * (changed and i % 5 == 0)}"), "children")
        return top

    edits, pairs = diff(page(20_000, False), page(20_000, True))
    assert len([e for e in edits if e.kind == "delete"]) == 2 * (20_000 // 7 + 1) and len(pairs) == 40_001 - 2 * (20_000 // 7 + 1)
    deep = [Node("d"), Node("d")]
    for k, top in enumerate(deep):
        at = top
        for i in range(20_000):
            at = at.add(Node("d", label="" if i % 10 else f"{k}-{i}"), "children")
        at.add(Node("t", label="end"), "children")
    edits, pairs = diff(*deep)
    assert len(pairs) == 20_002 and {e.kind for e in edits} == {"update"} and len(edits) == 2000


def test_parser_tries_only_what_may_fit(monkeypatch):
    tried = []
    trying = java.JavaParser.trying
    monkeypatch.setattr(java.JavaParser, "trying", lambda self, f: tried.append(f) or trying(self, f))
    root = java.parse_unit("class C { void m(int b) { a(b, c + d * 2, b > 1); b = c; log(b); } }")
    assert len(tried) <= 6 and "Opaque" not in {n.node_type for n, _ in preorder(root)}
    assert [n.node_type for n, _ in preorder(java.parse_unit("class C { void m() { f((a) -> a, b -> { }); } }"))].count("LambdaExpression") == 2


def test_an_open_block_at_the_start_ends():
    assert [c.node_type for c in java.parse_unit("{ { }").children] == ["Opaque"]
