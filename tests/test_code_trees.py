import random
import zlib

import pytest
from pyspark.sql import functions as F

from treeloom import registry, registry_java
from treeloom.operators import patch, patterns, scopes, treediff
from treeloom.sources.files import parsed
from treeloom.tree import java
from treeloom.tree.nodes import NODE_FIELDS, allow_depth, preorder, rows_of
from treeloom.tree.printing import source_of, tokens_of

STATEMENTS = [
    "a(x);", "int v = g(1, y);", "if (x > 1) { b(); } else { c(); }", "for (int i = 0; i < n; i++) { d(i); }", "while (t) e();", "return z;",
    "try { f(); } catch (E q) { h(q); } finally { w(); }", 'x.y(k).z("s", 2);', "r = s[3] + 4 * u;", 'throw new E("m");', "do { m(); } while (p);",
    "switch (k) { case 1: a(); break; default: b(); }", "o = new P(1) { void q() { r(); } };", "xs.forEach(e -> p(e));", 'String[] ss = {"a", "b"};', "int u = c ? d : !e;",
]


def plain(text):
    return " ".join(t.text for t in java.java_tokens(text))


def printed(before, after, moves=True):
    a = java.parse_unit(before)
    edits, _, origins = treediff.diff_with_origins(a, java.parse_unit(after), moves)
    return source_of(treediff.apply_script(a, edits, origins))


def test_edited_trees_print_as_the_after_text():
    rng = random.Random(1)
    for _ in range(120):
        some = [rng.choice(STATEMENTS) for _ in range(rng.randint(0, 6))]
        other = list(some)
        for _ in range(rng.randint(1, 4)):
            how = rng.random()
            if how < 0.4:
                other.insert(rng.randint(0, len(other)), rng.choice(STATEMENTS))
            elif how < 0.6 and other:
                other.pop(rng.randrange(len(other)))
            elif how < 0.8:
                rng.shuffle(other)
            elif other:
                k = rng.randrange(len(other))
                other[k] = "if (w) { " + other[k] + " }"
        before, after = (f"class A {{ int f({rng.choice(['', 'int a', 'int a, String b'])}) {{ {' '.join(s)} }} }}" for s in (some, other))
        for moves in (True, False):
            assert printed(before, after, moves) == plain(after)


def test_children_in_new_roles_are_printed_in_place():
    for before, after in (
        ("class A { int f() { int x; g(); return; } }", "class A { int f(int k) throws E { int x = 3; g(x, 4); return x; } }"),
        ("class A { void f() { if (a) b(); else c(); } }", "class A { void f() { if (a) { b(); } } }"),
        ("class A { void f() { get(); } }", "class A { void f() { s.get(1); } }"),
        ("class A { void f() { s.get(1); } }", "class A { void f() { get(); } }"),
    ):
        assert printed(before, after) == plain(after) and printed(after, before) == plain(before)


def nodes(spark, *texts):
    return spark.createDataFrame([r for k, t in enumerate(texts) for r in rows_of(str(k), java.parse_unit(t))], NODE_FIELDS)


def test_scopes_choose_the_innermost_definition(spark):
    text = "class A { int v; void f(int p) { int x = p; { int x = v; use(x); } use(x); for (int i = 0; i < x; i++) { use(i); } use(y); } void g() { use(v); } }"
    df = nodes(spark, text)
    found = {r.use_id: r.def_id for r in scopes.resolved(df).collect()}
    rows = {r.node_id: r for r in df.collect()}
    by_name = {}
    for use, made in sorted(found.items()):
        by_name.setdefault(rows[use].name, []).append(made and (rows[made].node_type, rows[made].start_line is not None and made))
    assert [k for k, _ in by_name["v"]] == ["FieldDeclaration"] * 2 and [k for k, _ in by_name["p"]] == ["SingleVariableDeclaration"]
    assert by_name["x"][0] != by_name["x"][1] == by_name["x"][2] and by_name["y"] == [None] and len(by_name["i"]) == 3
    deps = scopes.with_data_deps(df)
    assert deps.columns == df.columns and deps.where("data_dep_id IS NOT NULL").count() == sum(d is not None for d in found.values())


def test_nodes_by_their_statement(spark):
    df = nodes(spark, "class A { void f() { a(1); if (b) { c(); } } }")
    rows = {r.node_id: r for r in df.collect()}
    got = {r.statement_type: [rows[i].node_type for i in r.node_ids] for r in scopes.by_statement(df).orderBy("statement_id").collect() if r.statement_type != "ExpressionStatement"}
    assert got["IfStatement"] == ["IfStatement", "SimpleName", "Block"] and got["MethodDeclaration"][0] == "MethodDeclaration"


def test_edits_are_considered_by_verdicts(spark):
    ops = spark.createDataFrame([("t", "tree-insert", 5), ("t", "move", 5), ("t", "insert", 6), ("t", "delete", 7)], "tree_id string, kind string, node_id long")
    said = spark.createDataFrame([("t", "insert", 5, ["name"]), ("t", "insert", 5, ["type"])], "tree_id string, kind string, node_id long, attrs array<string>")
    got = {(r.kind, r.node_id): (r.considered, {k for k, v in r.considered_attrs.items() if v}) for r in patterns.consider_edits(ops, said).collect()}
    assert got == {("tree-insert", 5): (True, {"name", "type"}), ("move", 5): (False, set()), ("insert", 6): (False, set())}


def test_policies_are_chosen_by_name(spark):
    df = nodes(spark, "class A { void f() { a(1); b(2); } }")
    assert set(patterns.POLICIES) == {"frequency", "random", "verdicts", "rounds"}
    judged = df.where("depth <= 1").select("tree_id", "node_id", F.lit(1).alias("verdict"))
    assert patterns.abstracted("verdicts", df, verdicts=judged, depth=3).where("considered").count() == 2
    assert 0 < patterns.abstracted("random", df, share=0.5).where("considered").count() < df.count()
    lines = spark.createDataFrame([("0", [1])], "tree_id string, lines array<int>")
    named = spark.createDataFrame([("0", "a ( 1 )")], "tree_id string, text string")
    kept = patterns.abstracted("rounds", df, lines=lines, named=named, threshold=0.99).where("considered")
    assert sorted(r.node_type for r in kept.collect()) == ["MethodInvocation"]
    with pytest.raises(ValueError, match="no policy"):
        patterns.abstracted("other", df)


def test_oracle_checks_and_places(spark):
    found = spark.createDataFrame([("a", None), ("a", "f"), ("b", "g")], "file string, signature string")
    wanted = spark.createDataFrame([("a", None), ("b", "h")], "file string, signature string")
    assert [tuple(r) for r in patterns.expected_found(found, wanted).collect()] == [("a", None)]
    ops = spark.createDataFrame([("t", 1), ("t", 8), ("t", -2)], "tree_id string, parent_id long")
    mapping = spark.createDataFrame([("t", 8, 3)], "tree_id string, after_id long, before_id long")
    binding = spark.createDataFrame([("t", 1, 11), ("t", 3, 13)], "tree_id string, p_node long, t_node long")
    assert sorted(map(tuple, patterns.edit_places(ops, mapping, binding).collect())) == [("t", -2, None, 3), ("t", 1, 11, 1), ("t", 8, 13, 2)]


def test_insert_strategies():
    before, after = "class P { void f() { a(); b(); } }", "class P { void f() { a(); b(); c(); } }"
    target = "class T { void f() { x(); a(); b(); y(); } }"
    p, t = java.parse_unit(before), java.parse_unit(target)
    edits, _, origins = treediff.diff_with_origins(p, java.parse_unit(after))
    number = lambda root: {(n.node_type, n.name or plain(java.text_of(n))): i for i, (n, _) in enumerate(preorder(root))}
    mine, theirs = number(p), number(t)
    binding = {i: theirs[k] for k, i in mine.items() if k in theirs}
    block = lambda root: next(i for i, (n, _) in enumerate(preorder(root)) if n.node_type == "Block")
    binding[block(p)] = block(t)
    texts = {s: source_of(patch.apply_pattern(t, edits, binding, {}, origins, p, patch.STRATEGIES[s])) for s in patch.STRATEGIES}
    assert "a ( ) ; b ( ) ; c ( ) ; y ( ) ;" in texts["sibling"] and "x ( ) ; a ( ) ; c ( ) ; b ( ) ;" in texts["index"]


def test_further_kinds_of_nodes():
    text = """class A<T extends B & C> { enum E { X(1) { void f() {} }, @D Y; int z; }
      <U> void f(Map<String, ? extends List<int[]>> m, int k[]) { int a = 1, b[] = {2}, c; try { g(); } catch (P | Q e) { h(A.class, int.class, super::f, int[]::new); }
      class L { } Object o = (Runnable & X) r; a.B<C>.D d = null; } }"""
    root = java.parse_unit(text)
    kinds = [n.node_type for n, _ in preorder(root)]
    assert "Opaque" not in kinds
    for kind in ("TypeParameter", "EnumConstantDeclaration", "WildcardType", "ParameterizedType", "VariableDeclarationFragment", "Dimension", "UnionType", "TypeLiteral",
                 "SuperMethodReference", "CreationReference", "TypeDeclarationStatement", "IntersectionType", "QualifiedType"):
        assert kind in kinds, kind
    assert [n.name for n, _ in preorder(root) if n.node_type in ("VariableDeclarationStatement", "VariableDeclarationFragment")] == ["a", "b", "c", "o", "d"]
    assert printed(text, text.replace("int a = 1", "long a = 2").replace("P | Q", "P | R")) == plain(text.replace("int a = 1", "long a = 2").replace("P | Q", "P | R"))


def test_renames_and_fragments(spark):
    p, t = nodes(spark, "class P { void f() { int a = 1, b = 2; use(a, b); } }"), nodes(spark, "class P { void f() { int x = 1, y = 2; use(x, y); } }")
    assert sorted(r.name for r in scopes.definitions(p).collect()) == ["a", "b"] and {r.type for r in scopes.definitions(p).collect()} == {"int"}
    assert scopes.resolved(p).where("def_id IS NOT NULL").count() == 2
    binding = p.select(F.lit("0").alias("pattern_id"), "tree_id", F.col("node_id").alias("p_node"), F.col("node_id").alias("t_node"))
    assert sorted((r.name, r.new_name) for r in scopes.renames(p, t, binding).collect()) == [("a", "x"), ("b", "y")]


def test_very_deep_trees_are_parsed_and_compared(spark):
    deep = "class A { void f() { " + "if (a) { " * 400 + "b();" + "}" * 400 + " } }"
    df = spark.createDataFrame([("d", deep, deep.replace("b()", "c()"))], "case_id string, before string, after string")
    rows = parsed(df, "java", "case_id", "before")
    assert rows.where("parse_error IS NOT NULL").count() == 0 and rows.count() > 1200
    assert [r.kind for r in treediff.edit_scripts(df, java.parse_unit).collect()] == ["update"]
    allow_depth()
    assert printed(deep, deep.replace("b()", "c()")) == plain(deep.replace("b()", "c()"))


def test_registered_queries_without_sql_equal_plain_python(spark):
    from treeloom.functions.sequences import line_changes
    from treeloom.tree.html import parse_html

    d = "/root/testdata/sf0.001"
    turns = sorted(map(tuple, spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text").collect()))
    want = sorted((b[0], b[1], *line_changes(a[2], b[2])) for a, b in zip(turns, turns[1:], strict=False) if a[0] == b[0] and a[2] is not None)
    got = registry.queries()["line_diff_counts"](spark, d).collect()
    assert len({r[:2] for r in turns}) < len(turns) or sorted(map(tuple, got)) == want
    pages = dict(map(tuple, spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()))
    totals = {}
    for k in sorted(pages):
        if k + 1 in pages:
            one = parse_html(pages[k])
            edits = treediff.simplify(treediff.diff(one, parse_html(pages[k + 1]))[0], one)
            totals[str(k)] = len(edits)
    found = {r.case_id: r.total_edits for r in registry.queries()["html_edit_counts"](spark, d).collect()}
    assert found == {k: n for k, n in totals.items() if n}


def test_code_tree_queries_have_sql():
    assert len(registry_java.QUERIES) >= 20 and set(registry_java.SQL) == set(registry_java.QUERIES) <= set(registry.queries())


def test_candidates_against_all_pairs(spark):
    from treeloom.functions.sequences import lcs_dice

    rng = random.Random(4)
    kinds, marks = ["A", "B"], ["(", ")", ";", "x", "y", "z"]
    made = lambda k: [(f"{k}{i % 3}", i, None if i % 3 == 0 else i - 1, rng.choice(kinds), rng.choice(["n", "m", None]), rng.choice(["int", "long", None]), rng.choices(marks, [5, 5, 5, 1, 1, 1], k=rng.randint(0, 9))) for i in range(30)]
    fields = "node_id long, parent_id long, node_type string, name string, expr_type string, tokens array<string>"
    p, t = made("p"), made("t")
    names = ("location", "name", "exprType", "type", "token")
    flags = [{a: rng.random() < 0.6 for a in names} for _ in p]
    left = spark.createDataFrame([(*r, f) for r, f in zip(p, flags)], f"pattern_id string, {fields}, considered_attrs map<string,boolean>")
    right = spark.createDataFrame(t, f"tree_id string, {fields}")
    want = set()
    for a, f in zip(p, flags):
        for b in t:
            if f["location"] and (a[2] is None) != (b[2] is None):
                continue
            if f["name"] and a[4] != b[4]:
                continue
            if f["exprType"] and a[5] != b[5] and a[5] and b[5]:
                continue
            bottom = 0.5 * f["type"] + 0.5 * f["token"]
            score = (0.5 * f["type"] * (a[3] == b[3]) + 0.5 * f["token"] * lcs_dice(a[6], b[6])) / bottom if bottom else 1.0
            if score > 0.2:
                want.add((a[0], a[1], b[0], b[1], round(score, 9)))
    got = {(r.pattern_id, r.p_node, r.tree_id, r.t_node, round(r.score, 9)) for r in patterns.candidates(left, right).collect()}
    assert got == want and len(want) > 100


def test_a_block_stays_with_the_method_if_most_of_its_statements_do():
    loop = "for (int i = 0; i < base; i++) { use(i, base); }"
    text = "class C { private int limit = 15; public static int check(int balance, String segment) { int base = balance + limit; %s return base * %s; } }"
    one, two = java.parse_unit(text % (loop, "2")), java.parse_unit(text % ("while (ready) { " + loop + " } audit(base, 1);", "3"))
    edits = treediff.simplify(treediff.diff(one, two)[0], one)
    assert sorted(e.kind for e in edits) == ["insert"] * 3 + ["move", "tree-insert", "update"]


def test_a_place_counts_what_moves_before_it_later():
    loop = "for (int i = 0; i < base; i++) { use(i, base); }"
    text = "class C { int check(int balance) { int base = balance; %s %s return base * 2; } }"
    for between in ("", "log(base);", "try { send(base); } catch (Exception e) { throw e; }"):
        one, two = java.parse_unit(text % (loop, between)), java.parse_unit(text % ("while (ready) { " + loop + " }", between + " audit(base, 1);"))
        edits = treediff.simplify(treediff.diff(one, two)[0], one)
        # behind the declaration, the guard, the loop that isn't in it yet, and what stands between
        assert [e.pos for e in edits if (e.kind, e.type) == ("tree-insert", "ExpressionStatement")] == [3 + bool(between)]


def test_a_pattern_places_nothing_by_what_leaves():
    loop, text = "for (int i = 0; i < 3; i++) { use(i); }", "class %s { void f() { a(); %s b(); } }"
    before, after = text % ("P", loop), text % ("P", "while (ready) { " + loop + " } audit();")
    p, t = java.parse_unit(before), java.parse_unit(text % ("T", "other(); " + loop))
    edits, _, origins = treediff.diff_with_origins(p, java.parse_unit(after))
    mine = {(n.node_type, plain(java.text_of(n)), up and up.node_type): i for i, (n, up) in enumerate(preorder(p)) if n.node_type.endswith("Statement")}
    theirs = {(n.node_type, plain(java.text_of(n)), up and up.node_type): i for i, (n, up) in enumerate(preorder(t))}
    block = lambda root: next(i for i, (n, up) in enumerate(preorder(root)) if n.node_type == "Block" and up.node_type == "MethodDeclaration")
    binding = {i: theirs[k] for k, i in mine.items()} | {block(p): block(t)}
    out = source_of(patch.apply_pattern(t, edits, binding, {}, origins, p, patch.STRATEGIES["sibling"]))
    assert out.index("a ( )") < out.index("while") < out.index("audit") < out.index("other") < out.index("b ( )")


def test_a_text_is_read_once_for_all_its_patches(spark, tmp_path):
    def parse(text):
        with open(tmp_path / str(zlib.crc32(text.encode())), "a") as f:
            f.write("x")
        if text == "bad":
            raise ValueError("can't be read")
        return java.parse_unit(text)

    text = "class T { void f() { a(); } }"
    changes = {p: ("class P { void f() { a(); } }", "class P { void f() { a(); %s(); } }" % p) for p in ("b", "c", "d")}
    body = next(i for i, (n, _) in enumerate(preorder(java.parse_unit(text))) if n.node_type == "Block")
    texts = spark.createDataFrame([(str(k), text.replace("T", f"T{k}")) for k in range(4)] + [("x", "bad")], "tree_id string, text string")
    rows = [(p, t.tree_id, k, body, body) for p in changes for t in texts.collect() for k in range(2)]
    instances = spark.createDataFrame(rows, "pattern_id string, tree_id string, instance int, p_node long, t_node long")
    found = patch.patched(texts, instances, changes, parse).collect()
    assert len(found) == 30 and all((r.error is None) == (r.tree_id != "x") for r in found)
    assert all(f"T{r.tree_id} {{ void f ( ) {{" in r.patched and f"{r.pattern_id}" in r.patched for r in found if r.error is None)
    assert [(tmp_path / str(zlib.crc32(t.text.encode()))).read_text() for t in texts.collect()] == ["x"] * 5


def test_untouched_parts_print_as_they_are():
    text = "class T { int a = 1, b; void f(int x) throws E { if (x > a) { g(x, 1); } else { h(); } for (int i = 0; i < b; i++) { g(i, b); } } }"
    for x in treediff.items(java.parse_unit(text))[1:]:
        assert tokens_of(x) == x.origin.own_tokens
    root = java.parse_unit(text)
    gone = next(i for i, (n, _) in enumerate(preorder(root)) if n.node_type == "ExpressionStatement")
    top = patch.apply_pattern(root, [treediff.Edit("delete", gone, 0)], {gone: gone})
    assert source_of(top) == " ".join(root.own_tokens).replace("g ( x , 1 ) ; ", "") and sum(x.whole for x in top.below()) > 20


def test_only_the_patched_instance_is_sought_and_only_tokens_that_count_are_compared(spark, monkeypatch):
    caps, sent = [], []
    search, dice = patterns.match_instances, patterns.lcs_dice_udf
    monkeypatch.setattr(patterns, "match_instances", lambda *a, **k: caps.append(k.get("cap")) or search(*a, **k))
    monkeypatch.setattr(patterns, "lcs_dice_udf", lambda a, b: sent.append(str(a)) or dice(a, b))
    registry_java.java_patch_kinds(spark, "/root/testdata/sf0.001")
    assert caps == [1] and sent and all("WHEN" in s for s in sent)


def test_node_tables_are_not_broadcast(spark):
    from treeloom.sources.files import parsed
    from treeloom.sources.work import written

    texts = spark.createDataFrame([("1", "class A { void f(int a) { int b = a; g(b); } }")], "tree_id string, text string")
    nodes = written(parsed(texts, "java", "tree_id", "text").drop("parse_error"), "java-nodes")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(scopes.with_data_deps(nodes)) + plan(scopes.by_statement(nodes))
    made = registry_java.pattern_table(spark, "class P { void f(int a) { g(a); } }", lambda n, p: n.node_type == "MethodInvocation", ("name", "type", "token"))
    # a pattern made in the driver is broadcast, not shuffled with its targets by their few types
    pairs = patterns.candidates(made, nodes)
    assert "BroadcastHashJoin" in plan(pairs) and [tuple(r)[:2] for r in pairs.select("tree_id", "t_node").collect()] == [
        (r.tree_id, r.node_id) for r in nodes.where("node_type = 'MethodInvocation'").collect()
    ]


@pytest.mark.parametrize("name", ["java_by_statement", "java_slots", "java_candidate_order", "java_generated_query", "java_consider", "java_dsl_flags", "java_dsl_roles"])
def test_only_columns_that_are_read_are_made(spark, monkeypatch, name):
    from treeloom.sources import work

    made = []
    monkeypatch.setattr(registry_java, "written", lambda df, what: made.append((what, df.columns)) or work.written(df, what))
    registry_java.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = next(c for what, c in made if what == "java-nodes")
    assert "subtree_hash" not in columns and len(columns) < 14


def test_some_columns_equal_those_of_whole_rows(spark):
    texts = spark.createDataFrame([("a", "class A { int f(int x) { return x + 1; } }"), ("b", None)], "id string, text string")
    columns = ["tree_id", "node_id", "name", "tokens", "parse_error"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(parsed(texts, "java", "id", "text", ("node_id", "name", "tokens"))) == rows(parsed(texts, "java", "id", "text"))
