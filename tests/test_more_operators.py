import json

from pyspark.sql import functions as F

from treeloom.functions import columns as C
from treeloom.operators import matching, patterns, sampling, sets
from treeloom.sources import files, sinks
from treeloom.tree import java
from treeloom.tree.nodes import NODE_FIELDS, rows_of

OPS = "tree_id string, kind string, node_id long, parent_id long, node_type string"


def test_action_related_nodes(spark):
    ops = spark.createDataFrame([("t", "delete", 3, None, None), ("t", "insert", -2, 7, "IfStatement"), ("t", "move", 4, 8, None), ("t", "tree-insert", -3, -2, "Block")], OPS)
    mapping = spark.createDataFrame([("t", 7, 1)], "tree_id string, after_id long, before_id long")
    assert {r.node_id for r in patterns.action_related(ops, mapping).collect()} == {3, 1, 4, 8}


def test_not_logic(spark):
    nodes = spark.createDataFrame([("t", 0, None, "MethodDeclaration"), ("t", 1, 0, "IfStatement"), ("t", 2, 1, "Block"), ("t", 3, 0, "TryStatement"), ("t", 4, 3, "Block"), ("t", 9, 0, "ReturnStatement")], "tree_id string, node_id long, parent_id long, node_type string")
    ops = [("t", "insert", -2, 0, "WhileStatement"), ("t", "insert", -3, 0, "Block"), ("t", "insert", -4, 9, "NullLiteral"), ("t", "move", 9, 2, None)]
    got = {(r.kind, r.node_id, r.parent_id) for r in patterns.not_logic(spark.createDataFrame(ops, OPS), nodes).collect()}
    assert got == {("insert", -2, 0), ("move", 9, 1)}  # the block is unwrapped, what goes into a moved node isn't told
    under_try = spark.createDataFrame([("t", "move", 9, 4, None)], OPS)
    assert patterns.not_logic(under_try, nodes).count() == 0
    many = spark.createDataFrame([("t", "insert", -2 - k, 0, "WhileStatement") for k in range(11)], OPS)
    assert patterns.not_logic(many, nodes).count() == 0


def test_lines_elements_and_order(spark):
    nodes = spark.createDataFrame([(1, 5, 6, 0), (2, 9, 9, 3), (3, 20, 30, 1)], "node_id long, start_line int, end_line int, depth int").withColumn("tree_id", F.lit("t"))
    assert {r.node_id for r in patterns.in_important_lines(nodes, F.array(F.lit(7), F.lit(31))).collect()} == {1, 3}
    assert [r.node_id for r in sampling.deepest_first(nodes).collect()] == [2, 3, 1]
    cats = spark.createDataFrame([("b",), ("z",), ("a",)], "c string")
    assert [r.c for r in sampling.by_category(cats, "c", ["a", "b"]).collect()] == ["a", "b", "z"]
    named = spark.createDataFrame([("k", "foo.bar()")], "key string, text string")
    els = spark.createDataFrame([("k", "FOO.bar()"), ("k", "other")], "key string, element string")
    assert [r.element for r in patterns.similar_elements(named, els).collect()] == ["FOO.bar()"]


def test_recall_and_sets(spark):
    fixed = spark.createDataFrame([("c1", "x = f();", "src/A.java"), ("c2", "y", "B.java")], "case_id string, code string, expected_path string")
    reports = spark.createDataFrame([("c1", "f", "/r/src/A.java"), ("c1", "g", "/r/B.java"), ("c2", "q", "B.java")], "case_id string, name string, path string")
    assert {tuple(r) for r in matching.recall_case(reports, fixed, ["case_id"]).collect()} == {("c1", True, 2), ("c2", False, 1)}
    a, b = spark.range(0, 5), spark.range(3, 8)
    assert sets.union(a, b).count() == 8 and sets.both(a, b).count() == 2 and sets.distinct_text(sets.concat(a, b), ["id"]).count() == 8


def test_columns(spark):
    df = spark.createDataFrame([("a/b.c/D.java", "x", None, None), ("E", "y", 1, 2)], "p string, k string, a int, b int")
    got = df.select(C.path_stem(F.col("p")), C.mapped(F.col("k"), {"x": "z"}), C.slot_fits(F.col("k"), F.lit("y"), F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("D", "z", True), ("E", "y", True)]
    assert java.text_of(java.parse_method("int f ( ) { return 1 ; }")) == "int f ( ) { return 1 ; }"


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"file": "a#B.java", "begin_line": 1, "end_line": 2}]))
    assert files.ground_truths(spark, str(tmp_path / "g.json")).first().file == "a/B.java"
    (tmp_path / "m.json").write_text(json.dumps([{"file_name": "B.java", "begin_line": 1, "method_signature": "f"}]))
    assert files.changed_methods(spark, str(tmp_path / "m.json")).first().method_signature == "f"
    (tmp_path / "v.json").write_text(json.dumps({"considered_elements": ["1"], "regex": {"1": "a.*"}}))
    assert files.verdicts(spark, str(tmp_path / "v.json")).first().regex == {"1": "a.*"}
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert files.csv_table(spark, str(tmp_path / "c")).count() == 2
    assert [tuple(r) for r in files.report_counts(df, ["k"]).collect()] == [("a", 2, True)]
    labelled = spark.createDataFrame([("fp", "x"), ("tp", "y"), ("fp", "z")], "label string, src string")
    assert files.labelled_codes(labelled, "fp", F.col("src"), 1).count() == 1
    one = lambda c, *v: spark.createDataFrame([("c1", *v)], f"case_id string, {c}")
    fps = spark.createDataFrame([("c1", 0, "first"), ("c1", 1, "second")], "case_id string, fp_no int, code string")
    for index, want in ((1, "second"), (5, "first")):
        r = files.refine_inputs(one("dsl string", "q"), one("before string, after string", "a", "b"), one("cause string", "r"), fps, index).first()
        assert (r.dsl, r.before, r.cause, r.fp_code) == ("q", "a", "r", want)
    nodes = spark.createDataFrame(rows_of("t", java.parse_method("int f() { return 1; }")), NODE_FIELDS)
    assert json.loads(sinks.attribute_json(patterns.attributes(nodes)).first().json)["0"]["type"] == "MethodDeclaration"
