import json

from pyspark.sql import functions as F

from treeloom.plans.compiler import NodePlanner
from treeloom.dsl.parser import parse
from treeloom.dsl.vocabulary import JAVA
from treeloom.sources import files, sinks
from treeloom.streaming import scan
from treeloom.tree.nodes import methods


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_code_trees_pairs_and_units(spark, tmp_path):
    put(tmp_path, "d1/g1/c1/before.java", "class A { int f() { return 1; } int g(int x) { return x; } }")
    put(tmp_path, "d1/g1/c1/after.java", "class A { int f() { return 2; } }")
    put(tmp_path, "d1/g1/c1/buggy.java", "class Z {}")
    put(tmp_path, "d1/g1/c2/error.java", b"class B { String s = \"\xe9\"; }")
    put(tmp_path, "d1/g1/c2/correct.java", "// nothing")
    put(tmp_path, "d1/g1/c2/.hidden/x.java", "class H {}")
    put(tmp_path, "d1/notes.txt", "x")
    src = files.source_files(spark, str(tmp_path))
    assert src.count() == 5 and src.where(F.col("text").contains("é")).count() == 1
    nodes = files.parsed(src, "java")
    assert nodes.where("parse_error IS NOT NULL").count() == 1
    first = files.method_by_signature(methods(nodes))
    assert sorted(r["name"] for r in first.collect()) == ["f", "f"]
    wanted = first.where(F.col("tree_id").contains("before")).select("tree_id", F.lit("int?g?int").alias("signature"))
    assert sorted(r["name"] for r in files.method_by_signature(methods(nodes), wanted).collect()) == ["f", "g"]
    pairs = {r.case_id.rsplit("/", 1)[-1]: r for r in files.code_pairs(src).collect()}
    assert "return 2" in pairs["c1"].after and "class B" in pairs["c2"].before
    cases = files.dataset_cases(src, str(tmp_path))
    assert {(r.dataset, r.group, r.case) for r in cases.collect()} >= {("d1", "g1", "c1"), ("d1", "g1", "c2")}
    assert sorted((r.unit.rsplit("/", 1)[-1], r.files) for r in files.scan_units(src).collect()) == [("c1", 3), ("c2", 2)]
    found = NodePlanner(nodes.where("parse_error IS NULL"), JAVA).plan(parse('functionDeclaration f where f.body contain literal l where l.value == 2;'))
    assert [r["name"] for r in found.collect()] == ["f"]


def test_reports_and_tables(spark, tmp_path):
    xml = "<errors><error><defectInfo><function>f</function><fileName><![CDATA[a/B.java]]></fileName><reportLine>7</reportLine></defectInfo></error><error/></errors>"
    p = put(tmp_path, "r.xml", xml)
    errors = files.report_errors(spark, p)
    assert [tuple(r)[:3] for r in errors.collect()] == [("f", "a/B.java", 7)]
    put(tmp_path, "none.xml", "<errors></errors>")
    per_file = files.report_errors(spark, str(tmp_path / "*.xml"))
    counts = files.report_counts(per_file, ["report"], files.report_files(spark, str(tmp_path)))
    assert sorted((r.report.rsplit("/", 1)[-1], r.n, r.has_error) for r in counts.collect()) == [("none.xml", 0, False), ("r.xml", 1, True)]
    p = put(tmp_path, "t.txt", "x\ta.java\tf()\t3#9\n")
    assert [tuple(r) for r in files.tabbed_results(spark, p).collect()] == [("a.java", "f()", 3, 9)]
    assert files.tabbed_results(spark, put(tmp_path, "e.txt", "Empty Pattern\n")).count() == 0
    p = put(tmp_path, "b.txt", "h#a.java#3#9#int f(A#B)\nbroken\n")
    assert [tuple(r) for r in files.baseline_warnings(spark, p).collect()] == [("h", "a.java", 3, 9, "int f(A#B)")]
    p = put(tmp_path, "s.txt", "pre\nhash#1\nx\nhash#2\nhash#3\ny")
    assert [r.section for r in files.sectioned(spark, p).orderBy("line_no").collect()] == [0, 1, 1, 2, 3, 3]
    p = put(tmp_path, "f.txt", "get\n12\nput\nnone\nget\n15\nlast")
    assert [tuple(r) for r in files.frequency_table(spark, p, "api").collect()] == [("api", "get", 15)]
    p = put(tmp_path, "c.json", json.dumps({"before_commit_id": "x", "before_start": "3"}))
    assert files.change_info(spark, p).first().before_start == "3"
    p = put(tmp_path, "p.json", json.dumps({"FileName": "A", "Before0Tree": {"id": 1, "type": "T", "children": [{"id": 2, "type": "U", "leaf": True}]}}))
    rows = files.pattern_nodes(files.patterns(spark, p)).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.type) for r in rows] == [(1, None, "T"), (2, 1, "U")]
    repos = spark.createDataFrame([({"Java": 30000}, False), ({"Java": 30000}, True), ({"C": 1}, False)], "languages map<string,bigint>, isArchived boolean")
    assert files.repositories(repos).count() == 1
    assert files.settings(put(tmp_path, "c.yaml", "# x\na: 1\nb:\n  c: 'd'\n")) == {"a": "1", "b.c": "d"}
    text = "e: &v two\nlist:\n  - x\n  - 'y: z'\nobjs:\n- name: n1\n  v: 1\n- name: n2\nf: *v\nbase: &base\n  p: 1\nderived:\n  <<: *base\n  r: 3\ntext: |\n  l1\n  l2\nlast: ok\n"
    want = {"e": "two", "list.0": "x", "list.1": "y: z", "objs.0.name": "n1", "objs.0.v": "1", "objs.1.name": "n2", "f": "two", "base.p": "1", "derived.p": "1", "derived.r": "3"}
    assert files.settings(put(tmp_path, "d.yaml", text)) == want | {"text": "l1\nl2", "last": "ok"}


def test_scan_units_of_mixed_folders(spark):
    paths = ["/r/a/A.java", "/r/a/B.java", "/r/b/C.java", "/r/b/pom.xml", "/r/c/D.java", "/r/c/in/E.java", "/r/.git/F.java", "/r/d/notes.txt"]
    units = files.scan_units(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(map(tuple, units.collect())) == [("/r/a", 2), ("/r/b/C.java", 1), ("/r/c/D.java", 1), ("/r/c/in", 1)]


def test_filters_and_labels(spark):
    df = spark.createDataFrame([("x", "tp", "int Foo()", "a.java"), ("y", "fp", "g()", "FOO.java"), (None, "tp", None, "b.java")], "checker string, label string, signature string, file string")
    assert sorted(r.file for r in files.without_denied(df, ["x"]).collect()) == ["FOO.java", "b.java"]
    assert files.dashboard(df, "foo").count() == 2 and files.dashboard(df, "foo", label="tp").count() == 1
    assert [r.code for r in files.labelled_codes(df, "tp", F.col("file"), 1).collect()] == ["a.java"]


def test_edits_as_json(spark):
    ops = spark.createDataFrame([("t", "insert", 5, 1, 0, "X", "v"), ("t", "move", 3, 2, 1, None, None), ("u", "delete", 3, 2, None, None, None)], "tree_id string, kind string, node_id long, parent_id long, pos int, node_type string, value string")
    got = {r.tree_id: (json.loads(r.insertNodes), json.loads(r.moveParentNodes)) for r in sinks.edit_json(ops).collect()}
    assert got["t"] == ([{"id": 5, "parent": 1, "pos": 0, "node_type": "X", "value": "v"}], [{"id": 3, "parent": 2, "pos": 1}]) and got["u"] == ([], [])


def test_store_keeps_the_later_entry_of_one_write(spark, tmp_path):
    sinks.append_store(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").coalesce(1), str(tmp_path / "s"))
    assert sorted(map(tuple, sinks.read_store(spark, str(tmp_path / "s"), ["k"]).collect())) == [("a", 2), ("b", 3)]


def test_sinks(spark, tmp_path):
    src = spark.createDataFrame([("m", "class A { int f() { return 1; } }")], "path string, text string")
    nodes = files.parsed(src, "java").drop("parse_error")
    assert sinks.read_nodes(spark, str(tmp_path / "none")) is None
    sinks.write_nodes(nodes, str(tmp_path / "n"))
    assert sinks.read_nodes(spark, str(tmp_path / "n")).count() == nodes.count()
    assert json.loads(sinks.node_json(nodes).first()["json"])[0]["type"] == "CompilationUnit"
    found = spark.createDataFrame([("p", "f", None), ("q", None, None)], "pattern string, file string, signature string")
    got = {r.pattern: json.loads(r.json) for r in sinks.detection_json(found, ["pattern"]).collect()}
    assert got == {"p": {"detected": True, "results": [{"file": "f", "signature": None}]}, "q": {"detected": False, "results": []}}
    sinks.save_context(spark, str(tmp_path / "ctx"), "extract", {"a": "1", "b": "2"})
    sinks.save_context(spark, str(tmp_path / "ctx"), "extract", {"a": "3"})
    assert sinks.load_context(spark, str(tmp_path / "ctx"), "extract") == {"a": "3", "b": "2"}
    sinks.write_texts(found, str(tmp_path / "t"), "file", ["pattern"])
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_arriving_files_are_scanned_once(spark, tmp_path):
    put(tmp_path, "in/a.java", "class A { int f() { return 1; } }")
    detect = lambda nodes: nodes.where("node_type = 'ReturnStatement'").select("tree_id")
    go = lambda: scan.scan(scan.arriving(spark, str(tmp_path / "in")), "java", detect, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert go()
    put(tmp_path, "in/b.java", "class B { int g() { return 1; } }")
    assert go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_commit_files(spark, tmp_path):
    import subprocess

    from treeloom.sources.git import commit_files

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    put(tmp_path, "a/A.java", "class A {}")
    put(tmp_path, "b/é B.java", "class B { String s = \"é\n\"; }")
    put(tmp_path, "c.txt", "no")
    git("add", "-A")
    git("commit", "-qm", "one")
    put(tmp_path, "a/A.java", "class Changed {}")
    got = {r.path: r.text for r in commit_files(spark, str(tmp_path), "HEAD").collect()}
    assert got == {"a/A.java": "class A {}", "b/é B.java": "class B { String s = \"é\n\"; }"}


def test_reports_count_whole_or_not_at_all(spark, tmp_path):
    error = "<error><defectInfo><function>{0}</function><fileName> a/B.java </fileName><reportLine>{1}</reportLine></defectInfo></error>"
    two = error.format("f", 7) + error.format("<![CDATA[g<T>(int & x)]]>", 9)
    texts = {
        "whole.xml": f"<errors>{two}</errors>",
        "cut.xml": f"<errors>{two}<error><defectInfo><function>h",
        "no_end.xml": f"<errors>{two}",
        "tail.xml": f"<errors>{two}</errors><more>",
        "empty.xml": "",
        "none.xml": "<errors/>",
        "odd.xml": f"<errors>{error.format('k', 'x1')}<error/><error><defectInfo/></error></errors>",
        "entity.xml": f'<!DOCTYPE e [<!ENTITY a "b">]><errors>{two}</errors>',
    }
    for name, text in texts.items():
        put(tmp_path, name, text)
    found = {}
    for r in files.report_errors(spark, str(tmp_path / "*.xml")).collect():
        found.setdefault(r.report.rsplit("/", 1)[-1], []).append(tuple(r)[:3])
    want = [("f", "a/B.java", 7), ("g<T>(int & x)", "a/B.java", 9)]
    assert found == {"whole.xml": want, "odd.xml": [("k", "a/B.java", None), (None, None, None)]}
    latin = tmp_path / "latin"
    latin.mkdir()
    (latin / "said.xml").write_bytes(('<?xml version="1.0" encoding="ISO-8859-1"?><errors>' + error.format("größe", 1) + "</errors>").encode("latin-1"))
    (latin / "unsaid.xml").write_bytes(("<errors>" + error.format("größe", 1) + "</errors>").encode("latin-1"))
    assert [r.function for r in files.report_errors(spark, str(latin)).collect()] == ["größe"]
    assert [r.function for r in files.report_errors(spark, str(latin), "iso-8859-1").collect()] == ["größe"] * 2


def test_sections_over_many_splits(spark, tmp_path):
    import random

    rng = random.Random(2)
    texts = {}
    for name in "abc":
        lines = ["pre"] * rng.randint(0, 3)
        for k in range(40):
            lines += [f"hash#{name}{k}"] + [f"line {i} " + "x" * rng.randint(0, 60) for i in range(rng.choice((0, 1, 2, 60)))]
        texts[name] = lines
        put(tmp_path, f"{name}.txt", "\n".join(lines) + "\n")
    put(tmp_path, "none.txt", "no header\nat all\n")
    texts["none"] = ["no header", "at all"]
    want = set()
    for name, lines in texts.items():
        section = 0
        for k, line in enumerate(lines):
            section += line.startswith("hash#")
            want.add((name, section, k, line))
    for size in ("97", "4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = files.sectioned(spark, str(tmp_path))
            got = {(r.file.rsplit("/", 1)[-1][:-4], r.section, r.line_no, r.line) for r in found.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want, size


def test_settings_in_quotes_and_in_one_line(tmp_path):
    text = """a: "x # y"   # a comment
b: 'it''s #1'
c#d: e#f
list: [1, "two, three", [4, 5], {k: v}]
map: {d: 1, 'e f': "g: h", n: [x]}
items:
  - [p, q]
  - {r: s}
  - "t: # u"
esc: "say \\"hi\\" \\\\ now"
empty: []
"""
    want = {
        "a": "x # y", "b": "it's #1", "c#d": "e#f", "list.0": "1", "list.1": "two, three", "list.2.0": "4", "list.2.1": "5", "list.3.k": "v", "map.d": "1", "map.e f": "g: h", "map.n.0": "x",
        "items.0.0": "p", "items.0.1": "q", "items.1.r": "s", "items.2": "t: # u", "esc": 'say "hi" \\ now',
    }
    assert files.settings(put(tmp_path, "q.yaml", text)) == want
