import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeloom import registry
from treeloom.functions import columns as C
from treeloom.functions import sequences as S
from treeloom.operators import matching, metrics, patterns, sampling, sets


@pytest.fixture(scope="module")
def w(spark):
    rows = [(1, "a", 9), (2, "a", 11), (3, "a", 22), (4, "b", 100), (5, "c", 5)]
    return spark.createDataFrame(rows, "warning_id long, file string, line int")


@pytest.fixture(scope="module")
def t(spark):
    rows = [(10, "a", 10, 20), (11, "a", 10, 12), (12, "b", 9, 99), (13, "d", 1, 2)]
    return spark.createDataFrame(rows, "truth_id long, file string, begin int, end int")


def test_ranges_compare_numbers(w, t):
    got = {(r.warning_id, r.truth_id) for r in matching.range_matches(w, t, ["file"], 1).collect()}
    assert got == {(1, 10), (1, 11), (2, 10), (2, 11), (4, 12)}
    assert {(r.warning_id, r.truth_id) for r in matching.binned_range_matches(w, t, ["file"], 1, width=4).collect()} == got
    exact = {(r.warning_id, r.truth_id) for r in matching.range_matches(w, t, ["file"], 0).collect()}
    assert exact == {(2, 10), (2, 11)}


def test_greedy_takes_each_truth_once(w, t):
    pairs = matching.range_matches(w, t, ["file"], 1)
    one = {(r.warning_id, r.truth_id) for r in matching.greedy_one_to_one(pairs, "file", "warning_id", "truth_id").collect()}
    assert one == {(1, 10), (2, 11), (4, 12)}
    out = {r.file: r for r in matching.one_to_one_metrics(w, t, matching.greedy_one_to_one(pairs, "file", "warning_id", "truth_id"), "file").collect()}
    assert (out["a"].tp, out["a"].fp, out["a"].fn) == (2, 1, 0) and out["a"].recall == 1.0
    assert (out["c"].tp, out["c"].fp, out["c"].fn, out["c"].f1) == (0, 1, 0, 0.0) and out["d"].fn == 1


def test_many_to_one_never_counts_below_zero(w, t):
    found = matching.many_to_one(w, t, ["file"], "warning_id", "truth_id")
    assert {r.warning_id: r.truth_id for r in found.collect()} == {1: 10, 2: 10, 3: None, 4: 12, 5: None}
    r = matching.many_to_one_counts(found, t, "truth_id").first()
    assert (r.tp, r.fp, r.fn) == (3, 2, 2)


def test_labels(spark, w, t):
    f = spark.createDataFrame([(7, "a", 1, 15, "f()"), (8, "d", 1, 9, "g()")], "function_id long, file string, begin int, end int, signature string")
    got = sorted(map(tuple, matching.labelled(w, t, f, ["file"]).collect()), key=str)
    assert got == sorted([("tp", 1, 10, 7), ("tp", 2, 10, 7), ("fn", None, 13, 8), ("fn", None, 11, 7)], key=str)
    some = w.withColumn("function", F.lit("f("))
    assert sorted(r.warning_id for r in matching.changed_only(some, f, ["file"]).collect()) == [1, 2]


def test_guarded_rates(spark):
    r = spark.createDataFrame([("x", True, False)] * 2 + [("y", False, False)], "c string, on_buggy boolean, on_fixed boolean")
    out = {x.c: x for x in matching.paired_confusion(r, ["c"]).collect()}
    assert out["x"].f1 == 1.0 and out["y"].precision == 0.0 and out["y"].accuracy == 0.5


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 6, 10, 11, 20, 21, None)], "v int")
    assert [r.n for r in metrics.binned(df, "v", [0, 5, 10, 20]).orderBy("bin").collect()] == [1, 2, 2, 1]
    left = spark.createDataFrame([(v,) for v in (1, 2, 4, 6, 11)], "v int")
    got = metrics.binned(left, "v", [1, 2, 4, 6, 11], right=False).orderBy("bin").collect()
    assert [r.n for r in got] == [1] * 5 and got[-1].label == "[11, inf)"
    none = metrics.binned(df.limit(0), "v", [0, 5]).orderBy("bin").collect()
    assert [(r.n, r.share) for r in none] == [(0, 0.0), (0, 0.0)]


def test_summaries(spark):
    d = spark.createDataFrame([(True, 3, 1.0), (False, 0, 9.0)], "detected boolean, n_results int, seconds double")
    r = metrics.detection_summary(d).first()
    assert (r.total, r.detected, r.rate, r.mean_results, r.mean_seconds) == (2, 1, 0.5, 3.0, 1.0)
    p = spark.createDataFrame([("a", True, False), ("a", True, True), ("b", False, False)], "group string, adapted boolean, correct boolean")
    assert tuple(metrics.repair_summary(p).first()) == (2, 1, 1, 1)
    s = spark.createDataFrame([(1, 2), (5, 2), (-1, 4)], "n int, m int")
    assert tuple(metrics.scan_summary(s).first()) == (1, 5, 3.0, 1, 1)


def test_sampling_repeats_and_keeps_sizes(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS g")
    a, b = sampling.sample_k(df, "id", 9).collect(), sampling.sample_k(df.repartition(5), "id", 9).collect()
    assert a == b and len(a) == 9
    assert sampling.one_per_group(df, ["g"], "id").count() == 7
    assert sampling.share_of_rows(df, ["g"], "id", 0.5).count() == 2 * 7 + 5 * 7
    assert sampling.few_or_none(df, ["g"], 14).select("g").distinct().count() == 5


def test_sets(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, step int, v string")
    assert {tuple(r) for r in sets.latest(h, ["k"], "step").collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert [r.history for r in sets.upto_step(h, "k", "step", F.col("v")).orderBy("k", "step").collect()] == [["x"], ["x", "y"], ["z"]]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["p", "hash#1", "a", "hash#2", "hash#3", "b"])], "file string, line_no int, line string")
    assert [r.section for r in sets.sections(lines, F.col("line").startswith("hash#")).orderBy("line_no").collect()] == [0, 1, 1, 2, 3, 3]
    cases = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "3")], "grp string, c string")
    assert sets.cross_cases(cases, "grp", "c").count() == 2 and sets.cross_cases(cases, "grp", "c", same=True).count() == 3


def test_sequences(spark):
    assert S.lcs_pairs("abcbd", "acbd") == [(0, 0), (2, 1), (3, 2), (4, 3)]
    import random

    rng = random.Random(1)
    for _ in range(40):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in "ab")
        whole, most = S.lcs_pairs(a, b), S.MAX_CELLS
        S.MAX_CELLS = 8  # cut in two again and again
        cut, S.MAX_CELLS = S.lcs_pairs(a, b), most
        assert len(cut) == len(whole) == S.lcs_length(a, b) and all(a[i] == b[j] for i, j in cut) and cut == sorted(set(cut))
    assert S.lcs_length("abcbdab", "bdcaba") == 4 and S.lcs_dice([], []) == 0.0
    assert S.common_substring("xABCy", "zabcw") == 3 and S.substring_dice("", "") == 0.0
    assert S.line_changes("a\nb\nc", "a\nx\ny\nc\nd") == (1, 0, 2)
    df = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["b"])], "x array<string>, y array<string>")
    assert [round(r[0], 6) for r in df.select(S.lcs_dice_udf("x", "y")).collect()] == [0.666667, 0.0]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("0x1FL", "1_000", "2.5f", " a \n b ", "k=v=w", "public static int f(String a, final int[] b)")], "h string, n string, d string, s string, kv string, sig string")
    head, tail = C.split_once(F.col("kv"), "=")
    r = df.select(C.strip_number(F.col("h")), C.strip_number(F.col("n")), C.strip_number(F.col("d")), C.without_space(F.col("s")), head, tail, C.signature_struct(F.col("sig"))).first()
    assert tuple(r)[:6] == ("1F", "1000", "2.5", "ab", "k", "v=w")
    assert tuple(r[6]) == ("int", "f", ["String", "int[]"])
    a = spark.createDataFrame([("Yes, it is", "so [Category 1]: x or [Type 2]", "[critical lines]: x = 1 ||| y\n\nrest", "@@Name@@a.b@@12")], "a string, b string, c string, d string")
    r = a.select(C.yes_no(F.col("a")), C.type_class(F.col("b")), C.critical_lines(F.col("c")), C.element_parts(F.col("d"))).first()
    assert tuple(r)[:3] == (True, 1, ["x = 1", "y"]) and tuple(r[3]) == ("Name", "a.b", 12)
    answers = spark.createDataFrame([("[2]: y",), ("[type 3] z",), ("none",)], "a string")
    assert [r[0] for r in answers.select(C.type_class(F.col("a"))).collect()] == [2, 3, None]
    deep = spark.createDataFrame([("Map<K, List<V>> f(Map<String, List<X>> a, int b)",)], "s string").select(C.signature_struct(F.col("s")).alias("s")).first().s
    assert deep.name == "f" and [a.replace(" ", "") for a in deep.args] == ["Map<String,List<X>>", "int"]
    t = spark.createDataFrame([("A", "A"), ("<UNKNOWN>", "B"), ("A", "B")], "x string, y string")
    assert [r[0] for r in t.select(C.type_equal(F.col("x"), F.col("y"))).collect()] == [1.0, 1.0, 0.0]


def test_html_edit_counts_sees_bodies(spark, tmp_path):
    head = "<html><head><title>t</title></head>"
    html = [f"{head}<body><p>a</p></body></html>", f"{head}<body><p>b</p><ul><li>c</li></ul></body></html>", "<p>no head</p>", "<p>other</p>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.case_id: r.asDict() for r in registry.queries()["html_edit_counts"](spark, str(tmp_path)).collect()}
    assert set(got) == {"0", "1", "2"}
    assert (got["0"]["update"], got["0"]["insert"], got["0"]["total_edits"]) == (1, 1, 2)
    assert (got["2"]["update"], got["2"]["total_edits"]) == (1, 1)


@pytest.mark.parametrize("group_pairs", [0, 7, 1 << 18])
def test_greedy_rounds_are_the_sequential_matching(spark, group_pairs):
    import random

    rng = random.Random(3)
    rows = [(g, rng.randint(0, 12), rng.randint(0, 12)) for g in ("a", "b", None) for _ in range(40)] + [("hot", i, j) for i in range(9) for j in range(i, i + 3)]
    rows += [("hot", 3, 3), ("a", None, 1), ("b", 1, None)]
    want = set()
    for g in {r[0] for r in rows}:
        taken = set()
        own = [(left, right) for x, left, right in rows if x == g and left is not None and right is not None]
        for left in sorted({x for x, _ in own}):
            free = min((r for x, r in own if x == left and r not in taken), default=None)
            if free is not None:
                taken.add(free)
                want.add((g, left, free))
    df = spark.createDataFrame(rows, "file string, w long, t long")
    if group_pairs == 1 << 18:
        df = df.where("file IS NOT NULL")  # pandas groups have no null key
        want = {x for x in want if x[0] is not None}
    got = matching.greedy_one_to_one(df.where("file IS NOT NULL") if group_pairs == 7 else df, "file", "w", "t", group_pairs)
    assert {tuple(r) for r in got.collect()} == (want if group_pairs != 7 else {x for x in want if x[0] is not None})


def test_similar_texts_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abA") for _ in range(rng.randint(0, 14)))
    named, elements = [(k % 2, k, word()) for k in range(120)], [(k % 2, k, word()) for k in range(120)]
    a, b = spark.createDataFrame(named, "key int, i int, text string"), spark.createDataFrame(elements, "key int, j int, element string")
    for t in (0.35, 0.6, 0.85, 1.0):
        want = {(i, j): S.substring_dice(x, y) for k, i, x in named for g, j, y in elements if k == g and S.substring_dice(x, y) >= t}
        got = {(r.i, r.j): r.similarity for r in patterns.similar_texts(a, b, t).collect()}
        assert got == want, t


def test_similar_texts_meet_only_where_they_are_similar(spark, monkeypatch):
    names = [f"Customer#{k:09d}" for k in range(0, 3000, 7)] + ["Customer#000000000"] * 3  # one common beginning, and copies
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(names)], "key int, i int, text string")
    want = {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if S.substring_dice(x, y) >= 0.85}
    monkeypatch.setattr(patterns, "substring_dice_udf", lambda a, b: F.lit(1.0))  # whatever meets is a result
    got = patterns.similar_texts(df, df.select("key", F.col("i").alias("j"), F.col("text").alias("element")), 0.85)
    assert {(r.i, r.j) for r in got.collect()} == want


def test_common_substring_of_long_texts():
    a, b = "ab" * 4000 + "the middle" + "c" * 5000, "d" * 3000 + "xTHE MIDDLEc" + "e" * 4000
    assert S.common_substring(a, b) == len("the middlec")


@pytest.mark.parametrize("limit, bins", [(1 << 18, 1024), (5, 4), (0, 3)])
def test_quantiles_by_selection(spark, limit, bins):
    import random

    import numpy as np

    rng = random.Random(6)
    rows = [("a", rng.choice([1.0, 2.0, 2.0, -3.5])) for _ in range(60)] + [("b", rng.gauss(0, 1e6)) for _ in range(77)] + [(None, float(k)) for k in range(10)] + [("one", 4.0), ("same", 5.0), ("same", 5.0)]
    rows += [("b", None), ("b", float("nan")), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), ("wide", 1e-300)]
    got = metrics.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "mid": 0.5, "q3": 0.75, "end": 1.0}, limit, bins)
    out = {r["k"]: tuple(r)[1:] for r in got.collect()}
    for k in {r[0] for r in rows}:
        own = sorted(v for x, v in rows if x == k and v is not None and v == v)
        want = [float(np.quantile(np.array(own, np.longdouble), q)) for q in (0.25, 0.5, 0.75, 1.0)]
        assert np.allclose(out[k], want, rtol=1e-12), (k, out[k], want)


def test_walks_of_any_depth(spark):
    n = 1000
    nodes = spark.createDataFrame([("t", k, k - 1 if k else None) for k in range(n)] + [("u", 0, None), ("u", 1, 0)], "tree_id string, node_id long, parent_id long")
    verdicts = spark.createDataFrame([("t", k, 1 if k % 3 else 2) for k in range(n)] + [("u", 0, 3), ("u", 1, 1)], "tree_id string, node_id long, verdict int")
    want = {("t", k) for k in range(n) if k % 3}
    assert {tuple(r) for r in patterns.walk_verdicts(nodes, verdicts).collect()} == want
    assert {tuple(r) for r in patterns.walk_verdicts(nodes, verdicts, 10).collect()} == {x for x in want if x[1] <= 10}
    ranked = nodes.withColumns({"pre": F.col("node_id"), "depth": F.col("node_id").cast("int"), "post": F.when(F.col("tree_id") == "t", n - 1 - F.col("node_id")).otherwise(1 - F.col("node_id"))})
    assert {tuple(r) for r in patterns.walk_verdicts(ranked, verdicts).collect()} == want
    cut = verdicts.withColumn("verdict", F.when(F.col("node_id") == 500, 0).otherwise(F.col("verdict")))
    for df in (nodes, ranked):
        assert {tuple(r) for r in patterns.walk_verdicts(df, cut).collect()} == {x for x in want if x[1] < 500}


def test_neighbourhood_to_its_end(spark):
    from treeloom.tree.nodes import neighbourhood

    nodes = spark.createDataFrame([("t", k, (k - 1) // 2 if k else None, k + 5 if k == 3 else None) for k in range(15)] + [("t", 99, None, None)], "tree_id string, node_id long, parent_id long, data_dep_id long")
    edges = {(a, b) for k in range(1, 15) for a, b in ((k, (k - 1) // 2), ((k - 1) // 2, k))} | {(3, 8), (8, 3)}
    want, k = {3: 0}, 0
    while any(v == k for v in want.values()):
        want |= {b: k + 1 for a, b in edges if want.get(a) == k and b not in want}
        k += 1
    seeds = spark.createDataFrame([("t", 3)], "tree_id string, node_id long")
    assert {r.node_id: r.hops for r in neighbourhood(nodes, seeds, None).collect()} == want
    for hops in (1, 2, 4):
        assert {r.node_id: r.hops for r in neighbourhood(nodes, seeds, hops).collect()} == {k: v for k, v in want.items() if v <= hops}


def test_line_differences_of_long_texts():
    a = [f"line {k}" for k in range(50_000)]
    b = [x for k, x in enumerate(a) if k % 10] + ["new"] * 7
    assert S.line_totals("\n".join(a), "\n".join(b)) == (7, 5000)
    added, deleted, changed = S.line_changes("\n".join(a), "\n".join(b))
    assert (added, deleted, changed) == (7, 5000, 0)
    assert S.line_changes("a\nb\nc", "a\nx\ny\nc\nd") == (1, 0, 2) and S.line_totals(None, "a\nb") == (2, 0)


def test_copies_of_names_are_scored_once(spark, tmp_path, monkeypatch):
    rows = [(k, ["red ring", "red hot ring"][k % 2], "B", 1) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def spy(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([S.lcs_dice(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(registry, "lcs_dice_udf", spy)
    assert registry.sim_join_lcs(spark, str(tmp_path)).count() == 40 * 39 // 2
    assert scored.value <= 8  # four pairs of names; a plan may ask twice


def test_all_pairs_of_a_small_table_are_dealt_over_all_cores(spark, tmp_path):
    rows = [(k, [None, "red red ring", "red hot ring"][k % 3], "B", 1 + k % 2) for k in range(60)] + [(99, "red", None, 1), (98, "red", None, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = registry.sim_join_hard_soft(spark, str(tmp_path))
    tokens = lambda k: None if k % 3 == 0 else {"red", "ring"} if k % 3 == 1 else {"red", "hot", "ring"}
    want = {(a, b): None if tokens(a) is None or tokens(b) is None else round(2 * len(tokens(a) & tokens(b)) / (len(tokens(a)) + len(tokens(b))), 9) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2}
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.a, r.b): r.score for r in got} == want and len(got) == len(want)
    assert len({r.task for r in got}) > 1  # not all of them by the one task that the table's size asks for
