"""Registered queries of the tree engine: each an operator over the sample tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom import registry_java, registry_reports
from treeloom.dsl import rewrite
from treeloom.dsl.parser import parse
from treeloom.functions import columns as C
from treeloom.functions.sequences import lcs_dice_udf, line_changes_udf, line_totals_udf
from treeloom.operators import matching, metrics, patterns, sampling, sets
from treeloom.plans.compiler import NodePlanner, RelationalPlanner, run
from treeloom.sources.files import parsed
from treeloom.sources.work import dealt, shuffled, written
from treeloom.tree.relational import STAR, RelationalForest

FLAGSHIP = "dsl_contain"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def forest(spark: SparkSession, d: str) -> RelationalForest:
    return RelationalForest({e.table: table(spark, d, e.table) for e in STAR.values()})


def dsl(spark: SparkSession, d: str, text: str) -> DataFrame:
    f = forest(spark, d)
    return run(text, RelationalPlanner(f), f.vocabulary)


# the query language over the star schema


@query("""SELECT c_custkey, c_name FROM customer c WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O'
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R'))""")
def dsl_contain(spark, d):
    q = 'customer c where and(c.mktsegment == "BUILDING", c contain orders o where and(o.orderstatus == "O", not(o contain lineitem l where l.returnflag == "R")));'
    return dsl(spark, d, q).select("c_custkey", "c_name")


@query("""SELECT r_regionkey, r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
  WHERE n.n_regionkey = r.r_regionkey AND o.o_orderpriority = '1-URGENT' AND c.c_acctbal < 0)""")
def dsl_contain_path(spark, d):
    return dsl(spark, d, "region r where r contain customer c where and(c.inDebt, c contain orders o where o.isUrgent);").select("r_regionkey", "r_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND l.l_quantity = 50)")
def dsl_not_contain(spark, d):
    return dsl(spark, d, "customer c where not(c contain lineitem l where l.quantity == 50);").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 AND o_orderstatus = 'F'")
def dsl_in(spark, d):
    return dsl(spark, d, 'orders o where and(o.orderstatus == "F", o in region r where r.regionkey == 1);').select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY') AND o_totalprice IS NOT NULL")
def dsl_not_in(spark, d):
    return dsl(spark, d, 'orders o where o notIn customer c where c.mktsegment == "MACHINERY";').select("o_orderkey")


@query("""SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')
  OR NOT (c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'))""")
def dsl_and_or(spark, d):
    q = 'customer c where or(c.inDebt, c contain orders o where o.isUrgent, not(or(c.mktsegment == "BUILDING", c contain orders p where p.orderstatus == "F")));'
    return dsl(spark, d, q).select("c_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, '.*#[12].') AND p_size <> 10")
def dsl_match(spark, d):
    return dsl(spark, d, 'part p where and(p.brand match ".*#[12].", p.size != 10);').select("p_partkey", "p_brand")


@query("SELECT s_suppkey FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_regionkey <> 0")
def dsl_is(spark, d):
    return dsl(spark, d, "supplier s where and(s is supplier, s in alias_1 where and(alias_1 is region, alias_1.regionkey != 0));").select("s_suppkey")


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'ASIA' AND (c_acctbal < 0 OR o_orderstatus = 'P') AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n_nationkey AND s.s_acctbal > -100000)""")
def dsl_role_path(spark, d):
    """Properties and relations of rows above, by paths of parents."""
    q = 'orders o where and(o.customer.nation.region.name == "ASIA", or(o.customer.inDebt, o.orderstatus == "P"), o.customer.nation contain supplier s where s.acctbal != 1e300);'
    return dsl(spark, d, q.replace("1e300", "123456789")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O'")
def dsl_flag(spark, d):
    return dsl(spark, d, 'orders o where and(o.isUrgent, o.orderstatus != "O");').select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A' AND NOT l_linestatus = 'O')
  AND NOT o_orderpriority = '5-LOW'""")
def dsl_refined(spark, d):
    q = parse('orders o_1 where and(o_1.orderstatus == "O", o_1 contain lineitem l_1 where and(l_1.returnflag == "A", l_1.quantity == 7));')
    text = """Constraint 1:
- Type: edit
- Path: o_1.orderstatus
- Operator: ==
- Value: "F"

Constraint 2:
- Type: del
- Path: l_1.quantity
- Operator: ==

Constraint 3:
- Type: add
- Path: l_1.linestatus
- Operator: ==
- Value: "O"
- Is Negative: true

Constraint 4:
- Type: add
- Path: o_1.orderpriority
- Operator: ==
- Value: "5-LOW"
- Is Negative: yes
"""
    f = forest(spark, d)
    sorted_out = rewrite.classify(rewrite.extract(text), q, f.vocabulary)
    return RelationalPlanner(f).plan(rewrite.merge(q, sorted_out[rewrite.VALID])).select("o_orderkey")


# trees

_TREE_SQL = """WITH t AS (
  SELECT c_custkey::VARCHAR AS tree_id, 'customer' AS node_type, 0 AS depth FROM customer
  UNION ALL SELECT o_custkey::VARCHAR, 'orders', 1 FROM orders
  UNION ALL SELECT o.o_custkey::VARCHAR, 'lineitem', 2 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) """


@query(_TREE_SQL + "SELECT tree_id, count(*) AS nodes, max(depth) AS max_depth FROM t GROUP BY tree_id")
def tree_flatten(spark, d):
    return forest(spark, d).node_table().groupBy("tree_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


@query(_TREE_SQL + "SELECT node_type, depth, count(*) AS n FROM t GROUP BY ALL")
def tree_depth(spark, d):
    return forest(spark, d).node_table().groupBy("node_type", "depth").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
  u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  w AS (SELECT 'n3' AS node, 0 AS hops UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.node WHERE w.hops < 2)
  SELECT node, min(hops) AS hops FROM w GROUP BY node""")
def tree_neighbourhood_k(spark, d):
    from treeloom.tree.nodes import neighbourhood

    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    nodes = n.select(key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id")).unionByName(
        s.select(key("s", "s_suppkey").alias("node_id"), key("n", "s_nationkey").alias("parent_id"))
    )
    nodes = nodes.withColumn("tree_id", F.lit("t"))
    seeds = spark.createDataFrame([("t", "n3")], "tree_id string, node_id string")
    return neighbourhood(nodes, seeds, 2, data_deps=False).select(F.col("node_id").alias("node"), "hops")


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of all pages: files are dealt out first, as parsing outweighs moving them."""
    return parsed(dealt(table(spark, d, "pages").select("page_id", "html"), "page_id"), "html", "page_id", "html")


# pages as SQL sees them: scripts and styles hold one text each, comments part texts
_PAGE_SQL = """WITH h AS (SELECT page_id::VARCHAR AS tree_id, regexp_replace(regexp_replace(html, '(?s)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\\1x\\2', 'g'), '(?s)<!--.*?-->', '<!>', 'g') AS h FROM pages) """


@query(_PAGE_SQL + """SELECT tree_id FROM h WHERE regexp_matches(regexp_extract(h, '(?s)<nav[ >].*?</nav>'), '(?s)<a [^>]*href="/.+"') AND regexp_matches(regexp_extract(h, '(?s)<article[ >].*?</article>'), '<p[ >]')""")
def html_contain(spark, d):
    """Articles with a paragraph, on pages whose navigation links somewhere."""
    wanted = ["tree_id", "node_id", "parent_id", "role", "dsl_type", "depth", "pre", "post", "name", "value", "props", "flags"]
    nodes = written(page_nodes(spark, d).where("parse_error IS NULL").select(wanted), "page-nodes")  # each step of the query reads them again
    q = 'document d where and(d contain nav n where n contain a l where l.href match "/.+", d contain article a where a contain p q);'
    return NodePlanner(nodes).plan(parse(q)).select("tree_id")


@query(_PAGE_SQL + """SELECT tree_id, 1 + len(regexp_extract_all(h, '<[a-zA-Z]')) + len(list_filter(regexp_extract_all(h, '>([^<]*)', 1), lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS nodes,
  len(regexp_extract_all(h, '<p[ >]')) AS paragraphs, len(regexp_extract_all(h, '<a[ >]')) AS links, NULL::VARCHAR AS parse_error FROM h""")
def html_detect(spark, d):
    """Size of every page's tree, its paragraphs and links, from the parsed nodes."""
    nodes = page_nodes(spark, d)
    n = lambda kind: F.count_if(F.col("node_type") == kind)
    return nodes.groupBy("tree_id").agg(F.count("node_id").alias("nodes"), n("p").alias("paragraphs"), n("a").alias("links"), F.max("parse_error").alias("parse_error"))


# metrics

_RULE = "(o_totalprice > 150000)"


@query(f"""WITH r AS (SELECT o_orderpriority AS checker, {_RULE} AS on_buggy, o_orderstatus = 'F' AS on_fixed FROM orders),
  c AS (SELECT checker, count(*) FILTER (on_buggy) AS tp, count(*) FILTER (NOT on_buggy) AS fn, count(*) FILTER (on_fixed) AS fp, count(*) FILTER (NOT on_fixed) AS tn FROM r GROUP BY checker)
  SELECT checker, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy,
  round(2 * tp::DOUBLE / (2 * tp + fp + fn), 9) AS f1, round(fp::DOUBLE / (fp + tn), 9) AS fpr, round(fn::DOUBLE / (fn + tp), 9) AS fnr FROM c""")
def confusion_paired(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("checker"), F.expr(_RULE).alias("on_buggy"), (F.col("o_orderstatus") == "F").alias("on_fixed"))
    out = matching.paired_confusion(o, ["checker"])
    return out.select("checker", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy", "f1", "fpr", "fnr")])


_LABEL_COUNTS = """WITH c AS (SELECT source AS tool, lang AS dataset, (quality = 1 AND toxic = 0)::INT AS tp, (quality = 1 AND toxic = 1)::INT AS fp, (quality = 0 AND toxic = 0)::INT AS fn,
  (quality = 0 AND toxic = 1)::INT AS tn FROM labels JOIN documents USING (doc_id)) """
_RATES = """round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END, 4) AS precision,
  round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END, 4) AS recall,
  round(CASE WHEN count(*) = 0 THEN 0 ELSE (sum(tp) + sum(tn))::DOUBLE / (sum(tp) + sum(fp) + sum(fn) + sum(tn)) END, 4) AS accuracy,
  round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 OR sum(tp) = 0 THEN 0 ELSE 2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)) END, 4) AS f1,
  round(CASE WHEN sum(fp) + sum(tn) = 0 THEN 0 ELSE sum(fp)::DOUBLE / (sum(fp) + sum(tn)) END, 4) AS fpr,
  round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(fn)::DOUBLE / (sum(tp) + sum(fn)) END, 4) AS fnr"""
_RATE_NAMES = ("precision", "recall", "accuracy", "f1", "fpr", "fnr")


def _label_counts(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    n = lambda c, name: c.cast("int").alias(name)
    return j.select(F.col("source").alias("tool"), F.col("lang").alias("dataset"), n(good & ~toxic, "tp"), n(good & toxic, "fp"), n(~good & ~toxic, "fn"), n(~good & toxic, "tn"))


@query(_LABEL_COUNTS + f"SELECT dataset, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, {_RATES} FROM c GROUP BY dataset")
def metrics_micro(spark, d):
    return matching.micro_average(_label_counts(spark, d), ["dataset"]).select("dataset", "tp", "fp", "fn", "tn", *_RATE_NAMES)


@query(_LABEL_COUNTS + f"SELECT tool, dataset, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, {_RATES} FROM c GROUP BY ROLLUP (tool, dataset)")
def metrics_rollup(spark, d):
    return matching.rolled_up(_label_counts(spark, d), "tool", "dataset").select("tool", "dataset", "tp", "fp", *_RATE_NAMES)


@query("""WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
  t AS (SELECT o_custkey AS user_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
  SELECT w.user_id, event_id, o_orderkey FROM w JOIN t ON w.user_id = t.user_id AND w.n = t.n""")
def match_one_to_one(spark, d):
    w = table(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id")
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    return matching.ranked_one_to_one(w, t, ["user_id"], [F.col("event_id")], [F.col("o_orderkey")]).select("user_id", "event_id", "o_orderkey")


_SHIP = "datediff('day', TIMESTAMP '1992-01-01', date_trunc('day', l_shipdate))"
_ORDER = "datediff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate))"


def _days(c):
    return F.datediff(F.col(c), F.lit("1992-01-01"))


def _truths(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("truth_id"), _days("o_orderdate").alias("begin"), (_days("o_orderdate") + 60).alias("end"))


def _warnings(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", _days("l_shipdate").alias("line"))


@query(f"SELECT l_orderkey AS key, l_linenumber, l_partkey, l_suppkey, {_SHIP}::INT AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_SHIP} BETWEEN {_ORDER} - 1 AND {_ORDER} + 61")
def range_match_tol1(spark, d):
    return matching.range_matches(_warnings(spark, d), _truths(spark, d), ["key"], 1).select("key", "l_linenumber", "l_partkey", "l_suppkey", "line")


@query(f"SELECT count(*) AS n, sum({_SHIP})::BIGINT AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_SHIP} BETWEEN {_ORDER} AND {_ORDER} + 60")
def range_match_binned(spark, d):
    return matching.binned_range_matches(_warnings(spark, d), _truths(spark, d), ["key"], 0).agg(F.count("*").alias("n"), F.sum("line").alias("days"))


@query(f"""WITH w AS (SELECT event_id, user_id, day(ts) AS line FROM events), t AS (SELECT o_orderkey, o_custkey, day(o_orderdate) AS b FROM orders),
  p AS (SELECT event_id, arg_min(o_orderkey, (b, o_orderkey)) AS truth_id FROM w JOIN t ON user_id = o_custkey WHERE line BETWEEN b - 1 AND b + 3 GROUP BY event_id)
  SELECT event_id AS warning_id, truth_id FROM w LEFT JOIN p USING (event_id)""")
def match_many_to_one(spark, d):
    w = table(spark, d, "events").select(F.col("event_id").alias("warning_id"), F.col("user_id").alias("file"), F.dayofmonth("ts").alias("line"))
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("truth_id"), F.dayofmonth("o_orderdate").alias("begin"), (F.dayofmonth("o_orderdate") + 2).alias("end"))
    return matching.many_to_one(w, t, ["file"], "warning_id", "truth_id").select("warning_id", "truth_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'P')")
def semi_changed(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p_partkey FROM lineitem l JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber WHERE contains(p_name, 'ring')""")
def equi_match_substring(spark, d):
    """Equal keys, and a name that holds the other's."""
    w = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("params"), F.lit("ring").alias("file"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("params"), F.col("p_name").alias("path"), "p_partkey")
    return matching.equi_matches(w, t, ["name", "params"], ("path", "file")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_partkey")


@query("""WITH w AS (SELECT event_id AS warning_id, user_id AS file, day(ts) AS line FROM events),
  f AS (SELECT c_custkey AS function_id, c_custkey AS file, 5 AS b, 20 AS e FROM customer),
  t AS (SELECT o_orderkey AS truth_id, o_custkey AS file, day(o_orderdate) AS b, day(o_orderdate) + 2 AS e FROM orders),
  s AS (SELECT warning_id, line, w.file, function_id FROM w JOIN f ON w.file = f.file WHERE line BETWEEN b - 1 AND e + 1),
  h AS (SELECT warning_id, arg_min(truth_id, (b, truth_id)) AS truth_id FROM w JOIN t ON w.file = t.file WHERE line BETWEEN b - 1 AND e + 1 GROUP BY warning_id)
  SELECT CASE WHEN truth_id IS NULL THEN 'fp' ELSE 'tp' END AS label, warning_id, truth_id, function_id FROM s LEFT JOIN h USING (warning_id)
  UNION ALL SELECT 'fn', NULL, truth_id, function_id FROM t JOIN f ON t.file = f.file WHERE truth_id NOT IN (SELECT truth_id FROM h) AND f.b - 1 <= t.b AND t.e <= f.e + 1""")
def label_tp_fp_fn(spark, d):
    w = table(spark, d, "events").select(F.col("event_id").alias("warning_id"), F.col("user_id").alias("file"), F.dayofmonth("ts").alias("line"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("truth_id"), F.col("o_custkey").alias("file"), F.dayofmonth("o_orderdate").alias("begin"), (F.dayofmonth("o_orderdate") + 2).alias("end"))
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("function_id"), F.col("c_custkey").alias("file"), F.lit(5).alias("begin"), F.lit(20).alias("end"))
    return matching.labelled(w, t, f, ["file"])


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_merge(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return matching.lookup(c, (table(spark, d, "nation"), ["n_nationkey"]), (r, ["n_regionkey"])).select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT 'docs' AS side, count(*) AS n FROM (SELECT regexp_replace(text, '\\s+', '', 'g') AS k, count(*) AS c FROM documents GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'benchmark', count(*) FROM benchmark b WHERE regexp_replace(text, '\\s+', '', 'g') IN (SELECT regexp_replace(text, '\\s+', '', 'g') FROM documents)""")
def text_equal_nows(spark, d):
    docs = table(spark, d, "documents").select(C.without_space(F.col("text")).alias("k"))
    same = docs.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("docs").alias("side"), "n")
    items = table(spark, d, "benchmark").select(C.without_space(F.col("text")).alias("k")).join(docs, "k", "left_semi")
    return same.unionByName(items.agg(F.count("*").alias("n")).select(F.lit("benchmark").alias("side"), "n"))


@query("""SELECT c_mktsegment, n_nations, total, mean FROM (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1)
  ORDER BY n_nations DESC, total DESC LIMIT 3""")
def group_nunique_topk(spark, d):
    out = metrics.group_nunique(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal")
    out = out.select("c_mktsegment", F.col("n_distinct").alias("n_nations"), F.round("total", 2).alias("total"), "mean")
    return sampling.top_k(out, 3, F.desc("n_nations"), F.desc("total"))


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(median(o_totalprice), 4) AS median, max(o_totalprice) AS max
  FROM orders GROUP BY 1""")
def desc_stats(spark, d):
    out = metrics.describe(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.round("median", 4).alias("median"), "max")


_BIN_SQL = """WITH v AS (SELECT {value} AS v FROM {table}), b(bin, label, lo, hi) AS (VALUES {rows}),
  n AS (SELECT bin, label, count(v) AS n FROM b LEFT JOIN v ON {inside} GROUP BY bin, label)
  SELECT bin, label, n, round(CASE WHEN sum(n) OVER () = 0 THEN 0 ELSE n / sum(n) OVER () END, 9) AS share FROM n"""


@query(_BIN_SQL.format(value="p_size", table="part", rows="(0, '(0, 5]', 0, 5), (1, '(5, 10]', 5, 10), (2, '(10, 20]', 10, 20), (3, '(20, inf)', 20, 1e18)", inside="v > lo AND v <= hi"))
def bins_right(spark, d):
    return metrics.binned(table(spark, d, "part"), "p_size", [0, 5, 10, 20]).withColumn("share", F.round("share", 9))


@query(_BIN_SQL.format(value="l_linenumber", table="lineitem", rows="(0, '[1, 2)', 1, 2), (1, '[2, 4)', 2, 4), (2, '[4, 6)', 4, 6), (3, '[6, 11)', 6, 11), (4, '[11, inf)', 11, 1e18)", inside="v >= lo AND v < hi"))
def bins_left(spark, d):
    return metrics.binned(table(spark, d, "lineitem"), "l_linenumber", [1, 2, 4, 6, 11], right=False).withColumn("share", F.round("share", 9))


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1)
  SELECT p_partkey, p_brand, p_retailprice FROM part JOIN q USING (p_brand) WHERE p_retailprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")
def iqr_filter(spark, d):
    return metrics.without_outliers(table(spark, d, "part"), ["p_brand"], "p_retailprice", 0.5).select("p_partkey", "p_brand", "p_retailprice")


@query("""WITH c AS (SELECT o_orderstatus, o_orderkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT o_orderstatus, round(sum(hits) / sum(total), 9) AS coverage, count(*) AS cases FROM c GROUP BY 1""")
def coverage(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))
    j = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = metrics.coverage(j, ["o_orderstatus"], "hits", "total")
    return out.select("o_orderstatus", F.round("coverage", 9).alias("coverage"), "cases")


@query("""WITH c AS (SELECT o_orderstatus, o_orderkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT o_orderstatus, round(hits / total, 9) AS rate, count(*) AS cases FROM c GROUP BY 1, 2""")
def coverage_rates(spark, d):
    """How many orders of a status have each share of returned lines."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))
    j = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return metrics.coverage_rates(j, ["o_orderstatus"], "hits", "total").withColumn("rate", F.round("rate", 9))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents), f AS (SELECT token, count(*) AS cnt FROM t WHERE token <> '' GROUP BY 1)
  SELECT token, cnt, cnt / (SELECT count(*) FROM documents) < 0.005 AS considered FROM f""")
def doc_freq_rare(spark, d):
    """In how many documents each token occurs, and whether that is rare."""
    docs = table(spark, d, "documents")
    return metrics.document_frequency(docs, "doc_id", "text").withColumn("considered", patterns.is_rare(F.col("cnt"), docs.count()))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(2.0 * len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / (len(list_distinct(string_split(a.p_name, ' '))) + len(list_distinct(string_split(b.p_name, ' ')))), 9) AS score
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def sim_join_hard_soft(spark, d):
    """All pairs of parts of a brand and size, whatever their score: a pair of names is scored once a group, and small tables that make many pairs are dealt over all cores."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.struct("p_name").alias("x"))  # structs of nulls are equal, too
    names = p.select("p_brand", "p_size", "x").distinct()
    t, u = (F.array_distinct(F.split(F.col(c)["p_name"], " ")) for c in "xy")
    score = F.round(2.0 * F.size(F.array_intersect(t, u)) / (F.size(t) + F.size(u)), 9).alias("score")
    alike = names.join(names.withColumnRenamed("x", "y"), ["p_brand", "p_size"]).select("p_brand", "p_size", "x", "y", score)
    left = dealt(p.join(shuffled(alike), ["p_brand", "p_size", "x"]), "p_brand", "p_size", "y")
    b = dealt(p.select(F.col("a").alias("b"), "p_brand", "p_size", F.col("x").alias("y")), "p_brand", "p_size", "y")
    return left.join(shuffled(b), ["p_brand", "p_size", "y"]).where("a < b").select("a", "b", "score")


@query("""WITH t AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS t FROM part),
  s AS (SELECT *, list_transform(range(1, (1 << len(t))::INT), lambda m: list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1)) AS subs FROM t),
  j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 2.0 * coalesce(list_max(list_transform(list_intersect(a.subs, b.subs), lambda x: len(x))), 0) / (len(a.t) + len(b.t)) AS score
    FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
  SELECT a, b, round(score::DOUBLE, 9) AS score FROM j WHERE score > 0.2""")
def sim_join_lcs(spark, d):
    """Parts of a brand and size whose name tokens are alike in order."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.col("p_name").alias("x"))
    names = p.select("p_brand", "p_size", "x").distinct()
    met = names.join(names.withColumnRenamed("x", "y"), ["p_brand", "p_size"])
    # a pair of names is scored once, however many parts and groups have it
    scored = written(met.select("x", "y").distinct().withColumn("score", lcs_dice_udf(F.split("x", " "), F.split("y", " "))).where(F.col("score") > patterns.SCORE_THRESHOLD), "alike-names")
    alike = written(met.join(shuffled(scored), ["x", "y"]), "alike-names")
    b = p.select(F.col("a").alias("b"), "p_brand", "p_size", F.col("x").alias("y"))
    pairs = p.join(shuffled(alike), ["p_brand", "p_size", "x"]).join(shuffled(b), ["p_brand", "p_size", "y"]).where("a < b")
    return pairs.select("a", "b", F.round("score", 9).alias("score"))


@query("""WITH p AS (SELECT c_custkey, s_suppkey, lower(c_name) AS c, lower(s_name) AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey),
  m AS (SELECT c_custkey, s_suppkey, any_value(c) AS c, any_value(s) AS s, max(CASE WHEN contains(c, substr(s, i, n)) THEN n ELSE 0 END) AS l
    FROM p, range(1, 41) a(i), range(1, 41) b(n) WHERE i + n - 1 <= length(s) GROUP BY 1, 2)
  SELECT c_custkey, s_suppkey, round((2.0 * l / (length(c) + length(s)))::DOUBLE, 9) AS similarity FROM m WHERE 2.0 * l / (length(c) + length(s)) >= 0.6""")
def lcs_substring_match(spark, d):
    """Customers and suppliers of a nation whose names share a long substring."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey", F.col("c_name").alias("text"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", F.col("s_name").alias("element"))
    return patterns.similar_elements(c, s, 0.6).select("c_custkey", "s_suppkey", F.round("similarity", 9).alias("similarity"))


@query("""WITH p AS (SELECT a.c_custkey AS a, b.c_custkey AS b, lower(a.c_name) AS x, lower(b.c_name) AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey),
  m AS (SELECT a, b, any_value(x) AS x, any_value(y) AS y, max(CASE WHEN contains(x, substr(y, i, n)) THEN n ELSE 0 END) AS l
    FROM p, range(1, 41) s(i), range(1, 41) t(n) WHERE i + n - 1 <= length(y) AND 2 * n >= 0.85 * (length(x) + length(y)) GROUP BY 1, 2)
  SELECT a, b, round((2.0 * l / (length(x) + length(y)))::DOUBLE, 9) AS similarity FROM m WHERE 2.0 * l / (length(x) + length(y)) >= 0.85""")
def similar_names(spark, d):
    """Customers of a nation whose names share a substring of the asked length: met by blocks and grams, not by all pairs."""
    c = table(spark, d, "customer")
    text = c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("a"), F.col("c_name").alias("text"))
    element = c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("b"), F.col("c_name").alias("element"))
    return patterns.similar_elements(text, element, 0.85).where("a < b").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query()
def line_diff_counts(spark, d):
    """Added, deleted and changed lines between turns of a conversation."""
    t = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # turns with one number have an order, too
    pairs = t.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).where("before IS NOT NULL")
    return pairs.withColumn("x", line_changes_udf(F.col("before"), F.col("after"))).select("conv_id", "turn", "x.added", "x.deleted", "x.changed")


# a row of common lengths with each beginning of b after each line of a: the running maximum of what the line before has and its match adds
_LCS_SQL = """list_reduce(range(1, len(a) + 1), lambda row, i: list_reduce(range(1, len(b) + 1), lambda out, j: list_append(out,
  greatest(out[-1], row[j + 1], row[j] + CASE WHEN a[i] = b[j] THEN 1 ELSE 0 END)), [0]), list_transform(range(0, len(b) + 1), lambda j: 0))[-1]"""


@query(f"""WITH t AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, text AS after FROM conversations),
  l AS (SELECT conv_id, turn, CASE WHEN before = '' THEN [] ELSE string_split(regexp_replace(before, '\n$', ''), chr(10)) END AS a,
    CASE WHEN after = '' THEN [] ELSE string_split(regexp_replace(after, '\n$', ''), chr(10)) END AS b FROM t WHERE before IS NOT NULL),
  n AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {_LCS_SQL} END AS same FROM l)
  SELECT conv_id, turn, (nb - same)::BIGINT AS added, (na - same)::BIGINT AS deleted FROM n""")
def line_diff_totals(spark, d):
    """Lines of each turn that aren't in a longest common sequence with those of the turn before, and the other way round."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).where("before IS NOT NULL")
    return pairs.withColumn("x", line_totals_udf("before", "after")).select("conv_id", "turn", "x.added", "x.deleted")


@query()
def html_edit_counts(spark, d):
    """Edit operations between each page and the next one, over their whole html; whole subtrees as one edit."""
    from treeloom.operators.treediff import edit_counts, edit_scripts
    from treeloom.tree.html import parse_html

    p = table(spark, d, "pages").select("page_id", F.col("html").alias("before"))
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("before").alias("after"))
    pairs = p.join(nxt, "page_id").select(F.col("page_id").cast("string").alias("case_id"), "before", "after")
    return edit_counts(edit_scripts(pairs, parse_html, whole=True, columns=("case_id", "kind")))


@query("""SELECT conv_id, turn, string_agg(role || ': ' || length(text), '|' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS history
  FROM (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn, role, text)""")
def history_upto_step(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    out = sets.upto_step(t, "conv_id", "turn", F.concat("role", F.lit(": "), F.length("text")))
    return out.select("conv_id", "turn", F.array_join("history", "|").alias("history"))


@query("""SELECT conv_id, sum(n)::BIGINT AS tokens, round(sum(n * CASE WHEN role = 'assistant' THEN 10.0 ELSE 2.5 END) / 1e6, 12) AS cost
  FROM (SELECT conv_id, role, length(coalesce(text, '')) AS n FROM conversations) GROUP BY 1""")
def token_cost(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "role", F.lit("m").alias("model"), F.length(F.coalesce("text", F.lit(""))).alias("tokens"))
    prices = spark.createDataFrame([("m", 2.5, 10.0)], "model string, input_price double, output_price double")
    return metrics.token_cost(t, prices, ["conv_id"]).withColumn("cost", F.round("cost", 12))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '#42'), c_custkey) = 1")
def sample_one_per_group(spark, d):
    return sampling.one_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '#42'), o_orderkey LIMIT 25")
def sample_k(spark, d):
    return sampling.sample_k(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 25)


@query("""SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '#42'), c_custkey) <= floor(count(*) OVER (PARTITION BY c_nationkey) * 0.1)""")
def sample_share(spark, d):
    return sampling.share_of_rows(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 0.1)


@query("SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT l_returnflag, measure, round(sum(v), 2) AS total FROM (SELECT l_returnflag, unnest(['quantity', 'discount', 'tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1, 2""")
def melt(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_returnflag"], ["quantity", "discount", "tax"], "measure", "v").groupBy("l_returnflag", "measure").agg(F.round(F.sum("v"), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') GROUP BY 1")
def skip_done(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.remaining(table(spark, d, "customer"), done, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, bool_and(o_orderstatus IN ('O', 'F')) AS all_there FROM orders GROUP BY 1")
def contains_all(spark, d):
    wanted = spark.createDataFrame([("O",), ("F",)], "o_orderstatus string")
    return sets.contains_all(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), wanted, "o_custkey", "o_orderstatus")


@query("SELECT p_type, p_size FROM part GROUP BY 1, 2 HAVING count(*) <= 2")
def few_or_none(spark, d):
    return sampling.few_or_none(table(spark, d, "part"), ["p_type", "p_size"], 2).select("p_type", "p_size").distinct()


@query("""SELECT CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'other' END AS status, count(*) AS n
  FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k GROUP BY 1""")
def key_alignment(spark, d):
    o = table(spark, d, "orders")
    n = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("v"))
    return matching.aligned(n("O"), n("F"), "o_custkey", "v")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def scan_aggregate(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, count(*) FILTER (l_quantity BETWEEN 10 AND 20) > 0 AS any_mid, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def exists_first(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_quantity").between(10, 20)).alias("any_mid"), F.min("l_linenumber").alias("first_line"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey")


@query("SELECT p_partkey, split_part(p_brand, '#', 1) AS head, nullif(split_part(p_brand, '#', 2), '') AS tail, p_size * 1.0 / nullif(p_size - 10, 0) AS ratio FROM part WHERE p_size <> 10")
def scalar_strings(spark, d):
    head, tail = C.split_once(F.col("p_brand"), "#")
    return table(spark, d, "part").where("p_size <> 10").select("p_partkey", head.alias("head"), tail.alias("tail"), (F.col("p_size") * 1.0 / (F.col("p_size") - 10)).cast("double").alias("ratio"))


# queries of each kind, by the customer's key k, and what is found in them
_QUERY_TEXTS = (
    'functionDeclaration f where f.name == "C{k}";', "binaryOperation b_{k} where b_{k}.operator is instanceof;", 'noSuchType{k} n where n.name == "x";',
    'ifBlock i where j{k}.condition contain literal l where l.value == "1";', "ifBlock i{k} where and(i{k}.condition);;", 'ifBlock i where i.noSuch{k} == "x";',
    'ifBlock i{k} where i{k} contain ifBlock i{k} where i{k}.name == "x";', "functionDeclaration f{k} where f{k}.condition contain literal l;",
)
_FINDINGS_SQL = """SELECT c_custkey AS query_id, valid, kind, replace(message, '{k}', c_custkey::VARCHAR) AS message, replace(suggestion, '{k}', c_custkey::VARCHAR) AS suggestion
  FROM customer JOIN (VALUES (0, true, '', '', ''),
    (1, false, 'unsupported_property_path', 'unsupported property ''operator'' of binaryOperation', 'ask for the node''s type, or for what it contains'),
    (1, false, 'invalid_value_for_property', 'instanceof is no value of ''operator''; ask whether b_{k} is instanceofExpression', 'ask whether b_{k} is instanceofExpression'),
    (2, false, 'invalid_node_type', 'invalid node type ''noSuchType{k}''', 'use one of the vocabulary''s node types'),
    (3, false, 'missing_alias', 'alias ''j{k}'' is not defined', 'bind the alias in a query around the condition'),
    (4, false, 'syntax', 'expected '','', found '')''', 'see the grammar'),
    (5, false, 'invalid_property', 'unknown property ''noSuch{k}''', 'use one of the vocabulary''s properties'),
    (6, false, 'duplicate_alias', 'alias ''i{k}'' is bound twice', 'number the aliases'),
    (7, true, 'invalid_property', 'functionDeclaration usually has no ''condition''', 'use condition')) t(n, valid, kind, message, suggestion) ON n = c_custkey % 8"""


def _query_texts(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, _QUERY_TEXTS)), (key % len(_QUERY_TEXTS)).cast("int") + 1)
    return c.select(key.alias("query_id"), F.replace(text, F.lit("{k}"), key.cast("string")).alias("text"))


@query(_FINDINGS_SQL)
def dsl_validation(spark, d):
    """Findings on queries that are written from a table's keys."""
    from treeloom.dsl.analyzer import findings
    from treeloom.dsl.vocabulary import JAVA_STRICT

    return findings(_query_texts(spark, d), JAVA_STRICT)


@query("SELECT c_nationkey AS author, count(*) FILTER (c_custkey % 8 <> 4) / count(*) AS rate FROM customer GROUP BY 1")
def dsl_validity_rate(spark, d):
    """The share of each author's queries that the grammar accepts."""
    from treeloom.dsl.analyzer import findings
    from treeloom.dsl.vocabulary import JAVA_STRICT

    found = findings(_query_texts(spark, d), JAVA_STRICT).groupBy("query_id").agg(F.bool_and(F.col("kind") != "syntax").alias("parsed"))
    authors = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("author"))
    return authors.join(found, "query_id").groupBy("author").agg((F.count_if("parsed") / F.count("*")).alias("rate"))


@query("""WITH w AS (SELECT event_id AS warning_id, CASE WHEN user_id % 3 = 0 THEN 'main/' ELSE 'src/' END || user_id AS file, day(ts) AS line, event_type AS function FROM events),
  t AS (SELECT o_orderkey AS truth_id, CASE WHEN o_custkey % 3 = 0 THEN 'main/' ELSE 'src/' END || o_custkey AS file, day(o_orderdate) AS b, CASE o_orderstatus WHEN 'O' THEN 'click' WHEN 'F' THEN 'view' ELSE 'error' END AS function FROM orders)
  SELECT warning_id, truth_id FROM w JOIN t ON w.file = t.file AND w.function = t.function WHERE line BETWEEN b - 1 AND b + 3""")
def range_match_renamed(spark, d):
    """Warnings and truths by file, function and lines, where a third of the files have been renamed since the warning and all lines are texts."""
    text = lambda c: c.cast("string")
    user = F.col("user_id")
    w = table(spark, d, "events").select(F.col("event_id").alias("warning_id"), F.concat(F.lit("src/"), user).alias("file"), text(F.dayofmonth("ts")).alias("line"), F.col("event_type").alias("function"))
    path = F.concat(F.when(F.col("o_custkey") % 3 == 0, "main/").otherwise("src/"), "o_custkey")
    name = F.when(F.col("o_orderstatus") == "O", "click").when(F.col("o_orderstatus") == "F", "view").otherwise("error")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("truth_id"), path.alias("file"), text(F.dayofmonth("o_orderdate")).alias("begin"), text(F.dayofmonth("o_orderdate") + 2).alias("end"), name.alias("function"))
    renames = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("src/"), "c_custkey").alias("old"), F.concat(F.lit("main/"), "c_custkey").alias("new"))
    return matching.renamed_range_matches(w, t, renames).select("warning_id", "truth_id")


# recorded answers of each kind, by the customer's key k
_ANSWERS = (
    'It should ask for the call, too:\n```dsl\nfunctionDeclaration f where and(f.name == "C{k}", f contain functionCall c);\n```\nas the report shows.',
    'functionDeclaration g where g.name == "D{k}"; is narrower.', '```\nnoSuchType{k} n where n.name == "x";\n```', "The query is right as it is.",
    '```\nfunctionDeclaration f where and(f.name == "C{k}");;\n```',
)


@query("""SELECT c_custkey AS query_id, status, replace(refined, '{k}', c_custkey::VARCHAR) AS refined, replace(message, '{k}', c_custkey::VARCHAR) AS message FROM customer JOIN (VALUES
  (0, 'refined', 'functionDeclaration f where and( f.name == "C{k}", f contain functionCall c );', ''), (1, 'refined', 'functionDeclaration g where g.name == "D{k}";', ''),
  (2, 'invalid', 'functionDeclaration f where f.name == "C{k}";', 'invalid node type ''noSuchType{k}'''), (3, 'unchanged', 'functionDeclaration f where f.name == "C{k}";', 'the answer has no query'),
  (4, 'invalid', 'functionDeclaration f where f.name == "C{k}";', 'expected '','', found '')''')) t(n, status, refined, message) ON n = c_custkey % 5""")
def dsl_one_shot(spark, d):
    """Queries refined in one go by recorded answers; what neither grammar nor vocabulary accepts changes nothing."""
    from treeloom.dsl.oneshot import refined_once
    from treeloom.dsl.vocabulary import JAVA_STRICT

    key = F.col("c_custkey")
    fill = lambda c: F.replace(c, F.lit("{k}"), key.cast("string"))
    answer = F.element_at(F.array(*map(F.lit, _ANSWERS)), (key % len(_ANSWERS)).cast("int") + 1)
    rows = table(spark, d, "customer").select(key.alias("query_id"), fill(F.lit(_QUERY_TEXTS[0])).alias("query"), fill(answer).alias("answer"))
    return refined_once(rows, JAVA_STRICT)


@query("""WITH w AS (SELECT event_id, user_id, event_type, day(ts) AS line FROM events)
  SELECT event_id AS warning_id FROM w JOIN customer ON user_id = c_custkey WHERE line BETWEEN 4 AND 16 AND event_type = CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END""")
def changed_functions(spark, d):
    """Warnings within a changed function of theirs: by file, lines and the function's name in the signature."""
    w = table(spark, d, "events").select(F.col("event_id").alias("warning_id"), F.col("user_id").alias("file"), F.dayofmonth("ts").alias("line"), F.col("event_type").alias("function"))
    name = F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("view")
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.lit(5).alias("begin"), F.lit(15).alias("end"), F.concat(F.lit("void "), name, F.lit("(int x)")).alias("signature"))
    return matching.changed_only(w, f, ["file"]).select("warning_id")


@query("""WITH u AS (SELECT event_id, user_id, day(ts) AS place FROM events), f AS (SELECT o_orderkey, o_custkey, day(o_orderdate) AS a, day(o_orderdate) + o_orderkey % 5 AS b FROM orders),
  p AS (SELECT event_id, arg_min(o_orderkey, (b - a, a, o_orderkey)) AS def_id FROM u JOIN f ON user_id = o_custkey WHERE a <= place AND b >= place GROUP BY event_id)
  SELECT event_id AS use_id, def_id FROM u LEFT JOIN p USING (event_id)""")
def scope_lookup(spark, d):
    """Uses with the innermost scope that holds them: an interval join on equal keys."""
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    uses = e.select(F.col("user_id").alias("tree_id"), F.lit("x").alias("name"), F.col("event_id").alias("use_id"), F.dayofmonth("ts").alias("start"), F.dayofmonth("ts").alias("end"))
    first = F.dayofmonth("o_orderdate")
    defs = o.select(F.col("o_custkey").alias("tree_id"), F.lit("x").alias("name"), F.col("o_orderkey").alias("def_id"), first.alias("scope_start"), (first + F.col("o_orderkey") % 5).alias("scope_end"), F.lit(False).alias("is_global"))
    return patterns.identifier_definitions(uses, defs).select("use_id", "def_id")


@query("""WITH r AS (SELECT r_regionkey AS k, r_regionkey % 3 AS v FROM region), n AS (SELECT n_nationkey AS k, n_regionkey AS p, n_nationkey % 3 AS v FROM nation)
  SELECT 'r' || k AS node_id FROM r WHERE v = 1 UNION ALL SELECT 'n' || n.k FROM n JOIN r ON n.p = r.k WHERE r.v IN (1, 2) AND n.v = 1""")
def verdict_walk(spark, d):
    """A top-down walk that prunes by verdicts: 1 keeps and descends, 2 descends, anything else prunes."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    one = F.lit("t").alias("tree_id")
    nodes = r.select(one, key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), (F.col("r_regionkey") % 3).alias("verdict"))
    nodes = nodes.unionByName(n.select(one, key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 3).alias("verdict")))
    return patterns.walk_verdicts(nodes.drop("verdict"), nodes.select("tree_id", "node_id", "verdict")).select("node_id")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return sets.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT a.n_regionkey, a.n_nationkey AS rule_case, b.n_nationkey AS scanned_case FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def cross_cases(spark, d):
    return sets.cross_cases(table(spark, d, "nation"), "n_regionkey", "n_nationkey")


@query("""SELECT min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, count(*) FILTER (n < m) AS better, count(*) FILTER (n > m) AS worse
  FROM (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O') AS n, count(*) FILTER (o_orderstatus = 'F') AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def scan_summary(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    return metrics.scan_summary(o).withColumn("mean", F.round("mean", 9))


@query("""SELECT count(*) AS total, count(*) FILTER (f) AS detected, round(count(*) FILTER (f) / count(*), 9) AS rate, round(avg(n) FILTER (f), 9) AS mean_results, round(avg(s) FILTER (f), 6) AS mean_seconds
  FROM (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS s, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)""")
def detection_summary(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("detected"), F.count("*").alias("n_results"), F.max("l_quantity").alias("seconds"))
    out = metrics.detection_summary(li)
    return out.select("total", "detected", F.round("rate", 9).alias("rate"), F.round("mean_results", 9).alias("mean_results"), F.round("mean_seconds", 6).alias("mean_seconds"))


@query("""SELECT count(*) AS total, count(*) FILTER (a) AS adapted, count(*) FILTER (c) AS success, count(*) FILTER (NOT c) AS failed
  FROM (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS a, bool_or(o_totalprice > 250000) AS c FROM orders GROUP BY 1)""")
def repair_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), (F.col("o_orderstatus") == "F").alias("adapted"), (F.col("o_totalprice") > 250000).alias("correct"))
    return metrics.repair_summary(o)


@query("SELECT r_name, n_name, count(DISTINCT c_custkey) AS cases FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def level_counts(spark, d):
    f = forest(spark, d).tables
    j = f["customer"].join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(f["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return metrics.level_counts(j, ["r_name", "n_name"], "c_custkey")


@query("SELECT o_custkey AS tree_id, o_orderpriority AS name, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS uses FROM orders GROUP BY 1, 2")
def use_index(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("tree_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("use_id"))
    return patterns.use_index(o).select("tree_id", "name", F.array_join(F.col("uses").cast("array<string>"), ",").alias("uses"))


_GREEDY_SQL = """WITH RECURSIVE w AS (SELECT event_id AS warning_id, user_id AS file, day(ts) AS line FROM events WHERE event_type = 'click'),
  t AS (SELECT o_custkey AS file, o_orderkey AS truth_id, day(o_orderdate) AS b FROM orders),
  p AS (SELECT w.file, warning_id, list_sort(list(truth_id)) AS options FROM w JOIN t ON w.file = t.file WHERE line BETWEEN b - 1 AND b + 6 GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY warning_id) AS n FROM p),
  g AS (SELECT file, 0::BIGINT AS n, NULL::BIGINT AS warning_id, NULL::BIGINT AS truth_id, []::BIGINT[] AS taken FROM (SELECT DISTINCT file FROM n)
    UNION ALL SELECT n.file, n.n, n.warning_id, list_filter(options, lambda x: NOT list_contains(taken, x))[1],
      CASE WHEN list_filter(options, lambda x: NOT list_contains(taken, x))[1] IS NULL THEN taken ELSE list_append(taken, list_filter(options, lambda x: NOT list_contains(taken, x))[1]) END
    FROM g JOIN n ON n.file = g.file AND n.n = g.n + 1)"""


def _clicks_and_orders(spark, d):
    w = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("warning_id"), F.col("user_id").alias("file"), F.dayofmonth("ts").alias("line"))
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("truth_id"), F.dayofmonth("o_orderdate").alias("begin"), (F.dayofmonth("o_orderdate") + 5).alias("end"))
    return w, t


@query(_GREEDY_SQL + " SELECT file, warning_id, truth_id FROM g WHERE truth_id IS NOT NULL")
def greedy_matching(spark, d):
    """Clicks matched one to one with orders of a user within a window of days; each order is taken once."""
    w, t = _clicks_and_orders(spark, d)
    return matching.greedy_one_to_one(matching.range_matches(w, t, ["file"], 1), "file", "warning_id", "truth_id")


_N_SQL = "(SELECT {0} AS file, count(*) AS n FROM {1} GROUP BY 1)"


@query(_GREEDY_SQL + f""",
  m AS (SELECT coalesce(w.file, t.file) AS file, coalesce(w.n, 0) AS n_w, coalesce(t.n, 0) AS n_t, coalesce(x.n, 0) AS tp, coalesce(c.n, 0) AS n_c
    FROM {_N_SQL.format("user_id", "events WHERE event_type = 'click'")} w FULL JOIN {_N_SQL.format("o_custkey", "orders")} t ON w.file = t.file
    LEFT JOIN (SELECT file, count(*) AS n FROM g WHERE truth_id IS NOT NULL GROUP BY 1) x ON x.file = coalesce(w.file, t.file)
    LEFT JOIN {_N_SQL.format("o_custkey", "orders JOIN lineitem ON l_orderkey = o_orderkey")} c ON c.file = coalesce(w.file, t.file)),
  r AS (SELECT file, tp, n_w - tp AS fp, n_t - tp AS fn, greatest(n_c - tp - (n_w - tp) - (n_t - tp), 0) AS tn FROM m)
  SELECT file, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
    round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 9) AS accuracy FROM r""")
def greedy_metrics(spark, d):
    """What the greedy matching finds by user, with as many true negatives as ordered lines leave."""
    w, t = _clicks_and_orders(spark, d)
    matched = matching.greedy_one_to_one(matching.range_matches(w, t, ["file"], 1), "file", "warning_id", "truth_id")
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file")), F.col("l_orderkey") == F.col("o_orderkey")).select("file")
    out = matching.one_to_one_metrics(w, t, matched, "file", lines)
    return out.select("file", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy")])


@query(_PAGE_SQL + "SELECT 'p' AS pattern_id, tree_id FROM h WHERE regexp_matches(h, '(?s)<footer[^>]*>[^<]*[^<[:space:]]')")
def html_pattern_detect(spark, d):
    """Pages that a pattern (a footer with a text, in one tree) matches: candidates, assignment search, detection."""
    wanted = ["tree_id", "node_id", "parent_id", "node_type", "name", "expr_type", "tokens"]
    nodes = written(page_nodes(spark, d).select(wanted), "page-nodes")
    on = lambda *names: F.create_map(*[x for n in ("location", "name", "exprType", "type", "token") for x in (F.lit(n), F.lit(n in names))])
    rows = [("p", 0, None, "footer", "footer", "footer"), ("p", 1, 0, "text", None, "text")]
    made = spark.createDataFrame(rows, "pattern_id string, node_id long, parent_id long, node_type string, name string, _t string").drop("_t")
    made = made.withColumn("expr_type", F.lit(None).cast("string")).withColumn("tokens", F.array().cast("array<string>")).withColumn("considered_attrs", on("type", "name"))
    few = nodes.where(F.col("node_type").isin("footer", "text"))
    inside = few.where(F.col("node_type") == "footer").select("tree_id", F.col("node_id").alias("parent_id"))
    few = few.join(inside, ["tree_id", "parent_id"], "left_semi").unionByName(few.where(F.col("node_type") == "footer"))
    pairs = patterns.candidates(made.withColumn("parent_id", F.lit(0).cast("long")), few)
    return patterns.detect(patterns.match_instances(pairs, made))


def queries() -> dict[str, Query]:
    return _QUERIES | registry_java.QUERIES | registry_reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | registry_java.SQL | registry_reports.SQL
