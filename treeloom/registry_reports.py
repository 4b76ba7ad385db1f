"""Registered queries over files: reports, warnings, JSON and CSV written from tables' columns and read back, so that SQL over the columns says what the sources give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import registry_java
from treeloom.operators import metrics
from treeloom.sources import files, sinks
from treeloom.sources.work import dealt, work_path

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reports(spark: SparkSession, d: str) -> str:
    """A folder of engine reports, one for each nation and segment, with an error for each customer; those of every fifth nation are cut off."""
    c = table(spark, d, "customer")
    info = F.concat(
        F.lit("<error><defectInfo><function><![CDATA["), "c_name", F.lit("(List<int> & b)]]></function><fileName>src/"), "c_mktsegment", F.lit(".java</fileName><reportLine>"),
        F.col("c_custkey").cast("string"), F.lit("</reportLine></defectInfo></error>\n"),
    )
    name = F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")
    made = c.groupBy(name.alias("report"), "c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(info)), "").alias("errors"))
    end = F.when(F.col("c_nationkey") % 5 == 1, "<error><defectInfo><function>x").otherwise("</errors>")
    path = work_path(spark, "reports")
    made.select("report", F.concat(F.lit("<errors>\n"), "errors", end).alias("value")).write.partitionBy("report").text(path)
    return path


def _report() -> Column:
    return F.regexp_extract("report", "report=([^/]+)/", 1).alias("report")


@query("""SELECT c_nationkey || '-' || c_mktsegment AS report, c_name || '(List<int> & b)' AS function, 'src/' || c_mktsegment || '.java' AS "fileName", c_custkey::INT AS "reportLine"
  FROM customer WHERE c_nationkey % 5 <> 1""")
def report_errors(spark, d):
    """The errors of all reports that are whole."""
    found = files.report_errors(spark, _reports(spark, d) + "/report=*")
    return found.select(_report(), "function", "fileName", "reportLine")


@query("""SELECT c_nationkey || '-' || c_mktsegment AS report, CASE WHEN any_value(c_nationkey) % 5 = 1 THEN 0 ELSE count(*) END AS n, any_value(c_nationkey) % 5 <> 1 AS has_error FROM customer GROUP BY 1""")
def report_counts(spark, d):
    """Errors by report, and which reports have any; a broken one has none."""
    path = _reports(spark, d)
    out = files.report_counts(files.report_errors(spark, path + "/report=*"), ["report"], files.report_files(spark, path, "*.txt"))
    return out.select(_report(), "n", "has_error")


@query("SELECT user_id::VARCHAR AS user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1")
def sectioned_report(spark, d):
    """A report with a section for each user, written by many tasks and read back by as many as its splits."""
    e = table(spark, d, "events").select("user_id", "event_id")
    lines = e.select("user_id", F.lit(1).alias("kind"), "event_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("value"))
    heads = e.select("user_id").distinct().select("user_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event_id"), F.concat(F.lit("hash#"), F.col("user_id").cast("string")).alias("value"))
    path = work_path(spark, "sections")
    lines.unionByName(heads).repartition("user_id").sortWithinPartitions("user_id", "kind", "event_id").select("value").write.text(path)
    event = F.regexp_extract("line", r"^event (\d+)$", 1).try_cast("long")
    found = files.sectioned(spark, path).groupBy("file", "section").agg(
        F.max(F.regexp_extract("line", "^hash#(.*)$", 1)).alias("user_id"), F.count(event).alias("n"), F.min(event).alias("first_event"), F.max(event).alias("last_event")
    )
    return found.select("user_id", "n", "first_event", "last_event")


@query("""SELECT 'src/' || l_partkey || '.java' AS file, 'int f(' || l_suppkey || ', String#s)' AS signature, l_linenumber::INT AS "begin", (l_linenumber + l_quantity)::INT AS "end" FROM lineitem""")
def tabbed_results(spark, d):
    """Matcher results in tab-separated files, and one that found nothing."""
    li = table(spark, d, "lineitem")
    end = (F.col("l_linenumber") + F.col("l_quantity")).cast("int").cast("string")
    line = F.concat_ws("\t", F.lit("x"), F.concat(F.lit("src/"), "l_partkey", F.lit(".java")), F.concat(F.lit("int f("), "l_suppkey", F.lit(", String#s)")), F.concat_ws("#", F.col("l_linenumber").cast("string"), end))
    path = work_path(spark, "tabbed")
    li.select(line.alias("value")).write.text(path)
    spark.range(1).select(F.lit("Empty Pattern").alias("value")).write.mode("append").text(path)
    return files.tabbed_results(spark, path)


@query("""SELECT md5(o_orderkey::VARCHAR) AS hash, 'src/' || o_custkey || '.java' AS file, o_orderkey::INT AS "begin", (o_orderkey + 5)::INT AS "end", 'int f(A#' || o_orderstatus || ')' AS signature FROM orders""")
def baseline_warnings(spark, d):
    """Warnings as hash#file#begin#end#signature lines; the signature may hold the mark, other lines are passed over."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    line = F.concat_ws("#", F.md5(key.cast("string")), F.concat(F.lit("src/"), "o_custkey", F.lit(".java")), key.cast("string"), (key + 5).cast("string"), F.concat(F.lit("int f(A#"), "o_orderstatus", F.lit(")")))
    path = work_path(spark, "warnings")
    o.select(F.explode(F.array(line, F.lit("broken#line"))).alias("value")).write.text(path)
    return files.baseline_warnings(spark, path)


_LABEL = "CASE WHEN quality = 1 THEN 'tp' WHEN toxic = 1 THEN 'fp' ELSE 'fn' END"


@query(f"""SELECT lang AS checker, source AS "group", doc_id::VARCHAR AS "case", 'D' || doc_id || '.java' AS file, {_LABEL} AS label FROM labels JOIN documents USING (doc_id)
  WHERE {_LABEL} = 'tp' AND contains(lower('D' || doc_id || '.java'), 'd1')""")
def labelled_results(spark, d):
    """Labelled results in JSON lists of bounded length, and the dashboard's filter over them."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    file = F.concat(F.lit("D"), "doc_id", F.lit(".java"))
    row = F.struct(F.col("lang").alias("checker"), F.col("source").alias("group"), F.col("doc_id").cast("string").alias("case"), file.alias("file"), F.lit("int f()").alias("signature"), F.expr(_LABEL).alias("label"))
    path = work_path(spark, "labelled")
    lists = j.groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("block")).agg(F.to_json(F.collect_list(row)).alias("value"))
    lists.write.partitionBy("lang", "block").text(path)
    found = files.dashboard(files.labelled_results(spark, path + "/lang=*/block=*"), "d1", label="tp")
    return found.select("checker", "group", "case", "file", "label")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_table(spark, d):
    """A table through CSV with a header and a given schema."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = work_path(spark, "csv")
    sinks.write_csv(s, path)
    return files.csv_table(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema))


@query("""SELECT 'type' AS kind, p_type AS token, count(*)::INT AS cnt, count(*) / 1217392 < 0.005 AS considered FROM part GROUP BY 2""")
def frequency_file(spark, d):
    """Frequencies in files of alternating token and count lines."""
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    path = work_path(spark, "frequencies")
    counts.select(F.concat_ws("\n", "p_type", F.col("n").cast("string")).alias("value")).write.text(path)
    from treeloom.operators.patterns import is_rare

    return files.frequency_table(spark, path, "type").withColumn("considered", is_rare(F.col("cnt"), 1_217_392))


@query("""SELECT r_name AS "FileName", r_regionkey AS id, NULL::BIGINT AS parent_id, 'Region' AS type, false AS leaf FROM region
  UNION ALL SELECT r_name, 100 + n_nationkey, r_regionkey, 'Nation', true FROM nation JOIN region ON n_regionkey = r_regionkey""")
def pattern_files(spark, d):
    """Pattern files, one a region, with its nations as a recursive tree, taken apart into nodes."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.struct((F.col("n_nationkey") + 100).alias("id"), F.lit("Nation").alias("type"), F.lit(True).alias("leaf"))
    tree = n.groupBy("r_regionkey", "r_name").agg(F.collect_list(child).alias("children"))
    regions = table(spark, d, "region").select("r_regionkey", "r_name").join(tree, ["r_regionkey", "r_name"], "left")
    root = F.struct(F.col("r_regionkey").alias("id"), F.lit("Region").alias("type"), F.lit(False).alias("leaf"), "children")
    path = work_path(spark, "patterns")
    regions.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("FileName"), root.alias("Before0Tree"))).alias("value")).write.partitionBy("r_regionkey").text(path)
    return files.pattern_nodes(files.patterns(spark, path + "/r_regionkey=*")).select("FileName", "id", "parent_id", "type", "leaf")


@query("""SELECT dataset, "group", cases FROM (SELECT 'r=' || n_regionkey AS dataset, 'n=' || n_nationkey AS "group", count(DISTINCT s_suppkey % 3) AS cases FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS (('r=' || n_regionkey, 'n=' || n_nationkey)))""")
def dataset_scan(spark, d):
    """Cases by dataset and group, from the paths of a folder's files alone."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = work_path(spark, "dataset")
    few = s.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), (F.col("s_suppkey") % 3).alias("c"), F.lit("x").alias("value")).distinct()
    few.write.partitionBy("r", "n", "c").text(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    cases = files.dataset_cases(found, path.removeprefix("file://"))
    levels = metrics.level_counts(cases, ["dataset", "group"], "case")
    return levels.where("dataset IS NOT NULL AND `group` IS NOT NULL")


@query("SELECT (c_custkey // 50)::INT AS block, count(*)::INT AS methods, 0 AS errors FROM customer GROUP BY 1")
def java_source_files(spark, d):
    """Source files of up to fifty classes each, listed, decoded and parsed."""
    classes = registry_java.sources(spark, d)
    units = classes.groupBy(F.floor(F.col("c_custkey") / 50).cast("int").alias("block")).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("value"))
    path = work_path(spark, "classes")
    units.write.partitionBy("block").text(path)
    nodes = files.parsed(dealt(files.source_files(spark, path, "*.txt"), "path"), "java")
    block = F.regexp_extract("tree_id", "block=([0-9]+)/", 1).cast("int")
    return nodes.groupBy(block.alias("block")).agg(F.count_if(F.col("node_type") == "MethodDeclaration").cast("int").alias("methods"), F.count("parse_error").cast("int").alias("errors"))


@query("""SELECT 'd/' || c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'buggy' END || c_custkey AS before, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'fixed' END || c_custkey AS after
  FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0""")
def code_pairs(spark, d):
    """The before and after file of each folder, by the most preferred pair of names that is whole."""
    key = F.col("c_custkey").cast("string")
    one = lambda name, text: F.struct(F.concat(F.lit("d/"), key, F.lit(f"/{name}")).alias("path"), F.concat(F.lit(text), key).alias("text"))
    none = F.struct(F.lit("d/x/readme.md").alias("path"), F.lit("x").alias("text"))
    even, whole = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 7 != 0
    found = F.array(one("buggy.java", "buggy"), F.when(whole, one("fixed.java", "fixed")).otherwise(none), F.when(even, one("Before.java", "b")).otherwise(none), F.when(even, one("after.txt", "a")).otherwise(none))
    return files.code_pairs(table(spark, d, "customer").select(F.explode(found).alias("x")).select("x.*"))


@query("""SELECT 'case' || n_nationkey AS case_id, md5('b' || n_nationkey) AS before_commit_id, 'src/' || n_name || '.java' AS file_path, n_nationkey::VARCHAR AS before_start, (n_nationkey + n_regionkey)::VARCHAR AS before_end FROM nation""")
def change_info(spark, d):
    """Change metadata in JSON files, one a case, as it stands beside a pair of files."""
    n, key = table(spark, d, "nation"), F.col("n_nationkey")
    info = F.struct(F.md5(F.concat(F.lit("b"), key)).alias("before_commit_id"), F.concat(F.lit("src/"), "n_name", F.lit(".java")).alias("file_path"), key.cast("string").alias("before_start"), (key + F.col("n_regionkey")).cast("string").alias("before_end"))
    path = work_path(spark, "changes")
    n.select(F.concat(F.lit("case"), key).alias("case"), F.to_json(info).alias("value")).write.partitionBy("case").text(path)
    found = files.change_info(spark, path + "/case=*").withColumn("case_id", F.regexp_extract(F.col("_metadata.file_path"), "case=([^/]+)/", 1))
    return found.select("case_id", "before_commit_id", "file_path", "before_start", "before_end")
