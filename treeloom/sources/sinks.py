"""Sinks: node tables, patterns, detection results, texts and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.sets import latest


def write_nodes(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A node table, clustered by type so that queries skip files."""
    nodes.sortWithinPartitions("dsl_type", "tree_id", "node_id").write.mode(mode).parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """The node table at path, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def edit_json(operations: DataFrame) -> DataFrame:
    """(tree_id, insertNodes, moveParentNodes): JSON lists of inserted nodes with their parents and of moved ones with their new parents."""
    ins = F.col("kind").isin("insert", "tree-insert")
    one = F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "pos", "node_type", "value")
    moved = F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "pos")
    lists = [F.to_json(F.array_sort(F.collect_list(F.when(w, s)))).alias(n) for w, s, n in ((ins, one, "insertNodes"), (F.col("kind") == "move", moved, "moveParentNodes"))]
    return operations.groupBy("tree_id").agg(*lists)


def node_json(nodes: DataFrame) -> DataFrame:
    """(tree_id, json): a tree's nodes as a list of flat objects."""
    row = F.struct(F.col("node_id").alias("id"), "parent_id", F.col("node_type").alias("type"), F.col("is_expr").alias("isExpr"), "value", F.col("is_leaf").alias("leaf"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    return nodes.groupBy("tree_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def attribute_json(attributes: DataFrame) -> DataFrame:
    """(tree_id, json): the attributes by node, with what considers them."""
    value = F.struct("location", "type", "name", "expr_type", "tokens")
    return attributes.groupBy("tree_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("node_id").cast("string"), value)))).alias("json"))


def detection_json(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, json): {detected, results: [{file, signature}]}; a null signature stays null."""
    rows = F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("file", "signature"))))
    out = found.groupBy(by).agg(rows.alias("results"))
    return out.select(*by, F.to_json(F.struct((F.size("results") > 0).alias("detected"), "results"), {"ignoreNullFields": "false"}).alias("json"))


def write_texts(df: DataFrame, path: str, text: str, by: list[str], mode: str = "overwrite") -> None:
    """Texts (queries, patches, method sources), one folder per key."""
    df.select(*by, F.col(text).alias("value")).write.mode(mode).partitionBy(*by).text(path)


def append_store(df: DataFrame, path: str) -> None:
    """Adds to a store; `read_store` shows the last entry per key."""
    when = F.struct(F.current_timestamp().alias("at"), F.monotonically_increasing_id().alias("no"))
    df.withColumn("_at", when).write.mode("append").parquet(path)  # of one write's entries the later one counts


def read_store(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path), key, "_at").drop("_at")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def save_context(spark: SparkSession, path: str, step: str, entries: dict[str, str]) -> None:
    """A dialogue's state at a step, so that a run can go on from it."""
    append_store(spark.createDataFrame([(step, k, v) for k, v in entries.items()], "step string, key string, value string"), path)


def load_context(spark: SparkSession, path: str, step: str) -> dict[str, str]:
    """All of the state saved at a step: as much as save_context was given."""
    return {r["key"]: r["value"] for r in read_store(spark, path, ["step", "key"]).where(F.col("step") == step).collect()}
