"""Connected components by alternating large-star and small-star steps; every step is two shuffles and is written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import delete_path, shuffled, work_path


def _least(pairs: DataFrame, node: str) -> DataFrame:
    return pairs.groupBy(node).agg(F.min("v").alias("m"))


class _Scratch:
    """Tables of a round; all but the one that goes on are deleted after it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        self.paths.append(work_path(self.spark, "components"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop_but_last(self) -> None:
        for path in self.paths[:-1]:
            delete_path(self.spark, path)
        del self.paths[:-1]


def _large_star(edges: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles and a node with very many edges can be split
    least = put(_least(both, "u").select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = put(_least(down, "u"))
    linked = down.join(shuffled(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another; root is the component's smallest node.

    edges: u, v of one ordered type without nulls, u <> v; direction and repeats don't matter. No edges: no rows. A node
    with very many edges is met by partial min aggregates and by joins that can be split, never gathered.
    """
    scratch = _Scratch(edges.sparkSession)
    marked = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
    now = scratch.put(edges.select("u", "v"))
    mark = marked(now)
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = scratch.put(_small_star(_large_star(now, scratch.put), scratch.put))
        scratch.drop_but_last()
        before, mark = mark, marked(now)
        if mark == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
