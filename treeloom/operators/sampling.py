"""Sampling, top-k and ordering. Choices hang on a hash of a key and a seed, so they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dice(key: str | Column, seed: int = 42) -> Column:
    """A reproducible order that has nothing to do with the key's own."""
    return F.md5(F.concat_ws("#", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed))))


def sample_k(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement: a top-k by dice, which each partition answers for itself first."""
    return df.orderBy(dice(key, seed), key).limit(k)


def one_per_group(df: DataFrame, group: list[str], key: str, seed: int = 42) -> DataFrame:
    """One row of each group; a min_by aggregate, so no group is gathered."""
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), F.struct(dice(key, seed), F.col(key))).alias("_row")).select("_row.*")


def share_of_rows(df: DataFrame, by: list[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """The floor of a share of each group's rows."""
    n = df.groupBy(by).agg(F.floor(F.count("*") * F.lit(share)).alias("_most"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(dice(key, seed), key))
    return df.withColumn("_r", rank).join(n, by).where("_r <= _most").drop("_r", "_most")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def deepest_first(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("depth"), "tree_id", "node_id")


def by_category(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the order of a list of categories, others last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place))


def few_or_none(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """Groups of at most `most` rows; larger ones are left out whole."""
    n = df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(*by)
    return df.join(n, by, "left_semi")


def navigation(df: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct values per level, sorted."""
    return df.select(*levels).distinct().orderBy(*levels)
