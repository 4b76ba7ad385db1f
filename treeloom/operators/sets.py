"""Set operations and work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def union(*parts: DataFrame) -> DataFrame:
    return concat(*parts).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def remaining(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What isn't done yet."""
    return work.join(done.select(on).distinct(), on, "left_anti")


def contains_all(members: DataFrame, wanted: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, all_there): whether all of an owner's items are among the wanted."""
    flagged = members.join(wanted.select(item).distinct().withColumn("_in", F.lit(True)), item, "left")
    return flagged.groupBy(owner).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all_there"))


def distinct_text(conditions: DataFrame, on: list[str]) -> DataFrame:
    return conditions.dropDuplicates(on)


def latest(history: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row written per key: a store that is only appended to reads as one that is updated."""
    return history.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.col(order)).alias("_row")).select("_row.*")


def upto_step(history: DataFrame, dialogue: str, step: str, text: Column) -> DataFrame:
    """history with all that was said in a dialogue up to each step."""
    w = Window.partitionBy(dialogue).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("history", F.collect_list(text).over(w))


def sections(lines: DataFrame, is_header: Column, file: str = "file", place: str = "line_no") -> DataFrame:
    """lines with the number of their section; a header starts one, so what came before a second header stays apart."""
    w = Window.partitionBy(file).orderBy(place)
    return lines.withColumn("section", F.sum(F.when(is_header, 1).otherwise(0)).over(w))


def cross_cases(cases: DataFrame, group: str, case: str, same: bool = False) -> DataFrame:
    """(group, rule_case, scanned_case): a rule scans the other cases of its group, or its own."""
    a, b = cases.select(group, F.col(case).alias("rule_case")), cases.select(group, F.col(case).alias("scanned_case"))
    keep = F.col("rule_case") == F.col("scanned_case")
    return a.join(b, group).where(keep if same else ~keep)
