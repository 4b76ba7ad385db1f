"""Aggregates: counts, bins, descriptive statistics, outliers, coverage, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.functions.columns import safe_div
from treeloom.sources.work import written


#: Values of a group that one task may hold.
GROUP_VALUES = 1 << 18
BINS = 1024


def _largest(df: DataFrame, by: list[str], value: str) -> int:
    """How many values the largest group has; one partial aggregate."""
    return df.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], group_values: int = GROUP_VALUES, bins: int = BINS) -> DataFrame:
    """by and a column for each share: exact quantiles, linear between neighbours, of the values that aren't null or NaN.

    Groups of up to group_values values are one aggregate. In larger ones each quantile's two neighbours are selected by rank: rounds of
    histograms over the range that still holds the rank, until few values or equal ones are left there. A round is one partial aggregate
    of bounded size; no group's values meet in one task.
    """
    rows = df.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    key = [f"_by{i}" for i in range(len(by))]
    named = [F.col(k).alias(c) for k, c in zip(key, by, strict=True)]
    columns = [F.percentile("_v", p).alias(name) for name, p in shares.items()]
    if _largest(rows, key, "_v") <= group_values:
        return rows.groupBy(*key).agg(*columns).select(*named, *shares)
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-groups")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key], F.lit(True))
    large = sizes.where(F.col("_n") > group_values)
    # a rank (from 0) for each neighbour of each quantile, what lies below its range, and the range
    places = [F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), end(F.lit(p) * (F.col("_n") - 1)).cast("long").alias("rank")) for name, p in shares.items() for end in (F.floor, F.ceil)]
    targets = large.select(*key, "_n", "_lo", "_hi", F.explode(F.array(*places)).alias("t")).select(*key, "t.rank", "_lo", "_hi", "_n", F.lit(0).cast("long").alias("below"))
    targets = written(targets.distinct().withColumnRenamed("_n", "inside"), "quantile-ranks")
    while targets.where((F.col("inside") > group_values) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        wide = targets.where((F.col("inside") > group_values) & (F.col("_lo") < F.col("_hi")))
        met = rows.join(wide, same(rows, wide)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        place = F.least(F.lit(bins - 1), F.floor((F.col("_v") / bins - F.col("_lo") / bins) / (F.col("_hi") / bins - F.col("_lo") / bins) * bins)).cast("int")
        of = [*[wide[k] for k in key], "rank", "below"]
        counted = written(met.groupBy(*of, place.alias("bin")).agg(F.count("*").alias("inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-bins")
        order = Window.partitionBy(*key, "rank", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("inside").over(order), F.lit(0))
        narrowed = counted.withColumn("_before", before).where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("inside")))
        narrowed = narrowed.select(*key, "rank", "_lo", "_hi", "inside", F.col("_before").alias("below"))
        targets = written(targets.where(~((F.col("inside") > group_values) & (F.col("_lo") < F.col("_hi")))).unionByName(narrowed), "quantile-ranks")
    settled = targets.where(F.col("_lo") == F.col("_hi")).select(*key, "rank", F.col("_lo").alias("v"))
    few = targets.where(F.col("_lo") < F.col("_hi"))
    met = rows.join(few, same(rows, few)).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*[few[k] for k in key], "rank", "below", "_v")
    at = F.row_number().over(Window.partitionBy(*key, "rank").orderBy("_v")) - 1 + F.col("below")
    selected = settled.unionByName(met.withColumn("_at", at).where("_at = rank").select(*key, "rank", F.col("_v").alias("v")))
    selected = written(selected, "quantile-values")
    out = large.select(*key, "_n").join(selected.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at")).select(*[F.col(k).alias(f"{k}_") for k in key], "_at"), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key], F.lit(True)))

    def between(p: float) -> Column:
        x = F.lit(p) * (F.col("_n") - 1)
        low, high = (F.element_at("_at", end(x).cast("long")) for end in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low * (F.ceil(x) - x) + high * (x - F.floor(x)))

    big = out.select(*named, *[between(p).alias(name) for name, p in shares.items()])
    small = sizes.where(F.col("_n") <= group_values)
    return rows.join(small, same(rows, small), "left_semi").groupBy(*key).agg(*columns).select(*named, *shares).unionByName(big)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sample deviation, min, median, max."""
    own = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    if _largest(df, by, value) <= GROUP_VALUES:
        return df.groupBy(by).agg(*own, F.median(value).alias("median")).select(*by, "mean", "std", "min", "median", "max")
    out = df.groupBy(by).agg(*own)
    middle = quantiles(df, by, value, {"median": 0.5}).select(*[F.col(c).alias(f"_{c}") for c in by], "median")
    joined = out.join(middle, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True)), "left")
    return joined.select(*by, "mean", "std", "min", "median", "max")


def group_nunique(df: DataFrame, by: str, distinct: str, value: str, digits: int = 2) -> DataFrame:
    """Distinct count, sum and rounded mean by group."""
    return df.groupBy(by).agg(F.countDistinct(distinct).alias("n_distinct"), F.sum(value).alias("total"), F.round(F.avg(value), digits).alias("mean"))


def bin_of(value: Column, edges: list[float], right: bool = True) -> Column:
    """The number of the bin that holds value: (a, b] if right, else [a, b); the last bin has no upper end; null outside."""
    made = F.lit(None).cast("int")
    for k in range(len(edges) - 1, -1, -1):
        upper = edges[k + 1] if k + 1 < len(edges) else None
        inside = (value > edges[k]) if right else (value >= edges[k])
        if upper is not None:
            inside = inside & ((value <= upper) if right else (value < upper))
        made = F.when(inside, F.lit(k)).otherwise(made)
    return made


def bin_labels(edges: list[float], right: bool = True) -> list[str]:
    ends = [*edges[1:], None]
    return [f"{'(' if right else '['}{a}, {'inf)' if b is None else f'{b}]' if right else f'{b})'}" for a, b in zip(edges, ends, strict=True)]


def binned(df: DataFrame, value: str, edges: list[float], right: bool = True) -> DataFrame:
    """(bin, label, n, share) for every bin, empty ones included, in order; share is of the values inside any bin."""
    spark = df.sparkSession
    counts = df.select(bin_of(F.col(value), edges, right).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    all_bins = spark.createDataFrame(list(enumerate(bin_labels(edges, right))), "bin int, label string")
    out = all_bins.join(counts, "bin", "left").join(total)
    n = F.coalesce("n", F.lit(0))
    return out.select("bin", "label", n.alias("n"), safe_div(n, F.coalesce("total", F.lit(0))).alias("share"))


def without_outliers(df: DataFrame, by: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles (linear quantiles, bounds included)."""
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75})
    reach = (F.col("_q3") - F.col("_q1")) * k
    return df.join(q, by).where(F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")


def coverage(df: DataFrame, by: list[str], hits: str, total: str) -> DataFrame:
    """Overall share of hits and the number of cases; coverage_rates has the cases' own."""
    return df.groupBy(by).agg(safe_div(F.sum(hits), F.sum(total)).alias("coverage"), F.count("*").alias("cases"))


def coverage_rates(df: DataFrame, by: list[str], hits: str, total: str) -> DataFrame:
    """(by, rate, cases): the shares of the cases as rows, equal ones counted, for a distribution of any size."""
    return df.groupBy(*by, safe_div(F.col(hits), F.col(total)).alias("rate")).agg(F.count("*").alias("cases"))


def scan_summary(df: DataFrame, count: str = "n", other: str = "m", missing: int = -1) -> DataFrame:
    """min, max, avg of a count and how often it is better (less) or worse than another; missing ones aside."""
    there = (F.col(count) != missing) & (F.col(other) != missing)
    own = F.when(F.col(count) != missing, F.col(count))
    return df.agg(
        F.min(own).alias("least"), F.max(own).alias("most"), F.avg(own).alias("mean"),
        F.count_if(there & (F.col(count) < F.col(other))).alias("better"), F.count_if(there & (F.col(count) > F.col(other))).alias("worse"),
    )


def detection_summary(df: DataFrame) -> DataFrame:
    """From (detected, n_results, seconds): rate, and averages over the detected ones only."""
    return df.agg(
        F.count("*").alias("total"), F.count_if("detected").alias("detected"), safe_div(F.count_if("detected"), F.count("*")).alias("rate"),
        F.avg(F.when(F.col("detected"), F.col("n_results"))).alias("mean_results"), F.avg(F.when(F.col("detected"), F.col("seconds"))).alias("mean_seconds"),
    )


def repair_summary(df: DataFrame) -> DataFrame:
    """From (group, adapted, correct): a group succeeds if any of its patches is correct."""
    groups = df.groupBy("group").agg(F.bool_or("adapted").alias("adapted"), F.bool_or("correct").alias("correct"))
    return groups.agg(F.count("*").alias("total"), F.count_if("adapted").alias("adapted"), F.count_if("correct").alias("success"), F.count_if(~F.col("correct")).alias("failed"))


def level_counts(df: DataFrame, levels: list[str], case: str) -> DataFrame:
    """Distinct cases at every level of a directory tree, the whole first."""
    return df.rollup(*levels).agg(F.countDistinct(case).alias("cases"))


def token_cost(messages: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """From (model, role, tokens) and (model, input_price, output_price) per million tokens: tokens and cost."""
    priced = messages.join(prices, "model", "left")
    price = F.when(F.col("role") == "assistant", F.col("output_price")).otherwise(F.col("input_price"))
    return priced.groupBy(by).agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("tokens") * F.coalesce(price, F.lit(0.0))) / 1e6).alias("cost"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str, pattern: str = r"\s+") -> DataFrame:
    """(token, cnt): in how many documents a token occurs."""
    tokens = docs.select(id_col, F.explode(F.array_distinct(F.split(text_col, pattern))).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"))
