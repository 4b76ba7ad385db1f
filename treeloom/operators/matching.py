"""Matching of warnings to ground truth and what follows from it: one-to-one, many-to-one, ranges, labels, metrics.

Warnings and truths are met by equi-joins (file, group) with the range as a filter, so Catalyst can hash or sort them; the
greedy one-to-one assignment, which depends on its own earlier choices, goes in rounds until groups are small enough for a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.functions.columns import safe_div
from treeloom.sources.work import written

#: Pairs of a group that one task may hold.
GROUP_PAIRS = 1 << 18


def in_range(line: str | Column, begin: str | Column, end: str | Column, tolerance: int = 0) -> Column:
    """begin - tolerance <= line <= end + tolerance, as integers."""
    line, begin, end = (F.col(c) if isinstance(c, str) else c for c in (line, begin, end))
    return line.cast("int").between(begin.cast("int") - tolerance, end.cast("int") + tolerance)


def range_matches(warnings: DataFrame, truths: DataFrame, on: list[str], tolerance: int = 1) -> DataFrame:
    """All pairs of a warning (line) and a truth (begin, end) with equal keys whose range holds the line."""
    return warnings.join(truths, on).where(in_range("line", "begin", "end", tolerance))


def binned_range_matches(warnings: DataFrame, truths: DataFrame, on: list[str], tolerance: int = 1, width: int = 64) -> DataFrame:
    """The same for keys with very many rows: ranges are cut into bins of lines, so a hot key spreads over its bins."""
    first = F.floor((F.col("begin") - tolerance) / width)
    last = F.floor((F.col("end") + tolerance) / width)
    cut = truths.withColumn("_bin", F.explode(F.sequence(first, last)))
    own = warnings.withColumn("_bin", F.floor(F.col("line") / width))
    return own.join(cut, [*on, "_bin"]).where(in_range("line", "begin", "end", tolerance)).drop("_bin")


def renamed_range_matches(warnings: DataFrame, truths: DataFrame, renames: DataFrame, tolerance: int = 1) -> DataFrame:
    """Pairs by file, function name and range, where a warning may name its file by an old path (renames: old, new; each old one once).

    Lines may be texts: they are compared as numbers, and what isn't one matches nothing.
    """
    paths = renames.select(F.col("old").alias("file"), F.col("new").alias("_new"))
    number = lambda *names: {c: F.col(c).cast("string").try_cast("long") for c in names}
    own = lookup(warnings, (paths, ["file"])).withColumn("file", F.coalesce("_new", "file")).drop("_new").withColumns(number("line"))
    ranges = truths.withColumns(number("begin", "end")).where(F.col("begin") <= F.col("end"))
    return binned_range_matches(own, ranges, ["file", "function"], tolerance)


def matches(warnings: DataFrame, truths: DataFrame, on: list[str], match: Callable[[], Column]) -> DataFrame:
    """Pairs with equal keys for which match(), a condition on their columns, holds."""
    return warnings.join(truths, on).where(match())


def equi_matches(warnings: DataFrame, truths: DataFrame, on: list[str], holds: tuple[str, str] | None = None) -> DataFrame:
    """Pairs with equal keys (file, name, parameters); holds: the first column's text has to contain the second's, as for paths."""
    if holds is None:
        return warnings.join(truths, on)
    return matches(warnings, truths, on, lambda: F.contains(F.col(holds[0]), F.col(holds[1])))


def first_match(pairs: DataFrame, left: list[str], order: list[str]) -> DataFrame:
    """One row per left key: the first by order; a min_by aggregate, so that rows meet in partial results and no group is gathered."""
    rest = [c for c in pairs.columns if c not in left]
    return pairs.groupBy(*left).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*left, "_first.*")


def _greedy_groups(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Lefts in order, each takes its first right that is free; a group of bounded size is one task's work."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for key, own in rows.sort_values([left, right], kind="stable").groupby(left, sort=True):
            free = next((r for r in own[right] if r not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((rows[group].iloc[0], key, free))
        return pd.DataFrame(out, columns=[group, left, right])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(group, left, right).groupBy(group).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (group, left, right)))


def greedy_one_to_one(pairs: DataFrame, group: str, left: str, right: str, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(group, left, right): lefts in order, each takes its first right that is free. Repeated pairs count once; nulls take no part.

    Groups of over group_pairs pairs are matched in rounds of joins and min aggregates: a left gets its first free right if it is the first
    of all lefts that could still take that one, since nobody before it can claim it then. The first left of all is always such a pair, so each
    round matches some, and what is left is smaller. A group that has become small is finished by one task.
    """
    left_, rows, done = written(pairs.select(group, left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct(), "greedy-pairs"), None, []
    while True:
        sizes = left_.groupBy(group).agg(F.count("*").alias("_n"))
        large = written(sizes.where(F.col("_n") > group_pairs).select(group), "greedy-large")
        if large.limit(1).count() == 0:
            done.append(_greedy_groups(left_, group, left, right))
            break
        same = lambda df, *on: [df[c].eqNullSafe(left_[c]) for c in on]  # noqa: E731, B023
        done.append(_greedy_groups(left_.join(large, same(large, group), "left_anti"), group, left, right))
        rows = written(left_.join(large, same(large, group), "left_semi"), "greedy-pairs")
        first_right = rows.groupBy(group, left).agg(F.min(right).alias(right))
        first_left = rows.groupBy(group, right).agg(F.min(left).alias(left)).select(*[F.col(c).alias(f"_{c}") for c in (group, left, right)])
        meet = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (group, left, right)]
        won = written(first_right.join(first_left, meet).select(group, left, right), "greedy-won")
        done.append(won)
        taken = lambda col: won.select(*[F.col(c).alias(f"_{c}") for c in (group, col)])  # noqa: E731, B023
        on = lambda col: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (group, col)]
        left_ = written(rows.join(taken(left), on(left), "left_anti").join(taken(right), on(right), "left_anti"), "greedy-pairs")
    return reduce(DataFrame.unionByName, done)


def ranked_one_to_one(lefts: DataFrame, rights: DataFrame, on: list[str], left_order: list, right_order: list) -> DataFrame:
    """The same where all lefts and rights of a key match each other: the n-th left takes the n-th right."""
    a = lefts.withColumn("_n", F.row_number().over(Window.partitionBy(on).orderBy(*left_order)))
    b = rights.withColumn("_n", F.row_number().over(Window.partitionBy(on).orderBy(*right_order)))
    return a.join(b, [*on, "_n"]).drop("_n")


def confusion(tp: Column, fp: Column, fn: Column, tn: Column | None = None, digits: int | None = None) -> list[Column]:
    """precision, recall, f1 and, with tn, accuracy, fpr, fnr; 0 where a denominator is 0."""
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    out = [p.alias("precision"), r.alias("recall"), safe_div(2 * p * r, p + r).alias("f1")]
    if tn is not None:
        out += [safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe_div(fp, fp + tn).alias("fpr"), safe_div(fn, fn + tp).alias("fnr")]
    return out if digits is None else [F.round(c, digits).alias(n) for c, n in zip(out, ("precision", "recall", "f1", "accuracy", "fpr", "fnr"), strict=False)]


def one_to_one_metrics(warnings: DataFrame, truths: DataFrame, matched: DataFrame, group: str, changed: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn (and tn = changed - the others, never below 0) with their rates, by group."""
    n = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    out = n(warnings, "n_w").join(n(truths, "n_t"), group, "full").join(n(matched, "tp"), group, "left")
    out = out.na.fill(0, ["n_w", "n_t", "tp"])
    tp, fp, fn = F.col("tp"), F.col("n_w") - F.col("tp"), F.col("n_t") - F.col("tp")
    if changed is None:
        return out.select(group, "tp", fp.alias("fp"), fn.alias("fn"), *confusion(tp, fp, fn))
    out = out.join(n(changed, "n_c"), group, "left").na.fill(0, ["n_c"])
    tn = F.greatest(F.col("n_c") - tp - fp - fn, F.lit(0))
    return out.select(group, "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), *confusion(tp, fp, fn, tn))


def many_to_one(warnings: DataFrame, truths: DataFrame, on: list[str], warning_id: str, truth_id: str, tolerance: int = 1) -> DataFrame:
    """Each warning with its first matching truth, or null; truths may be taken again."""
    pairs = first_match(binned_range_matches(warnings, truths, on, tolerance), [warning_id], ["begin", truth_id])
    return warnings.join(pairs.select(warning_id, truth_id), warning_id, "left")


def many_to_one_counts(labelled: DataFrame, truths: DataFrame, truth_id: str) -> DataFrame:
    """tp, fp and fn; fn counts the truths that no warning took, so it is never negative."""
    hit = labelled.where(F.col(truth_id).isNotNull()).select(truth_id).distinct()
    fn = truths.join(hit, truth_id, "left_anti").agg(F.count("*").alias("fn"))
    return labelled.agg(F.count(truth_id).alias("tp"), F.count_if(F.col(truth_id).isNull()).alias("fp")).join(fn)


def changed_only(warnings: DataFrame, functions: DataFrame, on: list[str], tolerance: int = 1) -> DataFrame:
    """Warnings within a changed function (begin, end; `signature` holds the warning's function name)."""
    pairs = binned_range_matches(warnings, functions, on, tolerance).where(F.col("signature").contains(F.col("function")))
    return warnings.join(pairs.select("warning_id").distinct(), "warning_id", "left_semi")


def labelled(warnings: DataFrame, truths: DataFrame, functions: DataFrame, on: list[str], tolerance: int = 1) -> DataFrame:
    """(label, warning_id, truth_id, function_id): warnings in a function as tp or fp, truths without a warning as fn."""
    f = functions.select(*on, "function_id", "begin", "end")
    w = first_match(binned_range_matches(warnings.select(*on, "warning_id", "line"), f, on, tolerance), ["warning_id"], ["begin", "function_id"])
    hit = first_match(binned_range_matches(warnings, truths, on, tolerance), ["warning_id"], ["begin", "truth_id"]).select("warning_id", "truth_id")
    seen = w.select("warning_id", "function_id").join(hit, "warning_id", "left")
    seen = seen.select(F.when(F.col("truth_id").isNull(), "fp").otherwise("tp").alias("label"), "warning_id", "truth_id", "function_id")
    alone = truths.join(hit.select("truth_id").distinct(), "truth_id", "left_anti").select(*on, "truth_id", F.col("begin").alias("line"), F.col("end").alias("t_end"))
    alone = binned_range_matches(alone, f, on, tolerance).where(F.col("t_end") <= F.col("end") + tolerance)
    alone = first_match(alone, ["truth_id"], ["begin", "function_id"])
    return seen.unionByName(alone.select(F.lit("fn").alias("label"), F.lit(None).cast(dict(seen.dtypes)["warning_id"]).alias("warning_id"), "truth_id", "function_id"))


def lookup(rows: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """rows with the columns of each table that has their keys; Spark broadcasts the tables that are small."""
    for df, on in tables:
        rows = rows.join(df, on, "left")
    return rows


def paired_confusion(results: DataFrame, by: list[str]) -> DataFrame:
    """From (by, on_buggy, on_fixed): a rule should fire on the buggy text and not on the fixed one."""
    tp, fn = F.count_if("on_buggy"), F.count_if(~F.col("on_buggy"))
    fp, tn = F.count_if("on_fixed"), F.count_if(~F.col("on_fixed"))
    out = results.groupBy(by).agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"))
    return out.select("*", *confusion(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def micro_average(counts: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Sums of tp, fp, fn, tn by group and their rates."""
    out = counts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return out.select(*by, "tp", "fp", "fn", "tn", *confusion(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), digits=digits))


def rolled_up(counts: DataFrame, outer: str, inner: str, digits: int = 4) -> DataFrame:
    """Rates per inner within outer, per outer, and over all; null where a level is summed over."""
    out = counts.rollup(outer, inner).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return out.select(outer, inner, "tp", "fp", "fn", "tn", *confusion(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), digits=digits))


def aligned(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(status, n): keys in both with equal or other values, and keys in one only."""
    x = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    status = F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("other")
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def recall_case(reports: DataFrame, fixed: DataFrame, on: list[str]) -> DataFrame:
    """Whether a report's name stands in the fixed code and its path in the expected one, else how many reports there are."""
    hit = fixed["code"].contains(reports["name"]) & reports["path"].contains(fixed["expected_path"])
    out = fixed.join(reports, on, "left")
    return out.groupBy(on).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("recalled"), F.count(reports["name"]).alias("reports"))
