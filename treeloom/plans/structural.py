"""Structural joins: which nodes lie inside which, by their ranks.

A node's subtree is the range of ranks from `pre` to `last`. Ranges of a tree nest, so one pass over nodes sorted by rank tells what is open
at each of them: no pair of nodes is made and no path is stored. Trees are cut into segments of ranks; a range that crosses a
segment's border is open in each segment it reaches, so one very large tree is spread over tasks, too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("tree_id", "node_id")
#: Ranks of a segment: what one task holds of a tree at most, besides the ranges that are open at its border.
SEGMENT = 1 << 18


def last_below() -> Column:
    """The rank of the last node of a node's subtree."""
    return F.col("post") + F.col("depth")


def _segment(at: Column, segment: int) -> Column:
    return F.floor(at / segment)


def _ranges(df: DataFrame, columns: Sequence[Column], start: Column, end: Column, segment: int) -> DataFrame:
    """columns, seg, begin, end: each range once in every segment it reaches; begin is one before the segment if it is open already."""
    cut = df.select(*columns, start.cast("long").alias("_b"), end.cast("long").alias("end"))
    cut = cut.withColumn("seg", F.explode(F.sequence(_segment(F.col("_b"), segment), _segment(F.col("end"), segment))))
    return cut.withColumn("begin", F.greatest("_b", F.col("seg") * segment - 1)).drop("_b")


def _so_far(value: Column) -> Column:
    """The sum of value over the events up to this one, in a segment of a tree."""
    order = Window.partitionBy("tree_id", "seg").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(order)


def _event(df: DataFrame, at: Column, kind: int) -> DataFrame:
    return df.select("tree_id", "seg", "node_id", at.cast("long").alias("at"), F.lit(kind).alias("kind"))


def holding(outer: DataFrame, inner: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(tree_id, node_id) of the outer nodes with an inner one strictly below; both have tree_id, node_id, pre, post and depth.

    A node's range holds one if more of them have been met at its end than at its start.
    """
    own = _ranges(outer, [F.col(c) for c in KEY], F.col("pre"), last_below(), segment)
    met = _event(inner.select("tree_id", _segment(F.col("pre"), segment).alias("seg"), F.lit(None).cast("long").alias("node_id"), "pre"), F.col("pre"), 0)
    border = (F.col("seg") + 1) * segment - 1
    events = met.unionByName(_event(own, F.col("begin"), 1)).unionByName(_event(own, F.least("end", border), 1))
    counted = events.withColumn("n", _so_far((F.col("kind") == 0).cast("long"))).where("kind = 1")
    found = counted.groupBy("tree_id", "seg", "node_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("b > a")
    return found.select(*KEY)


def inside(inner: DataFrame, outer: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(tree_id, node_id) of the inner nodes strictly below an outer one: those met while more ranges have begun than ended."""
    own = _ranges(outer, [F.col(c) for c in KEY], F.col("pre"), last_below(), segment)
    met = _event(inner.select("tree_id", _segment(F.col("pre"), segment).alias("seg"), "node_id", "pre"), F.col("pre"), 0)
    events = met.unionByName(_event(own, F.col("begin"), 1)).unionByName(_event(own.where(_segment(F.col("end"), segment) == F.col("seg")), F.col("end"), 2))
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, -1).otherwise(0)
    return events.withColumn("n", _so_far(step)).where("kind = 0 AND n > 0").select(*KEY)


def _changes(batch: pa.RecordBatch, key: Sequence[str]) -> list[bool]:
    """For each row whether its key differs from that of the row before; nulls are equal. The first row has False."""
    out = np.zeros(batch.num_rows, bool)
    for c in key:
        a, b = batch.column(c)[:-1], batch.column(c)[1:]
        both_null = pc.and_(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.and_(pc.fill_null(pc.not_equal(a, b), True), pc.invert(both_null)).to_numpy(zero_copy_only=False)
    return out.tolist()


def innermost(points: DataFrame, ranges: DataFrame, on: Sequence[str], segment: int = SEGMENT) -> DataFrame:
    """on, point_id, range_id: each point with the innermost range that holds it; points without one are left out.

    points: on, point_id, at and, if the range has to hold more than a place, until; ranges: on, range_id, start, end; all longs but the keys.
    The innermost one is the shortest, then the one that starts first, then the one with the smallest range_id; ranges may overlap in any way. One sweep over
    sorted rows keeps what is open in a heap, so a point costs what has ended by then, not all ranges of its key.
    """
    keys = [F.col(c) for c in on]
    spread = _ranges(ranges, [*keys, F.col("range_id").alias("id"), F.col("start").cast("long").alias("first")], F.col("start"), F.col("end"), segment)
    opened = spread.select(*on, "seg", F.col("begin").alias("at"), F.lit(0).alias("kind"), "first", "end", "id")
    until = F.col("until" if "until" in points.columns else "at").cast("long")
    place = F.col("at").cast("long")
    met = points.select(*keys, _segment(place, segment).alias("seg"), place.alias("at"), F.lit(1).alias("kind"), place.alias("first"), until.alias("end"), F.col("point_id").alias("id"))
    rows = opened.unionByName(met).repartition(*on, "seg").sortWithinPartitions(*on, "seg", "at", "kind")
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, heap = None, []
        for batch in filter(len, batches):
            at, kind, first, end, ids = (c.to_pylist() for c in batch.columns[len(on) + 1 :])
            key = [*on, "seg"]
            starts = _changes(batch, key)
            starts[0] = before is None or before != batch.slice(0, 1).select(key).to_pylist()
            before = batch.slice(batch.num_rows - 1).select(key).to_pylist()
            hit, found = [], []
            for i in range(batch.num_rows):
                if starts[i]:
                    heap = []
                if kind[i] == 0:
                    heappush(heap, (end[i] - first[i], first[i], ids[i], end[i]))
                    continue
                while heap and heap[0][3] < at[i]:
                    heappop(heap)
                own = heap[0] if heap else None
                if own is not None and own[3] < end[i]:  # holds the place, but not all that is asked
                    own = min((x for x in heap if x[3] >= end[i]), default=None)
                if own is not None:
                    hit.append(i)
                    found.append(own[2])
            taken = batch.take(pa.array(hit, pa.int64()))
            columns = [taken.column(c) for c in on] + [taken.column("id").cast(pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*on, "point_id", "range_id"])

    return rows.select(*on, "seg", "at", "kind", "first", "end", "id").mapInArrow(run, f"{kinds}, point_id long, range_id long")
