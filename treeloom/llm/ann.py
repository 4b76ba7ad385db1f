"""Approximate nearest neighbours by inner product over learned partitions.

A bounded sample of the vectors (`sample_rows`, or one of 256 rows up to `max_sample_rows`) gives an exact neighbour graph, which is cut into balanced parts: median cuts along
principal directions, then moves of single vectors to the part that holds most of their neighbours while parts stay within their
capacity. A small classifier (one hidden layer) learns from a vector the shares of the parts among its neighbours. Every row
of the table then belongs to its most probable part; a query searches its most probable parts, as many as gave `recall_target`
on held-out vectors of the sample, and the vectors found there are reranked by exact inner products in double precision.

Only the classifier (some hundred kilobytes) is broadcast. Parts are packed into cells of at most `block_rows` rows, a larger part
is cut into several by a salt. A query goes once to each cell that holds rows of its parts, where it is compared with those parts
only; a cell's queries are cut into blocks of about `query_rows`, for each of which the cell's rows are copied. Each block gives at most k
rows a query. Of equal vectors a part compares only the k + 1 smallest ids, as no more can be among the k nearest. What a query
costs is the rows of its parts: a few parts where vectors have structure, most of them where they have none.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do vectors of another length than the table's most frequent one. Rows with the query's own id are its own.
Rows that repeat id and vector count once. An id with several vectors asks with the smallest of them (compared component by
component), and each of its vectors is a candidate of other ids; the order of rows plays no part. Ties go to the smaller id. Fewer candidates than k are all returned, as all parts
are searched when the sample holds everything that small. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.llm.common import table

K = 20
SAMPLE_ROWS = 8192
#: Larger tables have larger samples, and so more parts: a row of so many, up to a bound that the driver can hold.
SAMPLE_SHARE = 256
MAX_SAMPLE_ROWS = 32_768
PART_ROWS = 64  # of the sample, at least, in a part
GRAPH_NEIGHBOURS = 20
RECALL_TARGET = 0.95
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
HIDDEN = 128


@dataclass
class Router:
    """The classifier and the number of parts that a query searches."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def n_parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n].astype(np.int32)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner products to each row, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[at : at + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row: parts of like size with few graph edges between them."""
    part = np.zeros(len(x), np.int32)
    made, todo = 1, [(np.arange(len(x)), n_parts, 0)]
    while todo:
        rows, parts, name = todo.pop()
        if parts == 1 or len(rows) < 2:
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        left = parts // 2
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * left // parts
        part[order[cut:]] = made
        todo += [(order[:cut], left, name), (order[cut:], parts - left, made)]
        made += 1
    room = int(np.ceil(len(x) / n_parts * slack))
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), np.int32)
        np.add.at(votes, (both[0], part[both[1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=n_parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[best[i]] += 1
                sizes[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if moved * 200 < len(x):
            break
    return part


def train(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, seed: int = 5) -> Router:
    """Softmax regression with one hidden layer on soft targets, by Adam."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    scale = 1 / max(float(np.sqrt((x**2).sum(axis=1).mean())), 1e-30)
    w = [rng.normal(0, np.sqrt(2.0), (d, hidden)) * scale, np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
    w = [a.astype(np.float32) for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    rates = [0.01 * scale, 0.01, 0.01, 0.01]
    x, target, step = x.astype(np.float32), target.astype(np.float32), 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            rows = order[at : at + 512]
            a, t = x[rows], target[rows]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            e = (z / z.sum(axis=1, keepdims=True) - t) / len(rows)
            back = (e @ w[2].T) * (h > 0)
            grads = [a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)]
            step += 1
            fade = 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= rates[k] * fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-12)
    return Router(*w, probes=p)


def fit(x: np.ndarray, *, k: int = K, n_parts: int | None = None, recall_target: float = RECALL_TARGET) -> Router:
    """A router from sample vectors (rows of x, in an order that doesn't depend on their values)."""
    n = len(x)
    n_parts = n_parts or max(1, n // PART_ROWS)
    if n_parts < 2:
        d = x.shape[1]
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    x = x.astype(np.float32)
    graph = neighbours(x, GRAPH_NEIGHBOURS)
    part = balanced_parts(x, graph, n_parts)
    target = np.zeros((n, n_parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
    np.add.at(target, (np.arange(n), part), 1)
    target /= target.sum(axis=1, keepdims=True)
    held = np.arange(n) % 8 == 0
    router = train(x[~held], target[~held])
    # recall of held-out queries by the number of parts searched
    home = router.parts(x, 1)[:, 0]
    queries = np.flatnonzero(held)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    near = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
    place = np.empty((len(queries), n_parts), np.int32)
    ranked = router.parts(x[queries], n_parts)
    np.put_along_axis(place, ranked, np.arange(n_parts, dtype=np.int32)[None, :].repeat(len(queries), 0), axis=1)
    needed = np.take_along_axis(place, home[near], axis=1)
    recall = np.array([(needed <= p).mean() for p in range(n_parts)])
    router.probes = int(np.argmax(recall >= recall_target)) + 1 if (recall >= recall_target).any() else n_parts
    return router


def usable(vector: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64) if len(column) else np.empty((0, 0))


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k nearest rows of each query, and of some more where scores are close."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    # of equal vectors the k + 1 smallest ids; the same pair of id and vector once
    keys = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    kind = np.unique(keys, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kind))
    once = np.ones(len(order), bool)
    once[1:] = (kind[order][1:] != kind[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[once]
    starts = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    order = order[rank <= k]
    x, ids = x[order], ids[order]
    found = []
    for at in range(0, len(q), 256):
        part, part_ids = q[at : at + 256], q_ids[at : at + 256]
        s = part @ x.T
        own = part_ids[:, None] == ids[None, :]
        s[own] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        i, j = np.nonzero((s >= (least - slack)[:, None]) & ~own)
        found.append((part_ids[i], ids[j], (part[i] * x[j]).sum(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def best_of_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, router: Router) -> pd.DataFrame:
    """The k nearest rows of each query among those of its parts that lie in a cell: query_id, vec_id, score."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not (queries.empty or rows.empty):
        x, ids, part = _matrix(rows["vector"]), rows["id"].to_numpy(), rows["part"].to_numpy()
        q, q_ids = _matrix(queries["vector"]), queries["id"].to_numpy()
        probed = np.zeros((len(q), router.n_parts), bool)
        np.put_along_axis(probed, router.parts(q, router.probes), True, axis=1)
        for p in np.unique(part):
            asks, here = probed[:, p], part == p
            if asks.any():
                found.append(nearest(q[asks], q_ids[asks], x[here], ids[here], k))
    out = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out.groupby("query_id", sort=False).head(k).reset_index(drop=True)


def cells(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each part: parts share a cell while it has room, a larger part has several of its own."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell, held = 0, 0
    for p, n in enumerate(sizes):
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[p], count[p] = cell, max(1, -(-n // most))
        if count[p] > 1:
            cell, held = cell + count[p], 0
        else:
            held += n
    return first, count


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    max_sample_rows: int = MAX_SAMPLE_ROWS,
    n_parts: int | None = None,
    recall_target: float = RECALL_TARGET,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that is_query holds for."""
    spark = vectors.sparkSession
    fields = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("q"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], fields)
    rows = rows.where(F.size("vector") == sizes["d"])
    # a bounded sample: a hash of the row decides; about sample_rows rows, never over twice as many
    sample_rows = max(sample_rows, min(max_sample_rows, sizes["n"] // SAMPLE_SHARE))
    share = min(1.0, sample_rows / sizes["n"])
    chosen = F.pmod(F.xxhash64("id", "vector", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) if share < 1 else F.lit(True)
    sample = rows.where(chosen).select("vector", F.xxhash64("id", "vector").alias("h")).limit(2 * sample_rows).toPandas().sort_values("h")
    router = fit(_matrix(sample["vector"]), k=k, n_parts=n_parts, recall_target=recall_target) if len(sample) else None
    if router is None:
        router = Router(np.zeros((sizes["d"], 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    sent = spark.sparkContext.broadcast(router)

    def flat(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            part = sent.value.parts(flat(batch), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part)], names=["id", "vector", "part"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            own = []
            for parts in sent.value.parts(flat(batch), sent.value.probes):
                own.append(sorted({c for p in parts for c in range(first[p], first[p] + count[p])}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["id", "vector", "cells"])

    members = rows.select("id", "vector").mapInArrow(home, "id long, vector array<double>, part int")
    sizes = {r["part"]: r["n"] for r in members.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a part
    first, count = cells([sizes.get(p, 0) for p in range(router.n_parts)], block_rows)
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    salt = lambda n: F.pmod(F.xxhash64("id", "vector", F.lit(3)), n.cast("long")).cast("int")
    members = members.withColumn("cell", at(first) + salt(at(count)))
    # a query goes once to each cell that holds rows of its parts, whatever their number there
    asked = rows.where("q").groupBy("id").agg(F.min("vector").alias("vector")).mapInArrow(ask, "id long, vector array<double>, cells array<int>")
    asked = asked.select("id", "vector", F.explode("cells").alias("cell"))
    n_asked = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a number a cell
    blocks = F.broadcast(spark.createDataFrame([(int(c), max(1, -(-n // query_rows))) for c, n in n_asked.items()], "cell int, blocks int"))
    left = asked.join(blocks, "cell").withColumn("qb", salt(F.col("blocks")))
    right = members.join(blocks, "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (
        left.select("id", "vector", "cell", "qb").groupBy("cell", "qb")
        .cogroup(right.select("id", "vector", "part", "cell", "qb").groupBy("cell", "qb"))
        .applyInPandas(lambda a, b: best_of_cell(a, b, k, sent.value), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
