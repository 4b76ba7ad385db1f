"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased and cut into words (runs of letters, digits and underscores); shingles are sets of five words (a text of
one to four words has one shingle, its whole sequence; a text without words none). A document contains an item if it holds at
least `threshold` of the item's shingles.

Items are partitioned by their number of shingles (powers of two). A partition's items are indexed by their smallest MinHash
values, as many as the partition's size needs: an item of n shingles that shares ceil(t n) with a document misses n - ceil(t n) at
most, so of its n - ceil(t n) + 1 smallest values one at least is among the document's. The candidate search is therefore
complete whatever the document's length. A document with fewer than t times a partition's least size skips the partition.
Candidates are verified by their exact shared shingles, compared as text.

The index is a table, a row a shingle. One pass over the documents lets through the shingles that a blocked Bloom filter of the
index knows; its size follows the index up to `max_blocks` blocks of 32 bytes, beyond which only more shingles pass for nothing.
What passes is written and joined with the index by hash: first with the indexed MinHash values, which gives candidates, then with
all shingles, which counts what candidates share. Both joins are plain, so Spark broadcasts a small index and splits a shingle
that very many documents hold; nothing is gathered by document or by item.

Defined cases: null texts have no shingles, contain nothing and are contained nowhere. Texts may be of any length. Repeated rows
of either side give a row each, as do several items in one document, in no order. An empty side gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from treeloom.llm.common import bound_batches, materialize, slices, table, unwrapped, whole_rows

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20
SEED = 7
_words = re.compile(r"\w+").findall


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> set[str]:
    words = _words((text or "").lower())
    if not words:
        return set()
    if len(words) < k:
        return {" ".join(words)}
    return set(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def short_runs(text: str | None, lengths: set[int]) -> set[str]:
    """The text's runs of so many words each."""
    words = _words((text or "").lower()) if lengths else []
    return {" ".join(words[i : i + k]) for k in lengths for i in range(len(words) - k + 1)}


def needed(n: int, threshold: float) -> int:
    """The least number of shared shingles of n that reaches the threshold."""
    return max(1, -int(-(n * threshold - 1e-9) // 1))


def _value(shingle: str) -> int:
    return xxhash.xxh64_intdigest(shingle.encode("utf-8", "surrogatepass"), SEED)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, str | None]]:
    """(a number of its own in the table, id, text) of each row."""
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield row, key, text
            row += 1


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _table(df: DataFrame, make, key_name: str, more: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """The rows that make(numbered rows) yields: row, the key column and more."""
    kind, key_type = df.schema["id"].dataType.simpleString(), to_arrow_type(df.schema["id"].dataType)
    columns = [("row", "long", pa.int64()), (key_name, kind, key_type), *more]
    types, names = [c[2] for c in columns], [c[0] for c in columns]
    return df.mapInArrow(lambda batches: _batches(make(_numbered(batches)), types, names), ", ".join(f"{c[0]} {c[1]}" for c in columns))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_rows(key, parts: set[str], threshold: float) -> Iterator[tuple]:
    """(item, n_item, need, least, h, s, sketch) of an item's shingles: sketch marks those with the smallest MinHash values.

    need: shingles that a document has to share; least: those that it needs to be searched in the item's partition.
    """
    n = len(parts)
    if not n:
        return
    need = needed(n, threshold)
    least = needed(1 << (n.bit_length() - 1), threshold)
    for k, (h, s) in enumerate(sorted((_value(s), s) for s in parts)):
        yield key, n, need, least, signed(h), s, k <= n - need


def bloom_words(index: DataFrame, n_blocks: int) -> np.ndarray:
    """The blocked Bloom filter of index.h, four 64-bit words a block of which a value sets a bit each."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    blocks = index.groupBy(F.col("h").bitwiseAND(F.lit(n_blocks - 1)).alias("b")).agg(*[F.bit_or(bit(k)).alias(f"w{k}") for k in range(4)])
    found = blocks.toPandas()
    words = np.zeros((n_blocks, 4), np.uint64)
    words[found["b"].to_numpy()] = found[[f"w{k}" for k in range(4)]].to_numpy(np.int64).view(np.uint64)
    return words


def known(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the values that the filter lets through."""
    own = words[(h & np.uint64(len(words) - 1)).astype(np.int64)]
    shifts = (h[:, None] >> np.arange(40, 64, 6, dtype=np.uint64)) & np.uint64(63)
    return np.flatnonzero(((own >> shifts) & np.uint64(1)).all(axis=1))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_blocks: int = MAX_BLOCKS,
    short_inside: bool = False,
) -> DataFrame:
    """doc id, item id, n_shared, n_item of every document that contains an item.

    short_inside: items of under five words are searched for inside longer documents too, by the documents' runs of their
    length; else, as in OP5_SQL, they are found only in documents that are that sequence.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))

    def cut_items(rows):
        for row, key, text in rows:
            for found in index_rows(key, shingles(text), threshold):
                yield (row, *found)

    more = [(n, "long", pa.int64()) for n in ("n_item", "need", "least", "h")] + [("s", "string", pa.string()), ("sketch", "boolean", pa.bool_())]
    index = materialize(_table(wanted, cut_items, "item", more), "benchmark-index")
    n_words = F.size(F.split("s", " "))
    about = index.agg(F.count("*").alias("n"), F.collect_set(F.when(n_words < SHINGLE_WORDS, n_words)).alias("lengths")).first()
    n_blocks = min(max_blocks, 1 << max(0, (-(-about["n"] * BITS_PER_KEY // 256) - 1).bit_length()))
    sent = spark.sparkContext.broadcast(bloom_words(index, n_blocks))
    lengths = set(about["lengths"]) if short_inside else set()

    def search(rows):
        for row, key, text in rows:
            parts = list(shingles(text) | short_runs(text, lengths))
            h = np.fromiter(map(_value, parts), np.uint64, len(parts))
            for k in known(sent.value, h).tolist():
                yield row, key, len(parts), signed(int(h[k])), parts[k]

    hits = materialize(_table(two, search, "doc", [("n_doc", "long", pa.int64()), ("h", "long", pa.int64()), ("s", "string", pa.string())]), "benchmark-hits")
    hits = hits.withColumnRenamed("row", "doc_row")
    index = index.withColumnRenamed("row", "item_row")
    candidates = hits.select("doc_row", "n_doc", "h").join(index.where("sketch").select("item_row", "least", "h"), "h")
    candidates = candidates.where("n_doc >= least").select("doc_row", "item_row").distinct()
    # a shingle of many items meets those that its document may contain, not all of them
    shared = hits.join(candidates, "doc_row").join(index.drop("least", "sketch"), ["item_row", "h", "s"])
    one = [F.first(c).alias(c) for c in ("doc", "item", "n_item", "need")]
    found = shared.groupBy("doc_row", "item_row").agg(F.count("*").alias("n_shared"), *one).where("n_shared >= need")
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), "n_shared", "n_item")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, with all columns whatever their names, that contain no item. kw: as of contaminated.

    Rows that share an id, or have none, are judged by their own texts; null and empty texts stay, as does every row if there are no
    items. Repeated rows stay or go together.
    """
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))))
    found = contaminated(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, id_col="key", text_col="text", **kw)
    found = materialize(found.select("key").distinct(), "contaminated")
    return unwrapped(whole_rows(docs, key.alias("key")).join(found, "key", "left_anti"), docs.columns)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shingle_sql(name: str, source: str, key: str) -> str:
    return f"""
{name}_w AS (SELECT {key} AS k, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}),
{name} AS (
  SELECT DISTINCT r, k, s FROM (
    SELECT r, k, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' '))) AS s FROM {name}_w))"""


OP5_SQL = f"""
WITH {_shingle_sql("d", "documents", "doc_id")}, {_shingle_sql("b", "benchmark", "item_id")},
n AS (SELECT r, count(*) AS n_item FROM b GROUP BY r)
SELECT d.k AS doc_id, b.k AS item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM d JOIN b ON d.s = b.s JOIN n ON n.r = b.r
GROUP BY d.r, d.k, b.r, b.k
HAVING count(*) >= {THRESHOLD} * any_value(n.n_item) - 1e-9
"""
