"""SimHash near-dedup by multi-index hashing.

Fingerprints: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, three-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42; a bit is set if it is set in over half of the hashes.

Links join fingerprints that differ in two bits at most. Only distinct fingerprints are compared. Each is cut into a high and
a low 32-bit segment. Two bits can fall (0, 2), (2, 0) or (1, 1) on the segments, so a small Hamming ball of the high
segment (radius one; only unset bits are flipped, as the partner flips the others) and the segments themselves are looked
up, and complete distances are verified. A segment value that many distinct fingerprints share would give pairs in the
square of its size; there the ball of the other segment is enumerated instead and whole fingerprints are looked up, so the
work stays linear in the bucket and no link is lost.

Defined cases: a null text counts as empty; all empty texts share fingerprint zero, which links like any other. A null id
never names a component unless every id in it is null. Texts may be of any length. Repeated rows give a row each; an empty table
gives none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import bound_batches, materialize, shuffled, slices, table, unwrapped, whole_rows
from treeloom.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Beyond so many distinct fingerprints in a bucket, enumerating a ball costs less than comparing all of them.
LARGE_BUCKET = 256
_ROWS = 255  # so many 0/1 rows add up in a byte


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    step = _ROWS * 256
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        pad = -len(part) % _ROWS
        if pad:
            part = np.concatenate([part, np.zeros(pad, np.uint64)])
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, _ROWS, 64)
        counts += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - SHINGLE_WORDS + 1)
    on = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(_fingerprints, f"id {kind}, fp long")


def _ball(bits: range, radius: int) -> list[int]:
    """Masks of 1 to radius of the bits."""
    ones = [1 << b for b in bits]
    masks = list(ones)
    if radius > 1:
        masks += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _masks(masks: list[int]):
    return F.array(*[F.lit(m).cast("long") for m in masks])


def links(fps: DataFrame, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct longs in fps.fp that differ in one or two bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = lambda: F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key"))
    )
    tables = fps.select("fp", F.explode(segments()).alias("s")).select("s.seg", "s.key", F.col("fp").alias("other"))
    sizes = tables.groupBy("seg", "key").agg(F.count("*").alias("n"))
    flips = F.transform(
        F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(32)]), lambda m: high.bitwiseAND(m) == 0),
        lambda m: F.struct(F.lit(0).alias("seg"), high.bitwiseOR(m).alias("key"), m.alias("flip")),
    )
    exact = F.transform(segments(), lambda s: F.struct(s["seg"].alias("seg"), s["key"].alias("key"), F.lit(0).cast("long").alias("flip")))
    probes = fps.select("fp", F.explode(F.concat(exact, flips)).alias("p")).select("fp", "p.seg", "p.key", "p.flip")
    # a bucket of one holds the fingerprint itself only, unless the key is flipped
    met = probes.join(shuffled(sizes.where("n > 1").unionByName(sizes.where("n = 1 AND seg = 0"))), ["seg", "key"]).where("n > 1 OR flip <> 0")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    small = met.where(F.col("n") <= large_bucket).join(shuffled(tables), ["seg", "key"])
    small = small.where((near <= MAX_DISTANCE) & (near > 0) & ((F.col("flip") != 0) | (F.col("fp") < F.col("other"))))
    small = small.select("fp", "other")

    low1, low2, high2 = _ball(range(32), 1), _ball(range(32), 2), _ball(range(32, 64), 2)
    ball = F.when(F.col("flip") != 0, _masks(low1)).when(F.col("seg") == 0, _masks(low2)).otherwise(_masks(high2))
    start = F.col("fp").bitwiseXOR(F.shiftleft(F.col("flip"), 32))
    large = met.where(F.col("n") > large_bucket).select("fp", "flip", start.alias("start"), F.explode(ball).alias("mask"))
    large = large.select("fp", "flip", F.col("start").bitwiseXOR(F.col("mask")).alias("other"))
    large = large.where("flip <> 0 OR fp < other").select("fp", "other")
    large = large.join(shuffled(fps.select(F.col("fp").alias("other"))), "other", "left_semi").select("fp", "other")
    return small.unionByName(large).select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def _components(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct rows.fp; root is the component's own fingerprint, whatever ids it has."""
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(links(fps.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(shuffled(roots), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    return rooted.join(shuffled(named), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id that links reach, itself included) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    out = rows.join(shuffled(_components(rows).drop("root")), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component one row with the smallest id, nulls last.

    Components are told apart by their fingerprints, so rows of different components that share an id, or have none, all stay,
    as does a row of each component whatever its text or other columns (whose names are free). Of different texts under a
    component's smallest id the one with the smallest MD5 stays, of equal rows one. An empty table stays empty.

    Rows are written with a number of their own, which settles between equal rows. Texts meet the numbers of the rows that go, which are the
    fewer ones: they are broadcast where Spark finds them small, else texts are shuffled once.
    """
    no_id = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    key = F.md5(F.concat_ws("/", no_id, F.coalesce(F.md5(text_col), F.lit("-"))))
    stored = materialize(whole_rows(docs, key.alias("key")).withColumn("at", F.monotonically_increasing_id()), "simhash-rows")
    own = lambda c, name: F.col("row").getField(c).alias(name)
    rows = stored.select(F.struct(own(id_col, "id"), "key", "at").alias("both"), own(text_col, "text"))
    rows = materialize(fingerprints(rows, "both", "text").select("id.id", "id.key", "id.at", "fp"), "simhash")
    least = rows.join(shuffled(_components(rows)), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = materialize(least.groupBy("root").agg(F.min(F.struct("key", "at")).alias("first")).select("first.at"), "simhash-kept")
    gone = materialize(rows.select("at").join(shuffled(kept), "at", "left_anti"), "simhash-gone")
    return unwrapped(stored.select("row", "at").join(gone, "at", "left_anti"), docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
