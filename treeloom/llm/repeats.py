"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers.

A string of 400 bytes is repeated if it also starts anywhere else in any text. Sorting every suffix of a corpus would move many
times its size, so suffixes are narrowed down first, without loss:

1. Anchors. Each 400-byte window picks the 200-byte gram with the least hash inside it; windows next to each other that pick the
   same one form a run. Equal windows pick the same gram at the same offset, so only runs with equal anchors can repeat
   each other. One partial aggregate per anchor tells anchors seen once (nothing repeats) and anchors whose runs are all equal
   (everything repeats) from mixed ones; runs of mixed anchors that have an equal run elsewhere are settled likewise.
2. Blocks. What is left are the runs at the ends of copies; one run of each settled class stays as a witness. Their windows are cut
   into blocks of 8 by their offset from the anchor. Windows of a block share 393 bytes, its core, so a block whose core is met
   nowhere else has no repeated window.
3. Suffixes. The windows of the other blocks are sorted as suffixes within each task (`suffixes.suffix_order`): neighbours
   that share 400 bytes, verified byte by byte, are repeats. The tasks' sorted classes then merge by their digests.
4. The repeated windows come back to their documents, whose bytes are cut.

Strings can be counted in words instead (`Unit`): a text is then the sequence of its words' 64-bit hashes, and all of the above holds
for these. A passage of 50 words often has under 400 bytes, so the removal of 400-byte strings leaves it; the query reports
such passages as n_passage_words and removes what its contract says.

Skew: counts are partial aggregates. They are written before they are joined back, so that both sides of the join are plain
shuffles and Spark can split a hot key's rows against its one count; no group of equal strings is ever gathered. Texts are
compressed before they are shuffled to their spans.

Verification: polynomial hashes only propose. Runs count as equal, and windows of different tasks, if 128-bit BLAKE2b digests of
their bytes agree; windows within a task are compared byte by byte.

Defined cases: null and empty texts, and those of under `length` bytes, lose nothing. Repeated rows repeat each other, so all of
their bytes go if there are `length` of them; no occurrence is preferred, so there are no ties. Texts may be of any length. Rows
that share an id, or have none, are told apart by hashes of their texts (64 bits beside an id, 128 without). An empty table
gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import bound_batches, delete_path, materialize, slices, table, work_path
from treeloom.llm.suffixes import Buffer, equal_neighbours, mix, suffix_order

LENGTH = 400
#: Words of a string that the query reports as a repeated passage, whatever its bytes.
PASSAGE_WORDS = 50
PIECE_BYTES = 1 << 18
BLOCK_WINDOWS = 8
_PLACE_BITS = 24


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each value's bounds in them (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, words being what white space parts."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a string column as hashes, and each value's bounds in them."""
    parts = [word_codes(t.as_buffer().to_pybytes()) if t.is_valid else np.zeros(0, np.uint64) for t in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


@dataclass(frozen=True)
class Unit:
    """What strings are made of: how a column and a text become arrays, and the least bytes of a text with so many."""

    column: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    array: Callable[[bytes], np.ndarray]
    least_bytes: Callable[[int], int]


UNITS = {
    "bytes": Unit(_utf8, lambda t: np.frombuffer(t, np.uint8), lambda n: n),
    "words": Unit(_codes, word_codes, lambda n: 2 * n - 1),
}


def pieces(bounds: np.ndarray, length: int, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): whole rows up to about size bytes, or parts of a long row.

    Parts of a row overlap by length - 1 bytes, so that every window lies in exactly one part.
    """
    row, n = 0, len(bounds) - 1
    while row < n:
        if bounds[row + 1] - bounds[row] > size:
            for at in range(int(bounds[row]), int(bounds[row + 1]) - length + 1, size):
                yield row, row + 1, at, min(at + size + length - 1, int(bounds[row + 1]))
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        if bounds[last] - bounds[row] > size and last > row + 1:
            last -= 1
        yield row, last, int(bounds[row]), int(bounds[last])
        row = last


def least_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of each n hashes in a row, the first of equal ones."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    now = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= n:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    if width < n:
        now = np.minimum(now[: len(now) - (n - width)], now[n - width :])
    return (now & mask).astype(np.int64)


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """128-bit BLAKE2b digests, two 64-bit columns, of the bytes from each begin to its end and of the number that goes with them."""
    raw, make, w = data.tobytes(), hashlib.blake2b, data.itemsize
    found = [make(raw[a:b], digest_size=16).digest() for a, b in zip((begin * w).tolist(), (end * w).tolist(), strict=True)]
    out = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    if extra is None:
        return out
    # mix is a bijection: of equal bytes, digests with other numbers differ; of other bytes they are no likelier to agree than without
    return np.stack([out[:, 0] ^ mix(extra.astype(np.uint64) + np.uint64(1)), out[:, 1]], axis=1)


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, anchor hash, digest, digest) of every run; places count from their row's start.

    The digest covers all bytes of the run's windows, their number and the anchor's place among them.
    """
    k = length // 2
    found = []
    for r0, r1, b0, b1 in pieces(bounds, length, PIECE_BYTES // data.itemsize):
        part = data[b0:b1]
        if len(part) < length:
            continue
        buffer = Buffer(part)
        hashes = buffer.gram_hashes(k)
        least = least_grams(hashes, length - k + 1)
        ends = np.minimum(bounds[r0 + 1 : r1 + 1], b1) - b0
        begins = np.maximum(bounds[r0:r1], b0) - b0
        there = np.zeros(len(least) + 1, np.int64)
        fits = ends - begins >= length
        np.add.at(there, begins[fits], 1)
        np.add.at(there, ends[fits] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(there)[:-1] > 0)
        if not len(at):
            continue
        anchor = least[at]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        low, high, anchor = at[first], at[last], anchor[first]
        row = r0 + np.searchsorted(bounds[r0 + 1 : r1 + 1] - b0, low, "right")
        whole = digests(part, low, high + length, anchor - low)
        shift = b0 - bounds[row]
        found.append((row, low + shift, high + shift, anchor + shift, hashes[anchor], whole[:, 0], whole[:, 1]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1 and k2 name a row, or rows that repeat it: the id (or its hash) and a hash of the text; two hashes where the id is null."""
    one = F.col(id_col).cast("long") if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") else F.xxhash64(id_col)
    no_id = F.col(id_col).isNull()
    keys = F.when(no_id, F.xxhash64(F.lit(1), text_col)).otherwise(one).alias("k1"), F.xxhash64(no_id, text_col).alias("k2")
    return docs.select(*keys, F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        packed = [pack.compress(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["k1", "k2", "id", "packed"])


def _unpack(packed: bytes) -> bytes:
    """A text's bytes, compressed or not: no UTF-8 begins as a compressed text does."""
    return zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(b"\x28\xb5\x2f\xfd") else packed


def _spread(sorted_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(sorted_places) != 1)
    return sorted_places[np.r_[0, breaks + 1]], sorted_places[np.r_[breaks, len(sorted_places) - 1]]


def sorted_windows(texts: list[np.ndarray], of: np.ndarray, spans: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Sorts the suffixes at the windows of spans, each of a text by its number; (text, first, last, w1, w2, kind) rows.

    kind 0: a window met once here; 1: one of a class met before or of a witness, which others may match; 2: windows
    from first to last, settled here as they repeat each other.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.r_[0, np.cumsum(sizes)]
    buffer = Buffer(np.concatenate(texts))
    n = spans["high"] - spans["low"] + 1
    starts = np.repeat(spans["low"] + bounds[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
    owner, witness = np.repeat(of, n), np.repeat(spans["witness"], n)
    by_place = np.argsort(starts, kind="stable")
    starts, owner, witness = starts[by_place], owner[by_place], witness[by_place]
    order = suffix_order(buffer, starts, length)
    at = np.searchsorted(starts, order)
    new = np.r_[True, ~equal_neighbours(buffer, order, length)]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    heads = order[new]
    once = (count == 1) & ~np.bincount(group, witness[at]).astype(bool)
    kind = np.where(once, 0, 1)
    w1, w2 = digests(buffer.data, heads, heads + length).T
    text = owner[at[new]]
    place = heads - bounds[text]
    out = [(text, place, place, w1, w2, kind)]
    settled = np.sort(order[(count[group] > 1) & ~witness[at]])
    if len(settled):
        low, high = _spread(settled)
        text = np.searchsorted(bounds, low, "right") - 1
        none = np.zeros(len(low), np.uint64)
        out.append((text, low - bounds[text], high - bounds[text], none, none, np.full(len(low), 2)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def window_rows(texts: list[np.ndarray], spans: list[list[dict]], length: int) -> tuple[np.ndarray, ...]:
    """sorted_windows of spans that are Python objects, a list for each text."""
    fields = {k: np.array([s[k] for own in spans for s in own], kind) for k, kind in (("low", np.int64), ("high", np.int64), ("witness", bool))}
    return sorted_windows(texts, np.repeat(np.arange(len(spans)), [len(own) for own in spans]), fields, length)


def block_rows(texts: list[np.ndarray], text: np.ndarray, spans: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, witness, core hash) of each block of the spans' windows."""
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    buffer = Buffer(np.concatenate(texts))
    low, high, anchor, witness = (spans[k] for k in ("low", "high", "anchor", "witness"))
    # blocks count from the anchor backwards: the last window of a span is in its first block
    first, last = (anchor - high) // BLOCK_WINDOWS, (anchor - low) // BLOCK_WINDOWS
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    block = first[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    core = anchor[of] - block * BLOCK_WINDOWS
    begin = np.maximum(core - BLOCK_WINDOWS + 1, low[of])
    hashes = buffer.hash(core + bounds[text[of]], length - BLOCK_WINDOWS + 1)
    return text[of], begin, np.minimum(core, high[of]), witness[of], hashes


_PLACE = "k1 long, k2 long, low int, high int"


def _batched(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, dict[str, np.ndarray]]]:
    """(first row, texts, the text of each span, fields of the spans) of about a piece of bytes each."""
    lists = batch.column(2)
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    flat = lists.flatten()
    fields = {f.name: pc.struct_field(flat, f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    fields = {k: v.astype(bool if k == "witness" else np.int64) for k, v in fields.items()}

    def spans(first: int, last: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), {k: v[ends[first] : ends[last]] for k, v in fields.items()}

    texts, first, weight = [], 0, 0
    for at in range(batch.num_rows):
        texts.append(unit.array(_unpack(batch.column(3)[at].as_py())))
        weight += texts[-1].nbytes
        if weight >= PIECE_BYTES:
            yield first, texts, *spans(first, at + 1)
            texts, first, weight = [], at + 1, 0
    if texts:
        yield first, texts, *spans(first, batch.num_rows)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _with_text(keyed: DataFrame, spans: DataFrame, least_bytes: int) -> DataFrame:
    """k1, k2, spans, packed: each document's spans with its text; spans is written already."""
    by_doc = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct(*[c for c in spans.columns if c not in ("k1", "k2")])).alias("spans"))
    long = keyed.where(F.octet_length("text") >= least_bytes).select("k1", "k2", F.lit(0).alias("id"), "text")
    fields = "k1 long, k2 long, id int, packed binary"
    return long.mapInArrow(_pack, fields).join(by_doc, ["k1", "k2"]).select("k1", "k2", "spans", "packed")


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes") -> DataFrame:
    """(k1, k2, low, high): the starts, from low to high, of repeated windows of each document, counted in bytes or words."""
    of = UNITS[unit]
    least_bytes = of.least_bytes(length)
    bound_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = of.column(batch.column(2))
            row, low, high, place, anchor, d1, d2 = runs(data, bounds, length)
            keys = [c.take(pa.array(row)) for c in batch.columns[:2]]
            values = [*keys, _ints(low), _ints(high), _ints(place), _signed(anchor), _signed(d1), _signed(d2)]
            yield pa.RecordBatch.from_arrays(values, names=["k1", "k2", "low", "high", "place", "anchor", "d1", "d2"])

    able = keyed.select("k1", "k2", "text").where(F.octet_length("text") >= least_bytes)
    # runs are found once and written, as they are counted and then met with the counts; they go as soon as the shared ones are written
    path = work_path(docs.sparkSession, "repeats-runs")
    found = able.mapInArrow(find_runs, f"{_PLACE}, place int, anchor long, d1 long, d2 long")
    found.write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    ends = [f(c).alias(n + c) for c in ("d1", "d2") for f, n in ((F.min, "least_"), (F.max, "most_"))]
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), *ends)
    mixed_up = (F.col("least_d1") != F.col("most_d1")) | (F.col("least_d2") != F.col("most_d2"))
    anchors = materialize(anchors.where("n > 1").select("anchor", mixed_up.alias("mixed")), "repeats-anchors")
    shared = materialize(found.join(anchors, "anchor"), "repeats-shared")
    delete_path(docs.sparkSession, path)
    plain = shared.where(~F.col("mixed")).select("k1", "k2", "low", "high")

    mixed = shared.where("mixed")
    classes = mixed.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "low")).alias("first"))
    classes = materialize(classes.where("n > 1").select("anchor", "d1", "d2", "first"), "repeats-classes")
    settled = mixed.join(classes, ["anchor", "d1", "d2"], "left")
    alone = F.col("first").isNull()
    is_first = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("low") == F.col("first.low"))
    settled = materialize(settled.select("k1", "k2", "low", "high", "place", (~alone).alias("witness"), (alone | is_first).alias("open")), "repeats-mixed")
    equal = settled.where("witness").select("k1", "k2", "low", "high")
    due = settled.where("open").select("k1", "k2", "low", "high", F.col("place").alias("anchor"), "witness")

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, owner, spans in _batched(batch, of):
                text, low, high, witness, core = block_rows(texts, owner, spans, length)
                keys = [c.take(pa.array(text + first)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, _ints(low), _ints(high), pa.array(witness), _signed(core)], names=["k1", "k2", "low", "high", "witness", "core"])

    blocks = materialize(_with_text(keyed, due, least_bytes).mapInArrow(cut_blocks, f"{_PLACE}, witness boolean, core long"), "repeats-blocks")
    cores = materialize(blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "repeats-cores")
    near = materialize(blocks.join(cores, "core", "left_semi").select("k1", "k2", "low", "high", "witness"), "repeats-near")

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, owner, spans in _batched(batch, of):
                text, low, high, w1, w2, kind = sorted_windows(texts, owner, spans, length)
                keys = [c.take(pa.array(text + first)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, _ints(low), _ints(high), _signed(w1), _signed(w2), _ints(kind)], names=["k1", "k2", "low", "high", "w1", "w2", "kind"])

    windows = materialize(_with_text(keyed, near, least_bytes).mapInArrow(sort_windows, f"{_PLACE}, w1 long, w2 long, kind int"), "repeats-windows")
    here = windows.where("kind = 2").select("k1", "k2", "low", "high")
    met = windows.where("kind < 2").groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    met = materialize(met, "repeats-met")
    across = windows.where("kind = 0").join(met, ["w1", "w2"], "left_semi").select("k1", "k2", "low", "high")
    return plain.unionByName(equal).unionByName(here).unionByName(across)


def cut(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept); spans are first and last starts of windows."""
    if not spans:
        return 0, 0, text
    removed = n = 0
    kept, at = [], 0
    for low, high in sorted(spans):
        begin, end = low, high + length
        if n and begin <= at:  # touches the run before
            if end > at:
                removed += end - at
                at = end
            continue
        kept.append(text[at:begin])
        removed += end - begin
        n += 1
        at = end
    kept.append(text[at:])
    return removed, n, b"".join(kept)


def covered(low: np.ndarray, high: np.ndarray, length: int) -> int:
    """How many places the windows that start from each low to its high cover."""
    total = at = 0
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        total += max(0, b + length - max(a, at))
        at = max(at, b + length)
    return total


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, passage_words: int | None = None
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) or with digest kept_sha256, and n_kept of every row.

    passage_words: also n_passage_words, the words within strings of so many words that start anywhere else, too; null without it.
    They are counted only: passages shorter than `length` bytes stay in the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_windows(docs, length, id_col, text_col).withColumn("words", F.lit(False))
    if passage_words:
        spans = spans.unionByName(repeated_windows(docs, passage_words, id_col, text_col, "words").withColumn("words", F.lit(True)))
    by_doc = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("words", "low", "high")).alias("spans"))
    packed = _keyed(docs, id_col, text_col).mapInArrow(_pack, f"k1 long, k2 long, id {kind}, packed binary")
    last, last_type = ("kept_sha256 string", pa.string()) if digest else ("kept binary", pa.binary())
    fields = f"n_bytes long, n_removed long, n_spans long, {last}, n_kept long, n_passage_words long"
    names = [x.split()[0] for x in fields.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            lists = batch.column(2).fill_null([])
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
            words, low, high = (pc.struct_field(lists.flatten(), k).to_numpy(zero_copy_only=False) for k in ("words", "low", "high"))
            words = words.astype(bool)
            for i in range(batch.num_rows):
                text, own = _unpack(batch.column(1)[i].as_py()), slice(ends[i], ends[i + 1])
                as_bytes, as_words = (np.flatnonzero(words[own] == w) + ends[i] for w in (False, True))
                removed, n, kept = cut(text, list(zip(low[as_bytes].tolist(), high[as_bytes].tolist(), strict=True)), length)
                passages = covered(low[as_words], high[as_words], passage_words) if passage_words else None
                rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest() if digest else kept, len(kept), passages))
            types = [pa.int64(), pa.int64(), pa.int64(), last_type, pa.int64(), pa.int64()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    joined = packed.join(by_doc, ["k1", "k2"], "left").select("id", "packed", "spans")
    return joined.mapInArrow(finish, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True, passage_words=PASSAGE_WORDS)
