"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own start.
Where two neighbours' pre-token boundaries meet inside their overlap they have resynchronised: from there on both see the same
pre-tokens, so the texts between such cuts can be encoded apart and their ids concatenated. A text some of whose neighbours
never meet (a pre-token longer than the overlap) is encoded whole. A piece is pre-tokenised again without what follows it, and
patterns look ahead behind white space only (`\\s+(?!\\S)`), so texts are never cut behind white space. A text of one chunk is the
case without a cut. Decoding concatenates the tokens' raw bytes.

Defined cases: a null text counts as empty and has no ids. Repeated rows give a row each. Null ids are kept. An empty table gives
no rows. A text's ids are put together in one task, so texts may be as long as a task's memory holds. Other columns, whatever
their names, are ignored. Special tokens are never recognised: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import bound_batches, materialize, slices, table

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 1_024
#: White space of this length is pre-tokenised by the regex module.
LONG_SPACE = 10_000
_long_space = re.compile(r"\s{%d}" % LONG_SPACE)
_encoders: dict[str, Codec] = {}


class Codec:
    """Ranks and pattern of one vocabulary."""

    def __init__(self, vocab: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.packed = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _long_space.search(text):  # the library's matcher overflows its stack on such runs
            return [i for m in self.pattern.finditer(text) for i in self.encoding._encode_single_piece(m[0])]
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens that end before the text does, so that no later text could change them."""
        return [m.end() for m in self.pattern.finditer(text) if m.end() < len(text)]


def codec(vocab: bytes, pattern: str) -> Codec:
    """The worker's own codec for a vocabulary; built once."""
    key = hashlib.sha1(vocab + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Codec(vocab, pattern)
    return _encoders[key]


def read_vocab(path: str) -> bytes:
    """A rank file's bytes: some hundred kilobytes, read on the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()


def _pack(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8", "surrogatepass"))


def _unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def _digests(ids: list[int], own: Codec) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


_OUT = {
    "full": ("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]),
    "ids": ("ids array<int>", [pa.list_(pa.int32())]),
    "digests": ("n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()]),
}


def encode_documents(
    docs: DataFrame,
    vocab_path: str,
    pattern: str,
    *,
    output: str = "ids",
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """The id column and, by output (ids, digests, full), ids array<int>, or n_tokens, ids_sha256 and decoded_sha256, or both, of every row."""
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    vocab = spark.sparkContext.broadcast(read_vocab(vocab_path))
    kind = docs.schema[id_col].dataType.simpleString()
    fields, types = _OUT[output]
    names = [x.split()[0] for x in fields.split(", ")]
    shape = {"ids": lambda ids, own: (ids,), "digests": _digests, "full": lambda ids, own: (ids, *_digests(ids, own))}[output]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            made = [shape(own.encode(t.as_py() or ""), own) for t in batch.column(1)]
            cols = [pa.array([m[k] for m in made], types[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short_out = rows.where(~long).mapInArrow(whole, f"id {kind}, {fields}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                text = row["text"]
                key = hashlib.md5(f"{row['id']}\0".encode() + text.encode("utf-8", "surrogatepass")).hexdigest()
                n = -(-len(text) // chunk_chars)
                for i in range(n):
                    at = i * chunk_chars
                    piece = pa.array([_pack(text[at : at + chunk_chars + overlap_chars])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([row["id"]], batch.schema.field("id").type), piece],
                        names=["key", "i", "n", "id", "packed"],
                    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            heads, tails = [], []
            for i, packed in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text = _unpack(packed)
                ends = own.boundaries(text)
                heads.append([i * chunk_chars + e for e in ends if e <= overlap_chars])
                tails.append([i * chunk_chars + e for e in ends if e > chunk_chars and not text[e - 1].isspace()])
            more = [pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "head", "tail"])

    chunk_fields = f"key string, i int, n int, id {kind}, packed binary"
    # one shuffle spreads the chunks and counts repeated rows once
    chunks = rows.where(long).mapInArrow(cut, chunk_fields).groupBy("key", "i", "n", "id", "packed").agg(F.count("*").alias("times"))
    chunks = chunks.mapInArrow(pretokenise, f"{chunk_fields}, times long, head array<long>, tail array<long>")
    chunks = materialize(chunks, "bpe-chunks")

    heads = chunks.where("i > 0").select("key", (F.col("i") - 1).alias("i"), "head")
    met = chunks.select("key", "i", "n", "tail").join(heads, ["key", "i"], "left")
    met = met.select("key", "i", "n", F.array_min(F.array_intersect("tail", "head")).alias("to"))
    lost = met.where("to IS NULL AND i < n - 1").select("key").distinct()
    ends = met.select("key", "i", "to")
    starts = met.select("key", (F.col("i") + 1).alias("i"), F.col("to").alias("from"))
    pieces = chunks.drop("head", "tail").join(lost, "key", "left_anti").join(ends, ["key", "i"]).join(starts, ["key", "i"], "left")
    at = F.col("i").cast("long") * chunk_chars
    pieces = pieces.select("key", "i", "times", "id", "packed", (F.coalesce("from", F.lit(0)) - at).alias("from"), (F.col("to") - at).alias("to"))

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            cuts = zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)
            ids = pa.array([np.array(own.encode(_unpack(t)[a:b]), own.packed).tobytes() for t, a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], names=["key", "i", "times", "id", "ids"])

    ids = pieces.mapInArrow(encode_pieces, f"key string, i int, times long, id {kind}, ids binary")
    in_order = F.array_sort(F.collect_list(F.struct("i", "ids")))
    stitched = ids.groupBy("key").agg(F.first("id").alias("id"), F.first("times").alias("times"), in_order.alias("parts"))
    stitched = stitched.select("id", "times", F.col("parts.ids").alias("ids"))

    parts = F.array_sort(F.collect_list(F.struct("i", "packed")))
    joined = chunks.join(lost, "key", "left_semi").groupBy("key").agg(F.first("id").alias("id"), F.first("times").alias("times"), parts.alias("parts"))
    joined = joined.select("id", "times", F.col("parts.packed").alias("parts"))

    def shaped(batch: pa.RecordBatch, ids: Iterator[list[int]], own: Codec) -> pa.RecordBatch:
        made = [shape(i, own) for i in ids]
        cols = [pa.array([m[k] for m in made], types[k]) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["id", "times", *names])

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            texts = ("".join([*(_unpack(p)[:chunk_chars] for p in parts[:-1]), _unpack(parts[-1])]) for parts in batch.column(2).to_pylist())
            yield shaped(batch, (own.encode(t) for t in texts), own)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            yield shaped(batch, (np.frombuffer(b"".join(parts), own.packed).tolist() for parts in batch.column(2).to_pylist()), own)

    long_fields = f"id {kind}, times long, {fields}"
    long_out = stitched.mapInArrow(finish, long_fields).unionByName(joined.mapInArrow(encode_whole, long_fields))
    long_out = long_out.select("id", *names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("col")
    return short_out.unionByName(long_out).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocab_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and decoded (binary): the concatenated bytes of ids array<int>; null or empty ids give no bytes."""
    vocab = encoded.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab.value, pattern)
        for batch in slices(batches):
            made = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "decoded"])

    two = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return two.mapInArrow(decode, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def public_vocab() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_vocab(), output="digests")
