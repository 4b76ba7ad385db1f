import hashlib

import pytest

from treeloom.llm import bpe

VOCAB, PATTERN = bpe.public_vocab()


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.read_vocab(VOCAB), PATTERN)


TEXTS = [
    None,
    "",
    "a",
    "it's  two   spaces\n\n\tand 123 çà été ½ 汉字 <|endoftext|>",
    "word " * 60,
    "x" * 400,
    " " * 300 + "y",
    "don't " * 30 + " " * 90 + "é" * 120 + "  tail  ",
    "word " * 60,
]


def expected(own, t):
    ids = own.encoding.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 8), (50, 20), (100_000, 64)])
def test_chunked_equals_whole(spark, own, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again"), (None, TEXTS[7], "x")], "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, VOCAB, PATTERN, output="digests", chunk_chars=chunk, overlap_chars=overlap).collect()
    want = [(i, *expected(own, t)) for i, t in enumerate(TEXTS)] + [(4, *expected(own, TEXTS[4])), (None, *expected(own, TEXTS[7]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_ids_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = bpe.encode_documents(docs, VOCAB, PATTERN, chunk_chars=30, overlap_chars=15)
    back = dict(bpe.decode_documents(ids, VOCAB, PATTERN).collect())
    assert {k: bytes(v).decode() for k, v in back.items()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, VOCAB, PATTERN).collect() == []


def test_registered_query_and_small_chunks_on_sample_documents(spark, own):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = sorted((i, *expected(own, t)) for i, t in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, bpe.op7_bpe_round_trip(spark, d).collect())) == want
    assert sorted(map(tuple, bpe.encode_documents(docs, VOCAB, PATTERN, output="digests", chunk_chars=700, overlap_chars=150).collect())) == want


def test_long_white_space(own):
    t = "a" + " " * (bpe.LONG_SPACE + 5) + "b"
    assert own.decode(own.encode(t)) == t.encode()
    assert own.encode(t) == own.encoding.encode_ordinary(t)


def test_white_space_across_a_chunk_edge(spark, own):
    gaps = ["\n\n", "\n\t", "\n\n\n", " \n\n", "\t "]
    texts = ["ab cd " * 4 + "e" * k + g + "fg hi " * 8 for k in range(24) for g in gaps]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(bpe.encode_documents(docs, VOCAB, PATTERN, chunk_chars=32, overlap_chars=16).collect())
    assert got == {i: own.encoding.encode_ordinary(t) for i, t in enumerate(texts)}
