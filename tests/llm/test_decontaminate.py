import random

import numpy as np
from pyspark.sql import functions as F

from treeloom.llm import decontaminate as d


def brute(docs, items, t=0.8):
    out = []
    for i, x in docs:
        for j, y in items:
            own, have = d.shingles(y), d.shingles(x)
            if own and len(own & have) >= t * len(own) - 1e-9:
                out.append((i, j, len(own & have), len(own)))
    return sorted(out, key=str)


def data():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, say(rng.randint(1, 60))) for k in range(25)] + [(90, None), (91, ""), (92, "..."), (3, "same id other text here now")]
    docs = [(k, say(rng.randint(0, 80))) for k in range(30)] + [(100, None), (101, ""), (102, "!!!")]
    for k, (_, text) in enumerate(items[:20]):
        words = text.split()
        edited = [w if rng.random() > 0.03 else "EDIT" for w in words]
        docs.append((200 + k, f"{say(30)} {' '.join(edited).upper()} {say(3000 if k == 4 else 20)}"))
    return docs + [docs[-1], (None, docs[-2][1])], items


def test_against_brute_force_whatever_the_filter(spark):
    docs, items = data()
    left = spark.createDataFrame([(i, x, 5) for i, x in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(i, x, "c") for i, x in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 10
    for blocks in (1, 1 << 20):  # a filter that lets everything through, and one that hardly does
        assert sorted((tuple(r) for r in d.contaminated(left, right, max_blocks=blocks).collect()), key=str) == want


def test_sketch_size_never_misses():
    for n in range(1, 300):
        need = d.needed(n, 0.8)
        assert need - 1 < 0.8 * n <= need + 1e-6


def test_drop_keeps_clean_rows_and_empty_sides(spark):
    docs, items = data()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {x for i, x in docs for k in brute([(i, x)], items)}
    kept = sorted(((r[0], r[1]) for r in d.drop_contaminated(left, right).collect()), key=str)
    assert kept == sorted(((i, x) for i, x in docs if x not in bad), key=str)
    clash = left.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("key", "_key", "row", "s", "doc"))])
    assert sorted(((r[0], r[1], *r[2:]) for r in d.drop_contaminated(clash, right).collect()), key=str) == sorted(((*k, 0, 1, 2, 3, 4) for k in kept), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(left, none).collect() == []
    assert d.contaminated(left.limit(0), right).collect() == []
    assert d.drop_contaminated(left, none).count() == len(docs)


def test_short_items_inside_longer_texts(spark):
    left = spark.createDataFrame([(1, "we saw the Red, red rose there today"), (2, "the red and the rose of all of us"), (3, "red red rose"), (4, None)], "doc_id long, text string")
    right = spark.createDataFrame([(1, "red red rose"), (2, "none of these words are here"), (3, "")], "item_id long, text string")
    assert sorted(tuple(r) for r in d.contaminated(left, right, short_inside=True).collect()) == [(1, 1, 1, 1), (3, 1, 1, 1)]
    assert [tuple(r) for r in d.contaminated(left, right).collect()] == [(3, 1, 1, 1)]
    assert sorted(r.doc_id for r in d.drop_contaminated(left, right, short_inside=True).collect()) == [2, 4]


def test_filter_has_no_false_negative(spark):
    index = spark.range(5000).selectExpr("xxhash64(id) AS h")
    h = np.array([r.h for r in index.collect()], np.int64).view(np.uint64)
    words = d.bloom_words(index, 512)
    assert len(d.known(words, h)) == 5000
    assert len(d.known(words, h * np.uint64(0x9E3779B97F4A7C15))) < 100


def test_registered_query_on_sample_documents(spark):
    at = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{at}/{n}.parquet").select(k, "text").collect()] for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, d.op5_benchmark_decontamination(spark, at).collect()), key=str) == brute(docs, items)
