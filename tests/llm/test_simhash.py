import hashlib
import random
import re

import xxhash

from treeloom.llm import simhash as s
from treeloom.llm.components import connected_components


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    words = ["ab", "Cd", "é", "ß x", "zz", "q"]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "A b C", "a  b\x0bc"] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    texts += [texts[20], texts[20], texts[30].upper(), "w " * 100_000, "x" * 300_000]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string")
    got = {r[0]: (r[1], r[2]) for r in s.near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    comp = components(fps)
    assert got == {i: (format(fps[i], "016x"), comp[i]) for i in fps}


def test_registered_query_on_sample_documents(spark):
    d = "/root/testdata/sf0.001"
    fps = {i: brute_fp(t) for i, t in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    comp = components(fps)
    assert {tuple(r) for r in s.op8_simhash_near_dedup(spark, d).collect()} == {(i, format(fps[i], "016x"), comp[i]) for i in fps}


def test_links_find_every_close_pair_whatever_the_bucket_size(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(40):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        for k in range(32, 50):
            fps.add(b ^ (1 << k))
    fps = sorted(fps)
    want = {(min(map(signed, p)), max(map(signed, p))) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2 for p in [(a, b)]}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for large in (0, 3, 1000):
        assert {tuple(r) for r in s.links(df, large).collect()} == want


def test_chains_stars_and_no_edges(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 199)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(connected_components(df).collect())
    want = {i: 0 for i in range(51)} | {100 + k: 100 for k in range(30)} | {199: 199, 200: 199}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "z y x w"), (7, "a b c d"), (7, "a b c d"), (3, "A B C D")], "doc_id long, text string")
    got = sorted(((r[0], r[2]) for r in s.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (None, None), (7, 3), (7, 3), (3, 3)], key=str)
    kept = sorted(((r[0], r[1]) for r in s.keep_one(docs).collect()), key=str)
    assert kept == [(3, "A B C D"), (None, "z y x w")]
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_goes_by_component_not_by_id(spark):
    a, near = _near_pair()
    docs = spark.createDataFrame(
        [(1, "a b c d"), (1, "z y x w"), (1, "Z Y X W"), (2, "a b c d"), (5, "q r s t"), (5, "q r s t"), (None, a), (None, near), (None, None), (None, "")],
        "doc_id long, text string",
    )
    assert s.keep_one(docs.limit(0)).collect() == []
    for few in ([(5, "a b c d"), (3, "a b c d"), (5, "z y x w")], [(5, "a b c d"), (5, "z y x w")]):
        clash = spark.createDataFrame([(*r, 1, 2, 3) for r in few], "doc_id long, text string, _text int, id int, root int")
        want = sorted((t, min(i for i, x in few if x == t)) for t in {x for _, x in few})
        assert sorted((r[1], r[0]) for r in s.keep_one(clash).collect()) == want
    kept = sorted(((r[0], r[1]) for r in s.keep_one(docs).collect()), key=str)
    first = lambda *texts: min(texts, key=lambda x: hashlib.md5(f"{i}/{'-' if x is None else hashlib.md5(x.encode()).hexdigest()}".encode()).hexdigest())
    want = []
    for i, *texts in ((1, "a b c d"), (1, "z y x w", "Z Y X W"), (5, "q r s t"), ("-", a, near), ("-", None, "")):
        want.append((None if i == "-" else i, first(*texts)))
    assert kept == sorted(want, key=str)


def _near_pair():
    """Two texts whose fingerprints differ by one or two bits."""
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(400)]
    for k in range(400):
        other = [*words[:k], "other", *words[k + 1 :]]
        if bin(s.fingerprint(" ".join(words)) ^ s.fingerprint(" ".join(other))).count("1") in (1, 2):
            return " ".join(words), " ".join(other)


def test_no_side_that_grows_is_broadcast(spark):
    from pyspark.sql import functions as F

    fps = spark.range(1000).select((F.col("id") * 7919).alias("fp"))  # Spark knows that it is small
    assert "Broadcast" not in s.links(fps)._jdf.queryExecution().executedPlan().toString()
