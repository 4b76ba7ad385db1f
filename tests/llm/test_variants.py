import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from treeloom.llm import variants

SF = "/root/testdata/sf0.001"


def edits_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, least=5, times=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= times}


def plain_variants(words, ratio=2):
    near = {w: [v for v in words if edits_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def made_words(seed: int, count: int, letters: str, longest: int) -> dict[str, int]:
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.randint(1, 40) for _ in range(count)}


@pytest.mark.parametrize("group_words", [2, 7, 2000])
def test_dense_vocabulary_against_all_pairs(spark, group_words):
    words = made_words(1, 700, "aby", 8)
    found = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), group_words=group_words)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_variants(words), key=str)


def test_each_pair_comes_once(spark):
    words = made_words(2, 500, "aéb", 9)
    pairs = [frozenset((r["a"], r["b"])) for r in variants.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), 5).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if edits_one(a, b)}


def test_a_hot_prefix_is_parted(spark):
    """A third of all words begin alike: their groups are parted until they are small."""
    r = random.Random(3)
    words = {"prefix" + "".join(r.choice("abcde") for _ in range(6)): r.randint(3, 90) for _ in range(400)} | made_words(4, 300, "abcdefgh", 9)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = [len(r["members"]) for r in variants.groups(df, 40).collect()]
    assert max(sizes) <= 40
    found = variants.spelling_variants(df, group_words=40)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_variants(words), key=str)


def test_chain_of_forms_ends_at_the_last(spark):
    words = {"a" * k + "z" * (40 - k): 2**k for k in range(1, 38)}
    found = {r["word"]: r["root"] for r in variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"a" * 37 + "z" * 3}


def test_texts_of_all_kinds(spark):
    rows = [
        (1, "Colour colour COLOUR color color color color color color color color", 1),
        (2, None, 2), (3, "", 3), (4, "...12", 4), (None, "colour color Études études Études Études", 5),
        (5, "naïve’naïve\U0001f600naïve naive naive naive naive naive naive 中naive", 6),
        (5, "naïve’naïve\U0001f600naïve naive naive naive naive naive naive 中naive", 6),
        (6, " ".join("w" * 3000 + c for c in "aaabbbbbbb"), 7),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n long, word string, form long")
    found = variants.spelling_variants(variants.vocabulary(docs))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_variants(plain_words([r[:2] for r in rows])), key=str)


def test_letters_are_deleted_by_checksum():
    hits = [w for i in range(3000) if (w := f"word{i}") and zlib.crc32(f"7:{w}".encode()) % 97 == 0]
    assert hits
    for w in hits:
        at = zlib.crc32(f"7:{w}".encode()) % len(w)
        assert variants.damaged(w.encode(), zlib.crc32(b"7:"), 97).decode() == w[:at] + w[at + 1 :]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(variants.vocabulary(docs)).collect() == []


def test_registered_query_against_plain_python_and_sql(spark):
    found = variants.op12_spelling_variants(spark, SF)
    got = sorted(map(tuple, found.collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = con.sql(variants.OP12_SQL)
    assert wanted.columns == found.columns and sorted(wanted.fetchall(), key=str) == got
    words = plain_words([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert got == sorted(plain_variants(words), key=str)
