import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from treeloom.llm import phrases

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, f long, phrase string"


def plain(rows, max_words=5, min_count=3, percent=100):
    """Every rule of the contract, one after the other."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    able = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= min_count}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = set()
    for (lang, g), a in able.items():
        if any(x == lang and len(h) > len(g) and 100 * f >= percent * a and inside(g, h) for (x, h), f in able.items()):
            continue
        cuts = [(1000 * a * n[lang] // (counts[lang, g[:j]] * counts[lang, g[j:]]), j) for j in range(1, len(g))]
        least, j = min(cuts)
        out.add((lang, " ".join(g), a, counts[lang, g[:j]], counts[lang, g[j:]], n[lang], least))
    return out


ROWS = [
    (1, "New York is big. new york IS big; new york is\tsmall,  in new york is", "en"),
    (1, "New York is big. new york IS big; new york is\tsmall,  in new york is", "en"),
    (2, "a a a a a a a b a b a b", "en"),
    (None, "l'été à l'été à l'été à", None),
    (4, None, "en"),
    (5, "", "fr"),
    (6, "x\x0by x\x0by x y x y x y x\x00 y", "fr"),
    (7, "ÀB Àb ÀB Àb \xa0 ÀB", "de"),
]


@pytest.mark.parametrize("options", [{}, {"broadcast_grams": 0}, {"chunk_words": 2}, {"chunk_words": 3, "broadcast_grams": 0}])
@pytest.mark.parametrize("percent", [100, 60])
def test_against_plain_python(spark, options, percent):
    docs = spark.createDataFrame([(*r, 9, "p") for r in ROWS], FIELDS)
    found = phrases.collocations(docs, min_count=3, covered_percent=percent, **options)
    assert {tuple(r) for r in found.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == plain([(r[2], r[1]) for r in ROWS], percent=percent)


def test_long_text_and_long_runs_cross_chunks(spark):
    text = " ".join(f"w{i % 7} of the" for i in range(9000))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    found = phrases.collocations(docs, chunk_words=100)
    assert {tuple(r) for r in found.collect()} == plain([("en", text)], min_count=100)


@pytest.mark.parametrize("places", [3, 1 << 17])
def test_large_levels_meet_distinct_words_and_pairs(spark, monkeypatch, places):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", places)
    met = []
    decoded = phrases._decoded
    monkeypatch.setattr(phrases, "_decoded", lambda blocks, rows: met.append(rows.count()) or decoded(blocks, rows))
    docs = spark.createDataFrame([(r[1], r[2]) for r in ROWS] + [("a b " * 2000, "de")], "text string, lang string").coalesce(1)
    found = phrases.collocations(docs, min_count=3, broadcast_grams=0)
    assert {tuple(r) for r in found.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == plain([(r.lang, r.text) for r in docs.collect()])
    assert len(met) == 4 and (places == 3 or max(met) < 40)  # a row a distinct word or pair of a block, not one an occurrence


def test_held_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_COUNTS", 2)
    batch = spark.createDataFrame([("en", "a b a b c d"), ("en", "a b")], "lang string, text string").toArrow().to_batches()
    total = Counter()
    parts = list(phrases._count_words(iter(batch)))
    for part in parts:
        for r in part.to_pylist():
            total[r["word"]] += r["f"]
    assert len(parts) > 1 and total == {"a": 3, "b": 3, "c": 1, "d": 1, None: 8}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 10**14 + 7, 10**16 + 3, 10**14 + 9, 10**15 + 1
    row = spark.range(1).select(phrases.score(*[F.lit(x) for x in (a, n, left, right)]).alias("s")).first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_registered_query_against_plain_python_and_sql(spark):
    found = phrases.op11_phrase_mining(spark, SF)
    got = sorted(map(tuple, found.collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = con.sql(phrases.OP11_SQL)
    assert wanted.columns == found.columns and sorted(wanted.fetchall()) == got
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    assert {(lang, *rest) for lang, _, *rest in got} == plain([tuple(r) for r in rows], min_count=100)
    assert got
