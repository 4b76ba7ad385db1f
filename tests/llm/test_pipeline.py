import random
import shutil

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_bpe import expected  # noqa: E402
from tests.llm.test_decontaminate import brute as brute_contaminated  # noqa: E402
from tests.llm.test_langid import WORDS, say  # noqa: E402
from tests.llm.test_secrets import brute as brute_secrets  # noqa: E402
from tests.llm.test_simhash import brute_fp, components  # noqa: E402
from treeloom.llm import bpe, langid  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    rows = [[i, say(rng, lang, rng.randint(30, 90)), lang, "s", 0] for i, lang in enumerate(rng.choices(list(WORDS), k=150))]
    items = [(k, say(rng, "en", 25)) for k in range(5)]
    rows += [[200 + k, f"{say(rng, 'en', 40)} {t} {say(rng, 'en', 30)}", "en", "s", 0] for k, (_, t) in enumerate(items)]
    rows += [[300 + k, rows[k][1], rows[k][2], "s", 0] for k in range(20)]
    rows += [[400 + k, f"{say(rng, 'de', 50)} token = 'abcdef{k}' {say(rng, 'de', 5)}", "de", "s", 0] for k in range(5)]
    rows += [[500, None, None, None, None], [501, "", "en", "s", 0], [502, "123 456", "en", "s", 7]]
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield str(d), rows, items
    shutil.rmtree(d, ignore_errors=True)


def plain(spark, rows, items):
    """doc_id to the text that is left after the first four stages."""
    model = langid.train(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))
    judged = langid.Scorer(model).predict([r[1] for r in rows])
    docs = {r[0]: r[1] for r, j in zip(rows, judged, strict=True) if not j[2]}
    comp = components({i: brute_fp(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if comp[i] == i}
    bad = {i for i, *_ in brute_contaminated(list(docs.items()), items)}
    docs = {i: t for i, t in docs.items() if i not in bad}
    for i, t in docs.items():
        out, at = "", 0
        for a, _, _, b in brute_secrets(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        docs[i] = out + t[at:]
    return docs, bad


def encoded(spark, d, docs):
    own = bpe.codec(bpe.read_vocab(bpe.public_vocab()[0]), bpe.public_vocab()[1])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in corpus_pipeline.run(spark, d).collect()}
    assert {k: v[:3] for k, v in got.items()} == {i: expected(own, t) for i, t in docs.items()}
    assert all(own.decode(v[3]).decode() == docs[k] for k, v in got.items())


def test_run_against_plain_python(spark, folder):
    d, rows, items = folder
    docs, bad = plain(spark, rows, items)
    assert not {500, 501, 502} & set(docs) and bad == {200 + k for k in range(5)} and not any(300 <= i < 320 for i in docs)
    encoded(spark, d, docs)
    assert sum("[SECRET]" in t for t in docs.values()) == 5


def test_registered_query_on_sample_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [list(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    docs, _ = plain(spark, rows, items)
    assert 0 < len(docs) < len(rows)
    encoded(spark, d, docs)


def test_two_texts_under_one_id(spark):
    rng = random.Random(3)
    a, b, c = (say(rng, "en", 60) for _ in range(3))
    rows = [(5, a, "en", "s", 1), (3, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, c, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (None, c)], key=str)


def test_stages_keep_the_columns(spark, folder):
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).collect() == []


def test_clashing_columns_pass_through(spark, folder):
    d, rows, _ = folder
    docs = spark.createDataFrame([(*r, "f", 0.5, True, "c", 1, 2) for r in rows[:40]], f"{SCHEMA}, found string, score double, rejected boolean, component_id string, _found int, _key int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {("f", 0.5, True, "c", 1, 2)}
