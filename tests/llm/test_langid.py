import math
import random
from collections import Counter

import pytest

from treeloom.llm import langid

WORDS = {
    "en": "the of and to in that was his with for not but which you are they from have one were all her there been their said will each".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec été ses mais".split(),
}


def say(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(i, say(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    made += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!! ²½", None), (1003, say(rng, "fr", 30_000), None), (1004, say(rng, "de", 9), None)]
    return made + [made[3], (None, say(rng, "en", 20), "en")]


def test_predictions_and_held_out(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, score int, rejected string")
    model = langid.train(docs)
    assert model.langs == ["de", "en", "fr"]
    out = langid.predict(docs.withColumn("held_out", langid.held_out("doc_id")), model, keep=["doc_id", "held_out", "lang"]).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1002].score == 0 and by_id[1002].rejected
    assert by_id[1003].lang_pred == "fr" and by_id[1004].lang_pred == "de" and not by_id[1003].rejected
    known = [r for r in out if r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.98
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 for r in out) and not any(r.rejected for r in known)


def test_held_out_rows_teach_nothing(spark):
    import zlib

    rng = random.Random(2)
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 == 1]
    docs = spark.createDataFrame([(k, say(rng, "en", 20), "xx" if k in held else "en") for k in range(60)], "doc_id long, text string, lang string")
    assert langid.train(docs).langs == ["en"]


def test_noise_is_rejected(spark, rows):
    model = langid.fit([(lang, t) for _, t, lang in rows if t and lang and len(t) < 1000])
    scorer = langid.Scorer(model)
    rng = random.Random(3)
    noise = ["".join(rng.choices("qxzjkvwpy", k=7)) for _ in range(40)]
    assert scorer.predict([" ".join(noise)])[0][2]
    assert scorer.predict(["漢字かな交じり文とは何か、それを知りたい人はこの文章を読むべきである"])[0][2]


def test_every_label_is_learned_and_long_texts_are_excerpted(spark):
    """Many languages in one sample, one of them with long texts only; the sample keeps its bounds."""
    rng = random.Random(5)
    rows, words = [], {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(30)] for k in range(40)}
    for k, (lang, own) in enumerate(words.items()):
        rows += [(1000 * k + i, " ".join(rng.choices(own, k=3000 if k == 7 else 30)), lang) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit, langid.fit = langid.fit, lambda sample: fit(seen.extend(sample) or seen)
    try:
        model = langid.train(docs, sample_rows=6, sample_total=80, max_chars=500)
    finally:
        langid.fit = fit
    assert model.langs == sorted(words) and max(len(t) for _, t in seen) == 500 and len(seen) <= 80
    out = langid.predict(docs, langid.train(docs), keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_false_rejections_are_bounded_at_every_length(rows):
    pairs = [(lang, t) for _, t, lang in rows if t and lang and len(t) < 1000]
    scorer = langid.Scorer(langid.fit(pairs))
    for n in (1, 2, 5, 20, 100):
        pieces = [" ".join(t.split()[:n]) for _, t in pairs]
        assert sum(p[2] for p in scorer.predict(pieces)) <= 0.02 * len(pieces)


def test_registered_query_on_sample_documents(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    out = langid.op2_language_id(spark, d).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r.held_out and lang[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [tuple(r)[3:6] for r in langid.predict(docs, model).collect()] == [("und", 0.0, True)]
    assert langid.predict(docs.limit(0), model).collect() == []


def test_models_are_distributions():
    """The probabilities of all characters after a word's beginning add up to one, but for characters never seen."""
    model = langid.fit([("en", say(random.Random(k), "en", 40)) for k in range(30)])
    chars = sorted({c for w in WORDS["en"] for c in w})
    step = lambda word: model.log_steps([word])[:, 0]
    for context in ("", "t", "th", "whic", "zzz"):
        total = sum(math.exp(step(context + c)[len(context) + 1]) for c in chars) + math.exp(step(context)[len(context) + 1])
        assert 0.8 < total <= 1 + 1e-5


def test_interpolation_by_hand():
    """Two words: what Kneser-Ney gives is worked out order by order."""
    model = langid.Model({"x": Counter({"ab": 3, "cb": 1})})
    got = [math.exp(v) for v in model.log_steps(["ab"])[1:, 0]]
    size = len({*"abc"}) + 2

    def smooth(own, discount, char, lower):
        total = sum(own.values())
        held = sum(min(v, discount) for v in own.values())
        return max(own.get(char, 0) - discount, 0) / total + held / total * lower

    # discounts: from all adjusted counts of an order; n-grams that begin a word keep their raw counts
    unigrams = {"a": 1, "c": 1, "b": 2, "$": 1}
    d1 = min(max(3 / (3 + 2 * 1), 0.1), 0.9)
    first = {"a": 3, "c": 1}
    bigrams = [3, 1, 1, 1, 2]  # ^a ^c ab cb b$ (the last after two characters)
    d2 = min(max(bigrams.count(1) / (bigrams.count(1) + 2 * bigrams.count(2)), 0.1), 0.9)
    want = smooth(first, d2, "a", smooth(unigrams, d1, "a", 1 / size))
    assert math.isclose(got[0], want, rel_tol=1e-5)


