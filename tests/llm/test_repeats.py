import hashlib
import random

import numpy as np

from treeloom.llm import repeats as r
from treeloom.llm.suffixes import Buffer, equal_neighbours, suffix_order


def brute(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k1 int, spans string").repartition(3)
    out = r.remove_repeats(docs, length, digest=True).collect()
    assert all(x.n_kept == x.n_bytes - x.n_removed for x in out)
    return sorted((tuple(x)[:5] for x in out), key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choices("abcdeé ", k=n))
    passage, other = say(length * 3), say(length)
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * length * 2), (4, "x" * (length * 3)), (5, say(500))]
    for k in range(12):
        rows.append((10 + k, say(rng.randint(0, 90)) + passage[rng.randint(0, 40) : len(passage) - rng.randint(0, 40)] + say(rng.randint(0, 90))))
    base = say(length * 6)
    for k in range(8):  # near copies with an edit here and there
        edited = list(base)
        for _ in range(k):
            edited[rng.randrange(len(edited))] = "#"
        rows.append((40 + k, "".join(edited)))
    twice = say(30) + other + say(20) + other + say(10)
    rows += [(60, twice), (61, say(7) + other), (62, rows[6][1]), (62, rows[6][1]), (None, say(300)), (None, other + "tail")]
    return rows


def test_against_brute_force(spark):
    for seed in range(2):
        for length in (24, 60):
            rows = corpus(seed, length)
            assert run(spark, rows, length) == brute(rows, length)


def test_long_text_in_parts_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(r, "PIECE_BYTES", 300)
    rows = corpus(7, 30)
    data = b"".join((t or "").encode() for _, t in rows)
    bounds = np.r_[0, np.cumsum([len((t or "").encode()) for _, t in rows])]
    starts = []
    for r0, r1, b0, b1 in r.pieces(bounds, 30, 300):
        for row in range(r0, r1):
            lo, hi = max(b0, bounds[row]), min(b1, bounds[row + 1])
            starts += [(row, k) for k in range(lo, hi - 29)]
    want = [(i, k) for i in range(len(rows)) for k in range(bounds[i], bounds[i + 1] - 29)]
    assert sorted(starts) == want and len(data) == bounds[-1]
    assert run(spark, [], 30) == []


def test_suffix_order_is_the_suffix_order():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh"):
        data = np.frombuffer("".join(rng.choices(alphabet, k=900)).encode() * 3, np.uint8)
        raw, buffer = data.tobytes(), Buffer(data)
        for limit in (8, 20, 64):
            starts = np.array(sorted(rng.sample(range(len(raw) - limit), 700)))
            order = suffix_order(buffer, starts, limit)
            assert order.tolist() == sorted(starts.tolist(), key=lambda s: (raw[s : s + limit], s))
            same = equal_neighbours(buffer, order, limit)
            assert same.tolist() == [raw[a : a + limit] == raw[b : b + limit] for a, b in zip(order[:-1], order[1:])]


def test_null_ids_with_like_texts_keep_to_themselves(spark):
    """Very many rows without id: what one of them repeats is not cut from another."""
    from pyspark.sql import functions as F

    some = spark.range(3000).select(F.when(F.col("id") < 10, F.col("id")).alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat_ws("/", F.col("id") % 2990, F.lit(k))) for k in range(3)]).alias("text"))
    out = r.remove_repeats(some, 60)
    assert out.where("n_removed > 0").count() == 20 and out.where("doc_id IS NULL AND n_removed > 0").count() == 10
    long, other = r._keyed(some, "doc_id", "text").select("k1", "k2").dtypes
    assert long[1] == other[1] == "bigint"


def test_hash_collisions_are_no_repeats(spark, monkeypatch):
    """All polynomial hashes agree: digests and bytes still tell the strings apart."""
    rows = corpus(3, 24)
    monkeypatch.setattr(Buffer, "hash", lambda self, start, length: np.zeros(len(start), np.uint64))
    texts = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    spans = [[{"low": 0, "high": len(t) - 24, "anchor": len(t) - 24, "witness": False}] if len(t) >= 24 else [] for t in texts]
    text, low, high, w1, w2, kind = r.window_rows(texts, spans, 24)
    strings = {}
    for i, a, x, y, k in zip(text.tolist(), low.tolist(), w1.tolist(), w2.tolist(), kind.tolist()):
        if k < 2:
            strings.setdefault((x, y), set()).add(texts[i][a : a + 24].tobytes())
    assert len(strings) > 100 and all(len(v) == 1 for v in strings.values())


def brute_words(rows, n):
    seen = {}
    for _, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        inside = {k for a in range(len(w) - n + 1) if seen[tuple(w[a : a + n])] > 1 for k in range(a, a + n)}
        out.append((i, len(inside)))
    return sorted(out, key=str)


def test_passages_of_words_against_brute_force(spark):
    rng = random.Random(8)
    words = ["ab", "c", "dé", "ef", "g"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, loop = say(60), say(3) * 30
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, " ".join(loop))]
    for k in range(25):
        own = passage[rng.randint(0, 30) : rng.randint(30, 60)]
        rows.append((10 + k, rng.choice([" ", "\n", "  "]).join(say(rng.randint(0, 40)) + own + say(rng.randint(0, 40)))))
    rows += [(50, rows[9][1]), (None, rows[9][1]), (None, " ".join(passage))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_passage_words int, words string").repartition(3)
    for n in (8, 20):
        out = r.remove_repeats(docs, 500, passage_words=n).collect()
        assert sorted(((x.doc_id, x.n_passage_words) for x in out), key=str) == brute_words(rows, n)
        assert all(x.n_removed == 0 for x in out)


def test_registered_query_on_sample_documents(spark):
    from treeloom.llm.repeats import op4_suffix_dedup

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    out = op4_suffix_dedup(spark, d).collect()
    assert sorted((tuple(x)[:5] for x in out), key=str) == brute([tuple(x) for x in docs], 400)
    assert sorted(((x.doc_id, x.n_passage_words) for x in out), key=str) == brute_words([tuple(x) for x in docs], 50)


def test_extension_is_the_common_prefix():
    data = np.frombuffer(b"abcabcabdabcabcabc" * 4, np.uint8)
    raw, buffer = data.tobytes(), Buffer(data)
    a, b = np.repeat(np.arange(30), 30), np.tile(np.arange(30), 30)
    got = buffer.extension(a, b, 30)
    for x, y, n in zip(a, b, got):
        want = next((k for k in range(30) if raw[x + k] != raw[y + k]), 30)
        assert n == want


def test_runs_are_found_once(spark, monkeypatch, tmp_path):
    """Each text is cut into runs by one task, though runs are counted and then met with the counts; what is written of them goes."""
    from dataclasses import replace
    from pathlib import Path

    plain, seen = r.UNITS["bytes"].column, str(tmp_path / "seen")

    def counted(column):
        with open(seen, "a") as out:
            out.write(f"{len(column)}\n")
        return plain(column)

    monkeypatch.setitem(r.UNITS, "bytes", replace(r.UNITS["bytes"], column=counted))
    rows = corpus(5, 24)
    assert run(spark, rows, 24) == brute(rows, 24)
    with open(seen) as lines:
        assert sum(map(int, lines)) == sum(len((t or "").encode()) >= 24 for _, t in rows)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert list(shared.glob("repeats-shared-*")) and not list(shared.glob("repeats-runs-*"))


def test_digests_tell_numbers_and_bytes_apart():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    at, numbers = np.array([0, 3, 6, 0, 3]), np.array([7, 7, 7, 8, 0])
    found = list(map(tuple, r.digests(data, at, at + 3, numbers)))
    assert found[0] == found[1] and len(set(found)) == 4
    plain = list(map(tuple, r.digests(data, at, at + 3)))
    assert plain[0] == plain[1] == plain[3] == plain[4] != plain[2]


def test_windows_of_spans_as_arrays_or_objects():
    rng = random.Random(2)
    texts = [np.frombuffer(bytes(rng.choices(b"ab", k=60)), np.uint8) for _ in range(4)]
    spans = [[{"low": 3, "high": 9, "witness": False}, {"low": 20, "high": 30, "witness": True}], [], [{"low": 0, "high": 40, "witness": False}], [{"low": 5, "high": 5, "witness": True}]]
    batch = r.pa.RecordBatch.from_arrays([r.pa.array(range(4)), r.pa.array(range(4)), r.pa.array(spans), r.pa.array([t.tobytes() for t in texts], r.pa.binary())], names=["k1", "k2", "spans", "packed"])
    (first, got, owner, fields), *more = r._batched(batch.slice(0), r.UNITS["bytes"])
    assert first == 0 and not more and owner.tolist() == [0, 0, 2, 3]
    for a, b in zip(r.sorted_windows(got, owner, fields, 8), r.window_rows(texts, spans, 8)):
        assert a.tolist() == b.tolist()
    (first, got, owner, fields), *_ = r._batched(batch.slice(2), r.UNITS["bytes"])
    assert owner.tolist() == [0, 1] and fields["low"].tolist() == [0, 5] and len(got) == 2
