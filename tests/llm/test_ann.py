import numpy as np
from pyspark.sql import functions as F

from treeloom.llm import ann


def brute(rows, is_query, k):
    rows = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    out = []
    for q, v in {i: v for i, v in reversed(rows)}.items():
        if not is_query(q):
            continue
        scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.3 * rng.normal(size=8)]) for i in range(n)]


def test_exact_when_all_parts_are_searched(spark):
    rows = vectors(300)
    rows += [(500 + k, rows[0][1]) for k in range(60)]  # very many equal vectors: ties go to smaller ids
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [None] * 8), (905, []), (920, [1.0] * 5), rows[7], (None, rows[3][1])]
    want = brute([r for r in rows if r[0] is not None], lambda i: i % 20 == 0, 20)
    for block, asked in ((8192, 1024), (37, 5)):
        got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, n_parts=5, recall_target=1.1, block_rows=block, query_rows=asked).collect()
        same(got, want)


def test_ids_that_repeat_with_other_vectors(spark):
    rows = vectors(200) + [(20, v) for _, v in vectors(40, 7)] + [(40, v) for _, v in vectors(30, 8)]
    is_query = lambda i: i % 20 == 0
    least = {i: min(v for j, v in rows if j == i) for i, _ in rows}
    want = []
    for q in sorted(filter(is_query, least)):
        scored = sorted((-float(np.dot(np.float64(least[q]), np.float64(w))), i) for i, w in rows if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:20])]
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[90:] + rows[:90], 5)):
        got = ann.search(frame(spark, order).repartition(parts), F.col("vec_id") % 20 == 0, n_parts=5, recall_target=1.1, block_rows=37).collect()
        same(got, want)


def test_recall_with_learned_parts(spark):
    rows = vectors(4000, 3)
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, sample_rows=2000).collect()
    hit = {w[:1] + w[2:3] for w in want} & {(g[0], g[2]) for g in got}
    assert len(got) == len(want) and len(hit) / len(want) >= 0.9
    x = np.array([v for _, v in rows])
    router = ann.fit(x[:2000])
    assert router.n_parts > 8 and router.probes < router.n_parts


def test_fewer_candidates_than_k_and_empty(spark):
    rows = vectors(6)
    same(ann.search(frame(spark, rows), F.col("vec_id") % 2 == 0).collect(), brute(rows, lambda i: i % 2 == 0, 20))
    assert ann.search(frame(spark, rows[:1]), F.lit(True)).collect() == []
    assert ann.search(frame(spark, [(1, None), (2, [0.0] * 8)]), F.lit(True)).collect() == []


def test_cells_hold_every_row_once():
    for sizes in ([5, 0, 3, 40, 2, 2, 90, 1], [0], [7] * 30):
        first, count = ann.cells(sizes, 10)
        held = {}
        for p, n in enumerate(sizes):
            for c in range(first[p], first[p] + count[p]):
                held.setdefault(c, []).append((p, n, count[p]))
        assert all(len(v) == 1 or sum(n for _, n, _ in v) <= 10 for v in held.values())
        assert all(-(-n // k) <= 10 for v in held.values() for _, n, k in v)


def test_registered_query_on_sample_vectors(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    got = ann.op9_nearest_neighbours(spark, d).collect()
    by_query, hits, total = {}, 0, 0
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {int(i) for i in ids if i % 20 == 0}
    for q, found in by_query.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and found == sorted(found, key=lambda r: (-r.score, r.vec_id))
        assert np.allclose([r.score for r in found], [s[np.flatnonzero(ids == r.vec_id)[0]] for r in found], rtol=1e-12)
        hits, total = hits + len({r.vec_id for r in found} & set(order[:20])), total + 20
    assert hits / total >= 0.9


def test_parts_are_balanced():
    x = np.array([v for _, v in vectors(1000, 5)])
    part = ann.balanced_parts(x, ann.neighbours(x, 10), 16)
    sizes = np.bincount(part, minlength=16)
    assert sizes.max() <= np.ceil(1000 / 16 * 1.1) + 1 and sizes.min() > 0
