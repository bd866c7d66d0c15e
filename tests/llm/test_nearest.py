import math

import numpy as np
import pytest

from sealcheck.llm import nearest
from sealcheck.llm.queries import QUERIES

SHAPE = "vec_id long, embedding array<double>, cell int, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE)


def brute(rows, every=20, k=20):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = v
    out = {}
    for q, v in sound.items():
        if q % every == 0:
            scores = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in sound.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def clustered(rng, n, width):
    centres = rng.normal(size=(12, width))
    return [(i, (rng.uniform(0.5, 2) * (centres[i % 12] + 0.4 * rng.normal(size=width))).tolist()) for i in range(n)]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    for rows in (clustered(rng, 2000, 24), [(i, rng.normal(size=32).tolist()) for i in range(1500)]):
        want, got = brute(rows), found(nearest.nearest(table(spark, rows), block=128, query_block=16))
        scores = {(q, i): s for q, hits in brute(rows, k=len(rows)).items() for i, s in hits}
        assert want.keys() == got.keys()
        assert all(len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0])) for hits in got.values())
        assert all(scores[q, i] == pytest.approx(s, abs=1e-12) for q, hits in got.items() for i, s in hits)
        assert np.mean([i in {h[0] for h in got[q]} for q, hits in want.items() for i, _ in hits]) >= 0.93


def test_whole_search_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, size=5).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(100)] + [(-20, [1.0] * 5), (-40, rows[3][1])]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 5), (1060, [None, 1.0, 1.0, 1.0, 1.0]), (1080, [float("nan")] * 5), (1100, [float("inf")] * 5), (None, [9.0] * 5)]
    rows += [(1120, [1.0, 2.0]), (1121, [2.0, 2.0]), (1140, [3.0]), (1160, [1.0, 2.0, 3.0])]
    want = brute(rows)
    for options in ({}, {"block": 9, "query_block": 4}):
        got = found(nearest.nearest(table(spark, rows + [rows[0], rows[20]]), recall=1.0, **options))
        for q, hits in want.items():
            assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in hits]), q
            assert got.get(q, []) == hits, q
    assert got[1120] == [(1121, 6.0)] and 1140 not in got


def test_traversal_takes_pairs_in_order():
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(7, 3)), rng.normal(size=(5, 4))
    index = nearest.MultiIndex(left, right, np.arange(35) % 4, np.zeros(35, int), 0, 10)
    q = rng.normal(size=7)
    sums = ((left @ q[:3])[:, None] + (right @ q[3:])[None]).ravel()
    assert nearest.traverse(q, index, np.inf) == [c for c in np.argsort(-sums) if index.sizes[c]]
    few = nearest.traverse(q, index, 9)
    assert few == nearest.traverse(q, index, np.inf)[:len(few)] and sum(index.sizes[few]) >= 9 > sum(index.sizes[few[:-1]])


def test_query_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want, got = brute(rows), found(QUERIES["op13_nearest_vectors"](spark, path))
    assert want.keys() == got.keys()
    assert np.mean([i in {h[0] for h in got[q]} for q, hits in want.items() for i, _ in hits]) >= 0.9


def test_empty(spark):
    assert nearest.nearest(table(spark, [])).count() == 0
    assert nearest.nearest(table(spark, [(20, [1.0, 2.0])])).count() == 0
