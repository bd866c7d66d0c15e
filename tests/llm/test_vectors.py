import math

import numpy as np

from sealcheck.llm import vectors


def brute(rows, threshold=0.95):
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for ok, (_, v) in zip(sound, rows)]
    link = [[j for j in range(len(rows)) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(link):
            low = min([label[i], *[label[j] for j in near]])
            if low != label[i]:
                label[i], changed = low, True
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        least = (min(ids) if ids else None) if link[i] else vec
        out.append((vec, len(link[i]), least, vec == least))
    return sorted(out, key=repr)


def test_against_brute_force_with_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 48))
    rows = [(i, (base[i % 40] + rng.normal(size=48) * (0.02 + 0.012 * (i % 20))).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, (2 * np.array(rows[4][1])).tolist()), (5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 48), (703, [None] + [1.0] * 47), (704, [float("nan")] + [1.0] * 47), (705, [float("inf")] * 48),
             (706, [1.0, 2.0]), (707, [1.0, 2.1]), (708, [3.0]), (709, [4.0]), (710, [-1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, bucket string, n int")
    for options in ({}, {"block": 7}):
        got = sorted([tuple(r) for r in vectors.similar_vectors(frame, **options).collect()], key=repr)
        assert got == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(2000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for depth, tables in ((2, vectors.TABLES), (3, 2 * vectors.TABLES)):
        a, b = (vectors.buckets(v, depth, tables, vectors.PROBES) for v in (x, y))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.98


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_empty(spark):
    assert vectors.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
