import random
from collections import Counter

import numpy as np

from sealcheck.llm import minhash
from tests.llm.cases import awkward, documents, empty, prose


def test_signatures_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    a = rng.integers(1, 40, 60)
    b = np.where(rng.random(60) < 0.5, a, rng.integers(1, 40, 60))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = [minhash.signatures([(items + np.uint64(k), w) for k in range(150)], 125) for w in (a, b)]
    same = (both[0] == both[1]).mean(axis=1)
    # A bag's signature is its own, whatever bags are signed with it.
    assert (both[0][7] == minhash.signatures([(items + np.uint64(7), a)], 125)[0]).all()
    assert abs(np.mean(same) - true) < 4 * np.std(same) / 150 ** 0.5 + 1e-3


def brute(rows):
    def bag(text):
        w = (text or "").lower().split()
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    bags, label = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j]
            if same or bags[i] and bags[j]:
                shared = 0 if same else sum((bags[i] & bags[j]).values())
                if same or shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
                    x, y = root(i), root(j)
                    label[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in groups.items()}
    return sorted([(doc, least[root(i)]) for i, (doc, _) in enumerate(rows)], key=repr), len(groups)


def near(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10 ** 6)}"
    return " ".join(words)


def test_against_brute_force_with_large_groups(spark):
    rnd = random.Random(2)
    rows = []
    for g in range(6):
        text = prose(g, 150)
        # Copies that are near the first but not all near each other, chains of copies, and exact ones.
        rows += [(len(rows) + k, near(rnd, text, rnd.choice([0, 1, 2, 3]))) for k in range(30 if g == 0 else 6)]
        chain = text
        for _ in range(4):
            chain = near(rnd, chain, 2)
            rows.append((len(rows), chain))
    rows += [(len(rows) + k, prose(500 + k, rnd.randint(1, 60))) for k in range(60)]
    rows += [rows[0], (None, rows[1][1])]
    rnd.shuffle(rows)
    want, groups = brute(rows)
    for options in ({}, {"small": 2, "block": 5, "hub_rows": 5}, {"small": 1}):
        got = minhash.near_duplicates(documents(spark, rows), **options).collect()
        assert sorted([(r["doc_id"], r["class_id"]) for r in got], key=repr) == want
    assert minhash.keep_one(documents(spark, rows)).count() == groups


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, groups = brute(rows)
    got = minhash.near_duplicates(docs).collect()
    assert sorted([(r["doc_id"], r["class_id"]) for r in got], key=repr) == want
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0
