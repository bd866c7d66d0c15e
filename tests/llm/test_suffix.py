import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sealcheck.llm import suffix
from tests.llm.cases import awkward, documents, empty


def brute(rows, length):
    raws, count = [(i, (t or "").encode()) for i, t in rows], Counter()
    for _, raw in raws:
        count.update(raw[k:k + length] for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        hit = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k:k + length]] > 1:
                hit[k:k + length] = b"\1" * length
        kept = bytes(x for x, h in zip(raw, hit) if not h)
        out.append((i, len(raw), sum(hit), sum(1 for j, h in enumerate(hit) if h and (j == 0 or not hit[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = suffix.remove_repeats(docs, **options).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows], key=repr)


@pytest.mark.parametrize("options", [{}, {"group_regions": 2, "chunk": 300}])
def test_against_brute_force(spark, options):
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefg hij") for _ in range(70))
    rows = [(None, None), (1, ""), (2, "a" * 200), (3, "ab" * 60), (4, "é" * 30)]
    for i in range(60):
        text = "".join(rnd.choice("abcdefg hijé") for _ in range(rnd.randint(0, 120)))
        if i % 3 == 0:
            at = rnd.randint(0, len(text))
            text = text[:at] + passage[rnd.randint(0, 10):rnd.randint(40, 70)] + text[at:]
        rows.append((i + 10, text))
    rows += [rows[20], (99, rows[20][1]), rows[5]]
    assert found(documents(spark, rows), length=20, gram=8, **options) == brute(rows, 20)


def test_pieces_of_a_long_text(monkeypatch):
    data = np.frombuffer(np.random.default_rng(0).integers(97, 101, 3000).astype(np.uint8).tobytes(), np.uint8)
    for piece in (1 << 23, 500):
        monkeypatch.setattr(suffix, "PIECE", piece)
        value, place, first, last = suffix.anchors(data, 40, 16)
        assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]).tolist() == list(range(len(data) - 39))
        assert ((place >= last) & (place <= first + 24)).all()


def test_intervals_against_sorted_suffixes():
    rnd = random.Random(4)
    regions = ["".join(rnd.choice("ab") for _ in range(60)).encode() for _ in range(12)]
    regions += [regions[0][:30] + b"x" + regions[0][31:], regions[1]]
    got = suffix.repeated_starts(regions, np.ones(len(regions)), 12)
    count = Counter(r[k:k + 12] for r in regions for k in range(len(r) - 11))
    assert [g.tolist() for g in got] == [[count[r[k:k + 12]] > 1 for k in range(len(r) - 11)] for r in regions]


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 400)
    assert suffix.remove_repeats(empty(spark)).count() == 0
