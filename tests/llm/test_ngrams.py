import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sealcheck.llm import ngrams
from tests.llm.cases import awkward, documents, empty


@pytest.mark.parametrize("size,top", [(0, 1), (1, 5), (1000, 2000), (5000, 2 ** 63), (3000, 10), (100, 2 ** 64 - 1)])
def test_elias_fano_round_trip_and_successor(tmp_path, size, top):
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, top, size, dtype=np.uint64))
    file = ngrams.EliasFano.write(str(tmp_path / "x"), values)
    assert (file.get(np.arange(size)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64)])
    assert (file.successor(asked) == np.searchsorted(values, asked)).all()
    assert (file.find(asked)[1] == np.isin(asked, values)).all()
    assert (tmp_path / "x").stat().st_size < 64 + size * (3 + max(1, math.log2(top / max(size, 1)) + 1)) / 8 + size


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2 ** 40])
def test_numbers_travel_in_as_few_bytes_as_the_largest_needs(top):
    values = np.random.default_rng(1).integers(0, top, 1000)
    raw = ngrams._pack(np.append(values, top))
    assert (ngrams._unpack(raw, 1001, np.int64) == np.append(values, top)).all()
    assert len(raw) == 1001 * -(-top.bit_length() // 8)
    assert ngrams._pack(values[:0]) == b"" and not len(ngrams._unpack(b"", 0, np.uint16))


def test_messages_hold_counts_in_a_byte_where_that_is_enough():
    texts = [" ".join(f"w{(i * 7 + k * k) % 900}" for k in range(200)) for i in range(20)]
    sent = ngrams.Chunk(texts, np.ones(len(texts), bool), 4).messages(0)
    numbers = {"counts": "words", "lengths": "contexts", "pairs": "following"}
    for column, beside in numbers.items():
        size = 4 if beside == "following" else 8
        # The end of a text is counted 20 times, no word or pair more than 255 times.
        assert sum(map(len, sent[column])) == sum(map(len, sent[beside])) // size


def brute(rows, weight=0.7):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    single, pair, begin = Counter(), Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            single.update(t)
            pair.update(zip([0, *t[:-1]], t))
            begin += 1
    n, v = sum(single.values()), len(single)
    smooth = lambda w: (single[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for (i, _), t, h in zip(rows, texts, held):
        score = 0.0
        for a, w in zip([0, *t[:-1]], t):
            after = begin if a == 0 else single[a]
            score += math.log10(weight * pair[(a, w)] / after + (1 - weight) * smooth(w) if after else smooth(w))
        out.append((i, h, len(t), sum(single[w] > 0 for w in t), n, sum(math.log10(smooth(w)) for w in t), score))
    return sorted(out, key=lambda r: (repr(r[0]), r[2:4], round(r[5], 3)))


def agree(docs, rows, **options):
    got = sorted([tuple(r) for r in ngrams.score_texts(docs, **options).collect()], key=lambda r: (repr(r[0]), r[2:4], round(r[5], 3)))
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=2e-3)


def test_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    agree(documents(spark, rows), rows, chunk_bytes=40_000)


def test_model_beats_the_base_on_texts_it_has_not_seen(spark):
    got = ngrams.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_awkward_rows(spark):
    docs = awkward(spark)
    agree(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert ngrams.score_texts(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    agree(documents(spark, [(held, "nothing to learn from")]), [(held, "nothing to learn from")])
