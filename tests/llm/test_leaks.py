import random
from types import SimpleNamespace

import numpy as np

from sealcheck.llm import leaks
from tests.llm.cases import awkward, documents, empty, prose


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_subsequence_against_dynamic_programming():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rnd.integers(0, 6, rnd.integers(1, n)).astype(np.uint64) for n in (80, 120))
        assert leaks.common_subsequence(a, b) == subsequence(a.tolist(), b.tolist())


def corpus(spark):
    rnd = random.Random(3)
    items = [prose(100 + i, rnd.randint(15, 60)) for i in range(60)]
    rows, planted = [], set()
    for i in range(200):
        text = prose(1000 + i, rnd.randint(30, 400)).split()
        if i % 4 == 0:
            item, at = rnd.randrange(60), rnd.randrange(len(text))
            words = items[item].split()
            if i % 8 == 0:
                # A paraphrase: every seventh word changed, and one word put in.
                words = [w if k % 7 else "other" for k, w in enumerate(words)] + ["end"]
            text[at:at] = [w.upper() + "," for w in words]
            planted.add((i, item))
        rows.append((i, " ".join(text)))
    return documents(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), planted


def test_planted_items_are_found_and_nothing_else(spark):
    docs, benchmark, planted = corpus(spark)
    for options in ({}, {"block_items": 20}, {"rank": 24}):
        got = leaks.find_leaks(docs, benchmark, **options).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == planted and len(got) == len(planted)
        assert all(0.6 <= r["share"] <= 1 and r["first_word"] < r["last_word"] for r in got)
    kept = leaks.decontaminate(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) - {i for i, _ in planted}


def test_answers_decide_paraphrases(spark):
    item = prose(1, 30).split()
    near = " ".join(w if k % 3 else "x" for k, w in enumerate(item))
    docs = documents(spark, [(1, near + " paris"), (2, near), (3, prose(2, 60))])
    benchmark = spark.createDataFrame([(1, " ".join(item), "Paris")], "item_id long, text string, answer string")
    assert [r["doc_id"] for r in leaks.find_leaks(docs, benchmark).collect()] == [1]


def test_templated_items_at_every_offset(spark):
    # A template with three slots spread over 26 words; what tells an item are its slots.
    template = prose(40, 26).split()

    def item(i, changed=None):
        words = list(template)
        for k, at in enumerate((0, 10, 25)):
            words[at] = f"slot{k}x{'other' if k == changed else ''}{i}"
        return " ".join(words)

    benchmark = spark.createDataFrame([(i, item(i)) for i in range(200)], "item_id long, text string")
    rows = [(100 * c + o, f"{prose(1000 + 100 * c + o, 60 + o)} {item(o, c - 1 if c else None)} {prose(3000 + 100 * c + o, 60)}") for c in range(4) for o in range(16)]
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(documents(spark, rows), benchmark).collect()}
    assert {(d, d % 100) for d, _ in rows} <= found


def test_awkward_rows(spark):
    docs = awkward(spark)
    same = docs.filter("doc_id = 6").first()["text"]
    benchmark = spark.createDataFrame([(1, same), (1, same), (None, None), (3, ""), (4, " ?! "), (None, prose(12, 50))], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, benchmark).collect()), key=repr)
    assert got == sorted([(i, 1) for i in (6, 7, 7, 12)] * 2 + [(None, None)], key=repr)
    left = leaks.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - 5
    nothing = benchmark.limit(0)
    assert leaks.find_leaks(docs, nothing).count() == 0 and leaks.decontaminate(docs, nothing).count() == docs.count()
    assert leaks.find_leaks(empty(spark), benchmark).count() == 0


def test_a_text_is_hashed_once_however_many_items_are_near(spark, monkeypatch):
    docs, benchmark, planted = corpus(spark)
    items = leaks.fit(docs, next(leaks.blocks(benchmark, 100, 100_000)))
    rows = docs.select("doc_id", "text").toPandas().assign(**{leaks.KEY: b""})
    plain, hashed = leaks.word_hashes, []

    def counted(raw, gaps):
        hashed.append(len(raw))
        return plain(raw, gaps)

    monkeypatch.setattr(leaks, "word_hashes", counted)
    for piece in (1, 500, 1 << 16):
        monkeypatch.setattr(leaks, "PIECE_BYTES", piece, raising=False)
        hashed.clear()
        found, = leaks._search(SimpleNamespace(value=items), leaks.PASSAGE, leaks.COSINE, leaks.PARAPHRASE, leaks.VERBATIM)(iter([rows]))
        assert set(zip(found["doc_id"], found["item_id"].astype(int))) == planted and len(found) == len(planted)
        assert sum(hashed) <= sum(len(t.lower().encode()) + 1 for t in rows["text"])
