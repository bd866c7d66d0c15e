import random
import re
from collections import Counter, defaultdict

from sealcheck.llm import phrases
from sealcheck.llm.queries import QUERIES
from tests.llm.cases import EXTRA, awkward, empty


def count(rows, longest):
    found = defaultdict(Counter)
    for lang, text in rows:
        grams = found[lang if lang is not None else "und"]
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                grams.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return found


def brute(rows, longest=3, least=10, keep=2000):
    out = []
    for lang, grams in count(rows, longest).items():
        n = sum(f for g, f in grams.items() if len(g) == 1)
        candidates = {g: f for g, f in grams.items() if len(g) > 1 and f >= least}
        edges = [g for g in candidates if len(g) == longest]

        def inner(node):
            into, out = [grams[e] for e in edges if e[1:] == node], [grams[e] for e in edges if e[:-1] == node]
            return len(into) == len(out) == 1 and into[0] == out[0] == grams[node]

        def path(edge):
            words = list(edge)
            while inner(tuple(words[1 - longest:])):
                words.append(next(e for e in edges if e[:-1] == tuple(words[1 - longest:]))[-1])
            while inner(tuple(words[:longest - 1])):
                words.insert(0, next(e for e in edges if e[1:] == tuple(words[:longest - 1]))[0])
            return len(words)

        scored = []
        for g, a in candidates.items():
            inside = [f for h, f in candidates.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * f >= 50 * a for f in inside):
                continue
            cuts = [(1000000 * a * a // (grams[g[:k]] * grams[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(g).encode(), grams[g[:k]], grams[g[k:]], g))
        for rank, (score, a, name, left, right, g) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, name.decode(), -a, left, right, n, -score, path(g) if len(g) == longest else len(g)))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def texts(seed, docs=60):
    rnd = random.Random(seed)
    words = ["The", "of", "cat", "DOG", "sat\tdown", "été", "Éa", "日本", "a.b", "x"]
    rows = []
    for i in range(docs):
        body = " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "!", "\n", "  "]) for _ in range(60))
        rows.append((rnd.choice(["en", "fr", None]), body + ". all rights are reserved by the owner of this text; " + " ".join(["go"] * rnd.randint(0, 30))))
    return rows + [("en", None), ("en", ""), (None, " \t"), ("fr", ".,;:"), ("de", "one word"), ("und", "the of cat " * 40)]


def table(spark, rows):
    return spark.createDataFrame([(1, t, lang, "s", 0, "x", 1, "b", 2) for lang, t in rows], EXTRA)


def test_phrases_against_brute_force(spark):
    rows = texts(1)
    for longest, least, keep, held in ((3, 10, 2000, 100_000), (2, 3, 2000, 50), (4, 5, 7, 50)):
        want = brute(rows, longest, least, keep)
        assert got(phrases.mine_phrases(table(spark, rows), longest, least, keep, held)) == want
        assert want


def test_query_against_brute_force(spark, tmp_path):
    rows = texts(2, 90)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert got(QUERIES["op12_phrases"](spark, str(tmp_path))) == want
    assert max(r[-1] for r in want) > 5


def test_paths_run_through_nodes_without_branches(spark):
    rows = [("en", "a b c d e f g h")] * 10 + [("en", "x c d e y")] * 12
    inner, edges = phrases.compact(phrases.phrase_counts(table(spark, rows)))
    assert {r.gram for r in inner.collect()} == {"b c", "e f", "f g"}
    assert {(r.gram, r.path, r.place, r.path_words) for r in edges.collect()} == {
        ("a b c", "a b c", 0, 4), ("b c d", "a b c", 1, 4), ("c d e", "c d e", 0, 3), ("d e f", "d e f", 0, 5), ("e f g", "d e f", 1, 5),
        ("f g h", "d e f", 2, 5), ("x c d", "x c d", 0, 3), ("d e y", "d e y", 0, 3)}


def test_large_counts_are_exact(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        a = rnd.randint(10, 10 ** rnd.randint(2, 13))
        left, right = a + rnd.randint(0, 10 ** rnd.randint(0, 13)), a + rnd.randint(0, 10 ** rnd.randint(0, 13))
        rows += [("en", f"l{i}", 1, left), ("en", f"r{i}", 1, right), ("en", f"l{i} r{i}", 2, a)]
        want[f"l{i} r{i}"] = 1000000 * a * a // (left * right)
    counts = spark.createDataFrame(rows + [("en", "", 0, 10 ** 17)], "lang string, gram string, size int, n long")
    assert {r.phrase: r.score for r in phrases.rank_phrases(counts, 2).collect()} == want


def test_awkward_and_empty(spark):
    rows = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert got(phrases.mine_phrases(awkward(spark), min_count=2)) == brute(rows, least=2)
    assert phrases.mine_phrases(empty(spark)).count() == 0
