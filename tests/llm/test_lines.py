import random

import numpy as np
import pytest

import corpus_pipeline
from sealcheck.llm import lines
from sealcheck.llm.queries import QUERIES
from tests.llm.cases import awkward, documents, empty, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def family(seed, bases, copies, letters="abé"):
    rnd, out = random.Random(seed), set()
    for _ in range(bases):
        base = [rnd.choice(letters) for _ in range(rnd.randint(10, 45))]
        for _ in range(copies):
            line = list(base)
            for _ in range(rnd.randint(0, 3)):
                at, kind = rnd.randrange(len(line)), rnd.randrange(3)
                if kind == 0:
                    line[at] = rnd.choice(letters)
                elif kind == 1:
                    line.insert(at, rnd.choice(letters))
                else:
                    del line[at]
            out.add("".join(line))
    return sorted(x for x in out if len(x) >= 10)


def links(texts):
    out = set()
    for i, a in enumerate(texts):
        for j in range(i):
            short, long = sorted((a, texts[j]), key=len)
            if len(long) - len(short) <= 2 and distance(short, long) <= min(2, len(short) // 10):
                out.add((j, i))
    return out


def test_banded_distance_against_dynamic_programming():
    texts = family(1, 40, 4)
    pairs = [(i, j, e) for i in range(len(texts)) for j in range(len(texts)) for e in (1, 2, 3)
             if i != j and 0 <= len(texts[j]) - len(texts[i]) <= e][:20000]
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    got = lines.within(points, *[np.array(x) for x in zip(*pairs)])
    assert got.tolist() == lines.verify(points, *[np.array(x) for x in zip(*pairs)]).tolist()
    assert got.tolist() == [distance(texts[i], texts[j]) <= e for i, j, e in pairs] and got.any()


@pytest.mark.parametrize("options", [{}, {"group_lines": 3}, {"group_lines": 3, "max_depth": 2}])
def test_join_against_brute_force(spark, options):
    texts = family(2, 25, 5) + [f"this template is common to all, number {i:03d}" for i in range(60)]
    want = links(texts)
    found = lines.edit_join(spark.createDataFrame(list(enumerate(texts)), "line_id long, line string"), **options).toPandas()
    count = found.groupby("line_id").n.sum().to_dict()
    assert {i: count.get(i, 0) for i in range(len(texts))} == {i: sum(i in p for p in want) for i in range(len(texts))}


def test_classes_and_texts(spark):
    a, b = "The first line of some length.", "The first line of same length."
    rows = [(2, f"{a}\nshort\nAn own line which stays here."), (1, f"{b}\n\nshort"), (3, a), (4, f"{a}\n\n"), (5, "short"), (6, f"Other text of enough length\n{b}")]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in lines.near_lines(docs).collect()}
    assert got[(1, 0)] == (1, 0, 1, True) and got[(2, 0)] == (1, 0, 1, False) and got[(3, 0)] == (1, 0, 1, False)
    assert got[(2, 2)] == (2, 2, 0, True) and (2, 1) not in got
    left = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert left == {1: f"{b}\n\nshort", 2: "short\nAn own line which stays here.", 5: "short", 6: "Other text of enough length"}


def test_short_lines_repeat_exactly(spark, tmp_path):
    rows = [(1, "Share\nA line with a text of its own.\n\nx"), (2, "Share\n \n\nAnother text which stands here only."), (3, "Share"), (4, "Shore\nx")]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 0, 0, True), (1, 1): (1, 1, 0, True), (1, 3): (1, 3, 0, True), (2, 0): (1, 0, 0, False), (2, 3): (2, 3, 0, True),
                   (3, 0): (1, 0, 0, False), (4, 0): (4, 0, 0, True), (4, 1): (1, 3, 0, False)}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {1: rows[0][1], 2: " \n\nAnother text which stands here only.", 4: "Shore"}


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    kept = sorted(map(repr, [(r["doc_id"], (r["text"] or "-")[:20]) for r in got.collect()]))
    gone = {(7, docs.filter("doc_id = 6").first()["text"][:20])}
    assert kept == sorted(map(repr, [x for r in docs.collect() if (x := (r["doc_id"], (r["text"] or "-")[:20])) not in gone]))
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
    assert lines.near_lines(empty(spark)).count() == 0 and lines.dedup_lines(empty(spark)).count() == 0


def test_long_lines(spark):
    long = prose(3, 4000)
    docs = documents(spark, [(1, long), (2, long[:9000] + "Q" + long[9001:]), (3, long[:50] + long[400:])])
    got = {r["doc_id"]: (r["class_doc"], r["n_links"]) for r in lines.near_lines(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
