"""Language identification with a string kernel (operator 1)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sealcheck.llm.common import held_out, whole_row

ORDERS = (1, 2, 3)
PER_LANG = 200
LANDMARKS = 256
RIDGE = 1e-3
SIZE = 64
BATCH_GRAMS = 500_000
OFFSETS = (0, SIZE, SIZE + SIZE ** 2)
TOTAL = SIZE + SIZE ** 2 + SIZE ** 3
WIDE = 18
BLOCK_LANDMARKS = 64


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


@lru_cache(maxsize=4)
def _table(letters: str) -> np.ndarray:
    """Code point to symbol: 0 is any non-letter, 1 and up the known letters in their order, -1 any other letter."""
    table = np.where(_alphabetic(), -1, 0).astype(np.int32)
    table[_points(letters)] = np.arange(1, len(letters) + 1)
    return table


def grams(text: str, letters: str) -> np.ndarray:
    """Which n-grams of known letters and word borders the whole text holds, n from 1 to 3, each once.

    N-grams of the first 63 letters alone, the most frequent ones, have small numbers and are marked in a table; others
    hold 18 bits a letter, enough for every letter there is, above their order.
    """
    s = _table(letters)[_points(text)].astype(np.int64)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    small, wide = np.zeros(TOTAL, bool), []
    for n in ORDERS:
        if len(s) < n:
            break
        parts = [s[i:len(s) - n + 1 + i] for i in range(n)]
        low, high = np.minimum.reduce(parts), np.maximum.reduce(parts)
        ok = (low >= 0) & (parts[1] != 0 if n == 3 else high > 0)
        near, far = ok & (high < SIZE), ok & (high >= SIZE)
        code = np.zeros(int(near.sum()), np.int64)
        for part in parts:
            code = code * SIZE + part[near]
        small[OFFSETS[n - 1] + code] = True
        if far.any():
            code = np.full(int(far.sum()), n, np.int64)
            code <<= WIDE * (3 - n)
            for part in parts:
                code = code << WIDE | part[far]
            wide.append(np.unique(code))
    return np.concatenate([np.flatnonzero(small), *wide])


def _scale(found: np.ndarray) -> np.ndarray:
    """Per n-gram: one over the root of how many n-grams of its order the text has, the kernel's normalisation."""
    order = np.where(found < TOTAL, np.searchsorted(OFFSETS, found, side="right"), found >> 3 * WIDE) - 1
    n = np.bincount(order, minlength=3)
    return (1 / np.sqrt(np.maximum(n, 1)))[order].astype(np.float32)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(letters, classes, n-grams seen, n-grams weighed, their weights by class): one-versus-rest kernel ridge
    regression on Nyström landmarks.

    The kernel is the blended spectrum presence kernel: the n-grams two texts share, per order n, over the root of
    the product of their counts. Every letter of the texts counts. Landmarks are spread over the classes, each has one
    at least. Since a score is K(x, landmarks) times the dual weights and K is a product of presence vectors, both
    matrices are folded into one by n-gram.
    """
    points, counts = np.unique(np.concatenate([_points(t) for t in texts] or [np.zeros(0, np.uint32)]), return_counts=True)
    alpha = _alphabetic()[points]
    letters, classes = "".join(chr(p) for _, p in sorted(zip(-counts[alpha], points[alpha]))), sorted(set(langs))
    found = [grams(t, letters) for t in texts]
    seen = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]))
    by_class: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        by_class.setdefault(x, []).append(i)
    order = [by_class[c][r] for r in range(max(map(len, by_class.values()), default=0)) for c in classes if r < len(by_class[c])]
    marks = sorted(order[:max(landmarks, len(classes))])
    held = np.unique(np.concatenate([found[i] for i in marks] or [np.zeros(0, np.int64)]))
    k_nm = np.zeros((len(texts), len(marks)))
    for at in range(0, len(marks), BLOCK_LANDMARKS):
        part = marks[at:at + BLOCK_LANDMARKS]
        dense = np.zeros((len(held) + 1, len(part)), np.float32)
        for j, i in enumerate(part):
            dense[np.searchsorted(held, found[i]), j] = _scale(found[i])
        k_nm[:, at:at + len(part)] = scores(found, held, dense)
    k_mm = k_nm[marks]
    target = np.where(np.array(langs)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    left = k_nm.T @ k_nm + ridge * len(texts) * (k_mm + k_mm.T) / 2 + 1e-8 * np.trace(k_mm) * np.eye(len(marks))
    dual = np.linalg.solve(left, k_nm.T @ target)
    weights = np.zeros((len(held) + 1, len(classes)), np.float32)
    for j, i in enumerate(marks):
        weights[np.searchsorted(held, found[i])] += _scale(found[i])[:, None] * dual[j].astype(np.float32)
    return letters, classes, seen, held, weights


def _place(found: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where n-grams stand in sorted `columns`; one past the end for those that do not."""
    if not len(columns):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
    return np.where(columns[at] == found, at, len(columns))


def scores(found: list[np.ndarray], columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of a batch of texts: the product of their scaled presence vectors, kept sparse, with the weights of
    `columns`; the last row of weights is for all other n-grams."""
    out = np.zeros((len(found), weights.shape[1]), np.float32)
    size = np.array([len(f) for f in found], np.int64)
    full = np.flatnonzero(size)
    for part in np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // BATCH_GRAMS)) + 1):
        if len(part):
            place = np.concatenate([_place(found[i], columns) for i in part.tolist()])
            scale = np.concatenate([_scale(found[i]) for i in part.tolist()])
            out[part] = np.add.reduceat(scale[:, None] * weights[place], np.cumsum(size[part]) - size[part], axis=0)
    return out


def predictor(spark, model):
    """A vectorised Column function text -> (lang, score, evidence) for a fitted model."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, evidence boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        letters, classes, seen, held, weights = shared.value
        lettered = np.array([bool(classes) and text is not None and any(map(str.isalpha, text)) for text in texts], bool)
        found = [grams(text, letters) if ok else np.zeros(0, np.int64) for text, ok in zip(texts, lettered)]
        some = np.array([len(f) > 0 for f in found], bool)
        if not classes:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "evidence": False})
        score = scores(found, held, weights)
        best = score.argmax(axis=1)
        return pd.DataFrame({"lang": np.where(lettered, np.array(classes, object)[best], "und"),
                             "score": np.where(some, np.clip((1 + score[np.arange(len(best)), best].astype(float)) / 2, 0, 1), 0.0),
                             "evidence": [bool((_place(f, seen) < len(seen)).any()) for f in found]})

    return predict


def train(docs: DataFrame, per_lang: int = PER_LANG):
    """Fit on a bounded sample of every language: per language the `per_lang` rows of smallest hash.

    Learns from text and lang of rows outside the held-out fold whose text has a letter. The bound is a parameter
    of the classifier; prediction covers every row.
    """
    mark = F.xxhash64("doc_id", "text")
    labelled = docs.filter(~held_out(5) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", mark.alias("mark"))
    ranked = labelled.distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark")))
    chosen = {(r["mark"], r["lang"]) for r in ranked.filter(F.col("n") <= per_lang).collect()}
    rows = docs.filter(~held_out(5) & F.col("lang").isNotNull() & mark.isin(sorted({m for m, _ in chosen}))).select(
        "lang", "text", mark.alias("mark")).distinct().collect() if chosen else []
    rows = sorted({(r["mark"], r["lang"], r["text"]) for r in rows if r["text"] and (r["mark"], r["lang"]) in chosen})
    return fit([r[2] for r in rows], [r[1] for r in rows])


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_evidence, predicted from the whole text only.

    Null text and text without a letter is `und` with score 0, as is everything when no row is labelled. Evidence
    is false if the text shares no n-gram with any text learned from. Scores of equal height go to the class first
    in the alphabet. Columns of the three names are replaced, all others stay.
    """
    names = ["lang_pred", "lang_score", "lang_evidence"]
    model = train(docs, **options)
    docs = docs.drop(*names)
    told = docs.select(whole_row(docs), "text").withColumn("p", predictor(docs.sparkSession, model)("text"))
    return told.select("row.*", F.col("p.lang").alias(names[0]), F.col("p.score").alias(names[1]), F.col("p.evidence").alias(names[2]))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without those the classifier rejects: `und`, or no n-gram known from any language."""
    told = docs.select(whole_row(docs), "text").withColumn("p", predictor(docs.sparkSession, train(docs, **options))("text"))
    return told.filter("p.lang != 'und' AND p.evidence").select("row.*")
