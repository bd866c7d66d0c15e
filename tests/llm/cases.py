"""Awkward documents that every operator and stage must take: nulls, empty and very long texts, ties, equal rows, clashing names."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, bucket string, `a.b` int"


def prose(seed: int, words: int, letters: str = "aeioustrnlmd") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(words))


def awkward(spark):
    long = prose(7, 6000)
    same = prose(8, 60)
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, None, "en", "a"), (3, "   \n\t\n", None, "b"), (4, "12 34 !!", "en", None), (5, "word", "en", "b"),
            (6, same, "en", "a"), (7, same, "en", "a"), (7, same, "en", "a"), (7, prose(9, 40), "en", "b"), (8, long, "en", "a"), (9, prose(10, 80, "éüñçgb"), "fr", "b"),
            (10, prose(11, 80, "éüñçgb"), "fr", None), (None, prose(12, 50), "en", None), (11, "日本語のテキスト", None, "a"), (12, same + " more", "en", "c")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "b", 2) for i, t, lang, s in rows], EXTRA)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], EXTRA)
