import numpy as np
from pyspark.sql import functions as F

from sealcheck.llm import language
from tests.llm.cases import awkward, empty, prose


def test_features_are_the_blended_spectrum_kernel():
    letters = "abcdefghijklmnopqrstuvwxyz"

    def plain(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        s = " ".join(s.split(" "))
        while "  " in s:
            s = s.replace("  ", " ")
        out = []
        for n in (1, 2, 3):
            grams = {s[i:i + n] for i in range(len(s) - n + 1)}
            out.append({g for g in grams if g.strip() and (n < 3 or g[1] != " ")})
        return out

    a, b = "The cat, the hat.", "that  chat: Hat"
    shared = len(np.intersect1d(language.grams(a, letters), language.grams(b, letters)))
    assert shared == sum(len(x & y) for x, y in zip(plain(a), plain(b)))
    assert len(language.grams(a, letters)) == sum(map(len, plain(a)))


def test_held_out_accuracy_and_fold(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = language.predict_languages(documents).withColumn("held", language.held_out(5)).toPandas()
    held = told[told.held & told.lang.notna()]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.95
    assert told.lang_score.between(0, 1).all()
    # Labels of the held-out fold are never learned from.
    wrong = documents.withColumn("lang", F.when(language.held_out(5), F.lit("xx")).otherwise(F.col("lang")))
    again = language.predict_languages(wrong).toPandas()
    assert dict(zip(told.doc_id, told.lang_score)) == dict(zip(again.doc_id, again.lang_score))


def test_awkward_rows(spark):
    docs = awkward(spark)
    told = language.predict_languages(docs)
    assert told.columns == docs.columns + ["lang_pred", "lang_score", "lang_evidence"]
    got = {(r["doc_id"], r["text"]): r["lang_pred"] for r in told.collect()}
    assert told.count() == docs.count()
    for text in (None, "", "   \n\t\n", "12 34 !!"):
        assert {v for (_, t), v in got.items() if t == text} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"][:9] for r in kept.collect()) == sorted(r["text"][:9] for r in docs.collect() if r["text"] and any(c.isascii() and c.isalpha() or c in "éüñç" for c in r["text"]))
    assert language.predict_languages(empty(spark)).count() == 0


def test_one_class_ties_and_no_labels(spark):
    rows = [(i, prose(i, 20), None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict_languages(docs).collect()} == {"und"}
    one = docs.withColumn("lang", F.lit("zz"))
    assert {r["lang_pred"] for r in language.predict_languages(one).collect()} == {"zz"}


def test_scripts_with_many_letters_and_more_than_64_languages(spark):
    # Latin with accents and Cyrillic alone have more than 62 letters; each other script comes on top.
    alphabets = {"la": "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçñ", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω",
                 "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "he": "אבגדהוזחטיכלמנסעפצקרשת", "zh": "".join(map(chr, range(0x4e00, 0x4f00))),
                 "ja": "".join(map(chr, range(0x3042, 0x3090))), "ko": "".join(map(chr, range(0xac00, 0xad00)))}
    alphabets |= {f"x{i:02d}": "".join(map(chr, range(0x13000 + 12 * i, 0x13000 + 12 * i + 12))) for i in range(70)}
    rows = [(1000 * i + k, prose(1000 * i + k, 25, letters), lang) for i, (lang, letters) in enumerate(alphabets.items()) for k in range(60 if i < 2 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = language.predict_languages(docs).collect()
    assert len(told) == len(rows) and all(r["lang_pred"] == r["lang"] and r["lang_evidence"] for r in told)
    assert language.keep_identified(docs).count() == len(rows)
    # A script that no row is labelled with stays unknown.
    other = spark.createDataFrame([(-1, prose(5, 25, "აბგდევზთიკლმ"), None)], docs.schema)
    assert language.keep_identified(docs.union(other)).count() == len(rows)
