import random
import re

from sealcheck.llm import pii
from tests.llm.cases import awkward, documents, empty

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if sound(k, m[0])]


def spans(frame, column="base"):
    return [(r["doc_id"], [(s["kind"], s["s"], s["e"]) for s in r[column]]) for r in frame.collect()]


def test_base_spans_against_brute_force(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "a@b.c%x@y.z.", "@", ".", "x.y@z", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4465758382889437", "4465 7583-8288 9437", "4465758382889438",
             "+1 (743) 555-3824", "+12", "+1 2 3 4 5 6 7 8 9 ", "é", "日", "\U0001F600", " ", "-", "0" * 15, "Zeta", "%", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))) for i in range(400)] + [(900, "1" * 20000 + "@"), (901, "a" * 20000 + " x@y.z"), (902, None)]
    got = dict(spans(pii.find_personal_data(documents(spark, rows))))
    assert got == {i: base(t) for i, t in rows}


def test_revealing_terms(spark):
    # Zephyr stands by one address only, in three texts; the other words stand everywhere.
    rows = [(i, f"please write to zephyr at z{i % 1}@corp.example about item{i} soon, case {i}") for i in range(3)]
    rows += [(10 + i, f"please write about item{i} soon to x{i}@other.example, case {i}") for i in range(30)]
    found = pii.find_personal_data(documents(spark, rows))
    terms = {r["doc_id"]: [t["v"] for t in r["terms"]] for r in found.collect()}
    assert all(terms[i] == ["zephyr"] for i in range(3)) and not any(terms[10 + i] for i in range(30))
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    assert text[1] == "please write to [term] at [email] about item1 soon, case 1"
    assert not any(r["terms"] for r in pii.find_personal_data(documents(spark, rows), support=4).collect())


def test_terms_of_rare_entities_far_away_and_elsewhere(spark):
    # One address in one text; the word that gives it away stands far from it, twice, and once more in another text.
    filler = "the usual words come here again " * 20
    rows = [(0, f"Quixote {filler} write to q@corp.example {filler} quixote"), (1, f"{filler} again Quixote {filler}")]
    rows += [(i, f"{filler} write to x{i % 40}@other.example") for i in range(10, 610)]
    found = {r["doc_id"]: r["terms"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    places = {d: [(m.start(), m.end()) for m in re.finditer("quixote", t.lower())] for d, t in rows}
    assert len(places[0]) == 2 and len(places[1]) == 1
    assert {d: [(t["s"], t["e"]) for t in ts] for d, ts in found.items()} == places


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert sorted(map(repr, spans(pii.find_personal_data(docs)))) == sorted(repr((r["doc_id"], base(r["text"]))) for r in docs.collect())
    assert pii.find_personal_data(empty(spark)).count() == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_plan_is_native(spark):
    plan = pii.find_personal_data(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
