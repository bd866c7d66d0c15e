import hashlib
from collections import Counter

from sealcheck.llm.warc import fixity_audit, warc_record


def expected(a, b):
    count = lambda rows: Counter((p, hashlib.sha256((r or "").encode()).hexdigest()) for p, r in rows)
    x, y = count(a), count(b)
    return sorted((repr(k), x[k], y[k]) for k in x.keys() | y.keys() if x[k] != y[k])


def audit(spark, a, b, **options):
    left, right = [spark.createDataFrame([(*r, 1) for r in rows], "position long, record string, range int") for rows in (a, b)]
    return fixity_audit(left, right, **options).collect()


def test_against_brute_force(spark):
    a = [(i * 37 % 5000, f"record {i}") for i in range(300)] + [(None, "lost"), (None, None), (3, None), (3, ""), (9, "two"), (9, "two"), (-70, "low")]
    b = [(p, r + "!" if r and p and p % 11 == 0 else r) for p, r in a if p is None or p % 17] + [(10 ** 9, "new"), (9, "two"), (None, "lost")]
    for bits in (1, 6):
        got = audit(spark, a, b, bits=bits)
        assert sorted((repr((r["position"], r["digest"])), r["n_primary"], r["n_replica"]) for r in got) == expected(a, b)
        assert all(r["range_start"] <= r["position"] < r["range_end"] for r in got if r["position"] is not None)


def test_equal_empty_and_one_sided(spark):
    a = [(i, "x") for i in range(10)]
    assert audit(spark, a, list(reversed(a))) == []
    assert audit(spark, [], []) == []
    assert len(audit(spark, a, [])) == 10 and len(audit(spark, [], a)) == 10


def test_record_text(spark):
    got = spark.createDataFrame([("http://x", "é"), (None, None)], "url string, html string").select(warc_record("url", "html").alias("r")).collect()
    assert "Content-Length: 2\r\n\r\né\r\n\r\n" in got[0]["r"] and got[1]["r"].endswith("Content-Length: 0\r\n\r\n\r\n\r\n")
