"""Column functions against plain Python on awkward text, and JSON semantics."""

import hashlib
import json
import random
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from sealcheck.functions import ids, jsonfn as J, text as X
from sealcheck.operators import pages as P

PIECES = ["a", "Ü", "€", "𝄞", " ", ".", "/", "<", "\t", " ", "con", "é", "-", "9", " ", "*"]


def texts(count=400, seed=7):
    chance = random.Random(seed)
    fixed = ["", " ", "con", "CON.txt", "lpt1", "..", "a.b.c", "x" * 200, "é" * 60, "€" * 40, "𝄞" * 30, ".hidden", "nul.", "a\nb", "\x7f"]
    return fixed + ["".join(chance.choices(PIECES, k=chance.randrange(120))) for _ in range(count)]


def space(char):
    return char in "\t\n\v\f\r\x85" or unicodedata.category(char).startswith("Z")


def strip(value):
    while value and space(value[0]):
        value = value[1:]
    while value and space(value[-1]):
        value = value[:-1]
    return value


def cut(value, limit):
    return value.encode()[:limit].decode(errors="ignore")


def component(name, suffix):
    out, blank = [], False
    for char in strip(name):
        char = "_" if unicodedata.category(char) == "Cc" or char in '<>:"/\\|?*' else char
        if space(char):
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(char)
            blank = False
    name = cut("".join(out).strip(" ."), 96 - len(suffix) - 2).rstrip(" .") or "unnamed"
    stem = name.rsplit(".", 1)[0] if "." in name else name
    reserved = stem.upper() in X.RESERVED_NAMES
    return ("_" if reserved else "") + name + "--" + suffix


def test_text_functions_agree_with_python(spark):
    rows = [(n, value) for n, value in enumerate(texts())]
    frame = spark.createDataFrame(rows, "n int, t string")
    got = frame.select("n", "t", X.safe_component(F.col("t"), F.lit("sc_" + "ab" * 32)).alias("component"), X.safe_text(F.col("t"), 50).alias("safe"),
                       X.is_blank(F.col("t")).alias("blank"), X.code_block(F.col("t")).alias("code"), X.cut_bytes(F.col("t"), 10).alias("cut")).collect()
    for row in got:
        assert row.component == component(row.t, ("ab" * 32)[:16]), repr(row.t)
        clean = strip("".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in row.t))
        assert row.safe == (clean if len(clean.encode()) <= 50 else cut(clean, 47) + "..."), repr(row.t)
        assert row.blank == (strip(row.t) == "")
        assert row.cut == cut(row.t, 10)
        lines = row.t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert row.code == "".join("    " + line + "\n" for line in lines)


def test_paths_that_leave_their_root(spark):
    cases = {"a/b": False, "a/../b": False, "../x": True, "/abs": True, "": True, ".": True, "a/..": True, "a/../../b": True, "./a": False}
    frame = spark.createDataFrame([(p, e) for p, e in cases.items()], "p string, e boolean")
    assert frame.filter(X.escapes_root(F.col("p")) != F.col("e")).count() == 0


def test_canonical_json_keeps_literals_and_refuses_rest(spark):
    cases = {'{"b":1.50,"a":[1e2,-0]}': '{"a":[1e2,-0],"b":1.50}', "1 2": None, "NaN": None, '"<&>"': '"\\u003c\\u0026\\u003e"',
             '{"a":1,"a":2}': '{"a":2}', "": None, "null": "null", "12345678901234567890123": "12345678901234567890123"}
    frame = spark.createDataFrame(list(cases.items()), "d string, e string")
    for row in frame.select("d", "e", J.canonical_json(F.col("d")).alias("got")).collect():
        assert row.got == row.e, row.d
    member = spark.createDataFrame([('{"v":1.50}',), ('{"v":null}',), ("{}",)], "d string").select(J.canonical_member(F.col("d"), F.lit("v")).alias("v"))
    assert [r.v for r in member.collect()] == ["1.50", "null", None]


def test_raw_members_tell_kinds_apart(spark):
    document = json.dumps({"s": "5", "n": 5, "b": True, "z": None, "o": {"status": "x", "type": "y"}, "blank": " ", "neg": -1})
    frame, f = J.with_members(spark.createDataFrame([(document,)], "d string"), "d", ["s", "n", "b", "z", "o", "blank", "neg", "gone"], "m")
    row = frame.select(J.raw_string(f["n"]).alias("a"), J.raw_scalar(f["n"]).alias("b"), J.mistyped(f["n"], J.raw_string(f["n"])).alias("c"),
                       J.mistyped(f["z"], J.raw_string(f["z"])).alias("d"), J.source_id(f["blank"]).alias("e"), J.source_id(f["neg"]).alias("f"),
                       J.source_id(f["n"]).alias("g"), J.raw_int(f["s"]).alias("h"), J.mistyped(f["gone"], J.raw_int(f["gone"])).alias("i")).first()
    assert tuple(row) == (None, "5", True, False, None, None, "5", 5, False)


NUMBERS = ["1.50", "1e2", "-0.0", "1E+05", "0.1e-3", "12345678901234567890.10", "0", "-7", "100"]


def test_scalars_keep_their_spelling(spark):
    rest = '"s":"1.50, \\\\\\"2e5\\\\\\"","o":{"priority":%s,"t":"x 1.5"},"l":[%s,"1.5",[%s]],"i":5'
    rows = [(n, '{"v": %s ,%s}' % (n, rest % (n, n, n))) for n in NUMBERS]
    frame, f = J.with_members(spark.createDataFrame(rows, "n string, d string"), "d", ["v", "s", "o", "l", "i"], "m")
    for r in frame.select("n", J.raw_scalar(f["v"]).alias("v"), J.raw_string(f["v"]).alias("no"), J.raw_string(f["s"]).alias("s"), f["o"].text.alias("o"),
                          f["l"].text.alias("l"), J.priority_field(f["o"]).alias("p"), J.raw_double(f["v"]).alias("f"), J.raw_int(f["i"]).alias("i")).collect():
        assert (r.v, r.no, r.s, r.p, r.f, r.i) == (r.n, None, '1.50, \\"2e5\\"', r.n, float(r.n), 5)
        assert r.o == '{"priority":%s,"t":"x 1.5"}' % r.n and r.l == '[%s,"1.5",[%s]]' % (r.n, r.n)


def test_marks_and_broken_documents(spark):
    mark = "\uE0F1"
    cases = {'{"v":1.50,"w":"M1.5"}': ("1.50", "M1.5"), '{"v":1.50,"w":"\\ue0f11.5M\\uE0F1"}': ("1.50", "M1.5MM"), '{"v":2,"w":"\\\\ue0f1"}': ("2", "\\ue0f1"),
             '{"w":"\\"M2","v":{"a":"M2","b":[1.50,"MM1.50"]}}': (None, '"M2'), '{"v":"M","w":"MM"}': ("M", "MM"),
             '{"v":01.50}': (None, None), '{"v":1.}': (None, None), '{"v":"1.50"}': ("1.50", None), '{"w":"a1.5","v":2.50}': ("2.50", "a1.5"),
             "1.50": (None, None), "": (None, None)}
    cases = {d.replace("M", mark): tuple(x and x.replace("M", mark) for x in e) for d, e in cases.items()}
    frame, f = J.with_members(spark.createDataFrame([(d,) for d in cases], "d string"), "d", ["v", "w"], "m")
    rows = frame.select("d", J.raw_scalar(f["v"]).alias("v"), J.raw_string(f["w"]).alias("w"), f["w"].json.alias("j"), f["v"].text.alias("t")).collect()
    assert {r.d: (r.v, r.w) for r in rows} == cases
    assert all(r.w is None or json.loads(r.j) == r.w for r in rows)
    assert [r.t for r in rows if r.d.startswith('{"w":"\\"')] == ['{"a":"M2","b":[1.50,"MM1.50"]}'.replace("M", mark)]


def test_array_elements_keep_their_spelling(spark):
    frame = spark.createDataFrame([('[1.50,"1.50",{"id":1e2,"l":[-0.0]},null,7,"\uE0F13.0"]',), ('{"a":1.50}',), (None,)], "d string")
    rows = [r.e for r in frame.select(J.json_items(F.col("d")).alias("e")).collect()]
    assert rows == [["1.50", "1.50", '{"id":1e2,"l":[-0.0]}', None, "7", "\uE0F13.0"], None, None]


def test_long_document_of_numbers(spark):
    body = '{"l":[' + ",".join(["1.50", "7", '"a\\\\nb"', '{"x":[2e1]}'] * 100_000) + '],"v":3.10}'
    frame, f = J.with_members(spark.createDataFrame([(body,)], "d string"), "d", ["l", "v"], "m")
    assert tuple(frame.select(J.raw_scalar(f["v"]), F.length(f["l"].text)).first()) == ("3.10", len(body) - len('{"l":,"v":3.10}'))


def test_digest_ignores_order_and_partitions_but_not_content(spark):
    rows = [("s", str(n % 50), None if n % 7 else "x") for n in range(500)]
    def digest(data, parts):
        return ids.table_digest(spark.createDataFrame(data, "snapshot_id string, a string, b string").repartition(parts), ["a", "b"]).first().digest
    assert digest(rows, 1) == digest(rows[::-1], 8)
    assert digest(rows, 1) != digest(rows[1:], 1)
    assert digest([("s", "ab", "c")], 1) != digest([("s", "a", "bc")], 1)
    assert digest([("s", "", None)], 1) != digest([("s", None, "")], 1)


def tree_digest(rows, leaf):
    """The tree of one group in plain Python."""
    hashes = Counter(hashlib.sha256("".join("-" if v is None else f"={len(v.encode())}:{v}" for v in row).encode()).hexdigest() for row in rows)
    levels = next(n for n in range(1, 7) if n == 6 or len(rows) <= leaf * 256 ** n)

    def node(prefix):
        if len(prefix) == 2 * levels:
            parts = [f"{h}:{n}" for h, n in hashes.items() if h.startswith(prefix)]
        else:
            parts = [f"{p}={node(p)}" for p in {h[:len(prefix) + 2] for h in hashes if h.startswith(prefix)}]
        return hashlib.sha256(",".join(sorted(parts)).encode()).hexdigest()

    return "sha256:" + hashlib.sha256(f"{len(rows)},{node('')}".encode()).hexdigest()


def test_digest_is_the_root_of_a_tree_of_buckets(spark):
    data = [("big", str(n % 700), None if n % 7 else "é") for n in range(900)] + [("small", "a", None), ("small", "a", None), (None, "x", "y")]
    frame = spark.createDataFrame([(*r, 1) for r in data], "snapshot_id string, a string, b string, n int")
    for leaf in (4096, 2, 1):
        got = {r.snapshot_id: (r.n_rows, r.digest) for r in ids.table_digest(frame, ["a", "b"], leaf=leaf).collect()}
        for group in ("big", "small", None):
            rows = [r[1:] for r in data if r[0] == group]
            assert got[group] == (len(rows), tree_digest(rows, leaf))
    assert ids.table_digest(frame.limit(0), ["a", "b"]).count() == 0


def test_digest_tells_changed_moved_and_doubled_rows(spark):
    base = [("s", str(n)) for n in range(300)] + [("t", str(n)) for n in range(300, 400)]

    def digests(rows):
        return {r.snapshot_id: r.digest for r in ids.table_digest(spark.createDataFrame(rows, "snapshot_id string, a string"), ["a"]).collect()}

    want = digests(base)
    changed, moved, doubled = digests([("s", "x")] + base[1:]), digests([("t", "0")] + base[1:]), digests(base[:1] + base)
    assert len({d["s"] for d in (want, changed, moved, doubled)}) == 4 and moved["t"] != want["t"] == doubled["t"]
    # The same rows and the same count, other multiplicities.
    assert digests([("s", "0"), ("s", "0"), ("s", "2")])["s"] != digests([("s", "0"), ("s", "2"), ("s", "2")])["s"]


def test_deep_and_refused_json():
    deep = "[" * 5000 + "1.50" + "]" * 5000
    assert J._canonical(deep) == deep
    assert J._elements('{"v":[1,NaN,{"a":1.50}]}', "v") == (True, ["1", None, '{"a":1.50}'])
    assert J._elements('{"v":[1]} x', "v") == (False, None) and J._elements('{"w":[1]}', "v") == (True, None)
    assert J._member('{"v":NaN}', "v") is None and J._override('{"v":1}', "[]") is None
    for text in ['{"b":1,"a":[1,{"x":null}]}', " [1, 2 ] ", "1 2", "1],[2", '{"a":1,}', "[1,]", "{a:1}", "NaN", "", '{"a":1}}', "01", "1.", '{"a":1,"a":2}', "[[],{}]"]:
        plain = J._canonical(text)
        try:
            slow = J._encode(J._parse_deep(text))
        except ValueError:
            slow = None
        assert plain == slow


def test_valid_json(spark):
    deep = "[" * 5000 + "]" * 5000
    cases = {"1": True, ' {"a": 1} ': True, '"x"': True, "null": True, deep: True, "1 2": False, "1,2": False, "1],[2": False, '1,"b":2': False, "{oops": False, "": False, "NaN": False}
    frame = spark.createDataFrame([(t,) for t in cases], "d string").select("d", J.valid_json(F.col("d")).alias("v"))
    assert {r["d"]: r["v"] for r in frame.collect()} == cases


def test_nested_members_parse_once(spark):
    """Naming a parsed value many times must not parse it many times: the plan grows with the members, not with their uses."""
    frame, f = J.with_members(spark.createDataFrame([('{"status":{"status":"a","type":"b"},"priority":{"priority":1.50}}',)], "d string"), "d",
                              ["status", "priority"], "m")
    state, kind = J.status_fields(f["status"])
    out = frame.select(state.alias("s"), kind.alias("k"), J.priority_field(f["priority"]).alias("p"))
    assert tuple(out.first()) == ("a", "b", "1.50")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 50 and plan.count("from_json") < 12


def test_json_of_a_member_holds_its_own_marks(spark):
    mark = J._MARK
    frame, f = J.with_members(spark.createDataFrame([('{"v":"x%s1\\"","w":{"a":"%s2.5","b":2.50}}' % (mark, mark),), (None,), ("{",)], "d string"), "d", ["v", "w"], "m")
    rows = frame.select(f["v"].text.alias("t"), f["v"].json.alias("j"), f["v"].kind.alias("k"), f["w"].text.alias("w"), f["w"].kind.alias("o")).collect()
    assert tuple(rows[0]) == (f'x{mark}1"', f'"x{mark}1\\""', "string", '{"a":"%s2.5","b":2.50}' % mark, "object")
    assert [tuple(r) for r in rows[1:]] == [(None, "null", "null", None, "null")] * 2


def test_exact_pages_are_parsed_once(spark):
    bodies = ['{"l":[1.50,{"a":NaN},[2]]}', '{"l":[]}', '{"l":null}', "{}", '{"l":[1]} x', None, '{"l":{"a":1}}']
    pages = spark.createDataFrame([("s", f"p{i}", b) for i, b in enumerate(bodies)], "snapshot_id string, raw_path string, body string")
    elements, found = P.explode_pages(pages, "l", exact=True)
    for frame in (elements, found):
        assert "EvalPython" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert elements.columns == ["snapshot_id", "raw_path", "position", "element"]
    assert sorted(tuple(r)[1:] for r in elements.collect()) == [("p0", 0, "1.50"), ("p0", 2, "[2]")]
    assert sorted((r.code, r.key) for r in found.collect()) == [
        ("BODY_NOT_JSON", "p4"), ("BODY_NOT_JSON", "p5"), ("ELEMENT_NOT_JSON", "p0#1"),
        ("REQUIRED_ARRAY_MISSING", "p2"), ("REQUIRED_ARRAY_MISSING", "p3"), ("REQUIRED_ARRAY_MISSING", "p6")]
    assert P.explode_pages(pages, "l", required=False, exact=True)[1].filter("code = 'REQUIRED_ARRAY_MISSING'").isEmpty()
