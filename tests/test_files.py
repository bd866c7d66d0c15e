"""Files in pieces and JSON arrays in ranges, against whole reads."""

import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sealcheck.operators.normalize import attachment_outcomes
from sealcheck.sources import arrays, evidence as E, files as X
from tests import archive

NASTY = ['a"b', "\\", '\\"', "},{", "[", "]]", "ü€𝄞", '"', "\\\\", "", "x" * 300, '","y":[', "\n\t"]


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rnd.choice(NASTY) + rnd.choice(NASTY)
    if kind < 4:
        return rnd.choice([1, -2.5, None, True, 10 ** 20])
    if kind < 6:
        return {rnd.choice(NASTY) + str(i): value(rnd, depth + 1) for i in range(rnd.randrange(4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def listed(spark, *paths):
    return spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in paths], "path string, bytes long")


def read(spark, path, member=None, range_bytes=64):
    rows = arrays.array_elements(listed(spark, path), member, range_bytes).orderBy("offset").collect()
    return [r.element for r in rows if r.offset >= 0], any(r.offset < 0 for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_ranges_give_the_elements_of_the_whole_array(spark, tmp_path, seed):
    rnd = random.Random(seed)
    items = [value(rnd) for _ in range(120)]
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(items, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])))
    holder = tmp_path / "holder.json"
    holder.write_text("\n " + json.dumps({"a": [1, [2]], 'n"': {"items": [[7]]}, "items": items, "z": [], "tail": "items\":[1]"}, ensure_ascii=False))
    for range_bytes in (1 + rnd.randrange(9), 61, 1 << 20) if seed == 1 else (97,):
        for path, member in ((plain, None), (holder, "items")):
            got, broken = read(spark, path, member, range_bytes)
            assert [json.loads(x) for x in got] == items and not broken


def test_lexer_agrees_at_every_cut():
    text = json.dumps([*NASTY, {"k\\": NASTY, '"': ["\\\\\""]}], ensure_ascii=False).encode()
    want = list(arrays.structure(io.BytesIO(text), 0, arrays.OUTSIDE))
    assert want[0] == (0, b"[") and want[-1] == (len(text) - 1, b"]")
    for cut in range(len(text) + 1):
        state, depth = arrays.summary(text[:cut], arrays.OUTSIDE)
        assert depth == sum((t in b"[{") - (t in b"]}") for o, t in want if o < cut)
        assert list(arrays.structure(io.BytesIO(text), cut, state)) == [x for x in want if x[0] >= cut]
        assert arrays.summary(text[cut:], state) == (arrays.OUTSIDE, -depth)


def test_broken_documents_are_told(spark, tmp_path):
    cases = {"[]": ([], False), " [ ] ": ([], False), "[1]": (["1"], False), '["a",]': (['"a"', ""], False), "": ([], True), "{}": ([], True), '{"a":[1]}': ([], True), "7": ([], True),
             '[{"a":1},{"b"': (['{"a":1}', ""], True), '[1,"x': (["1", ""], True), "[1],[2": (["1", "2"], True)}
    for n, (text, (want, broken)) in enumerate(cases.items()):
        path = tmp_path / f"{n}.json"
        path.write_text(text)
        got = read(spark, path, range_bytes=3)
        assert got[1] == broken, text
        if text != "[1],[2":
            assert got[0] == want, text
    path.write_text('{"b":[1]}')
    assert read(spark, path, "items") == ([], True) and read(spark, path, "b") == (["1"], False)


def test_one_ledger_is_the_work_of_many_tasks(spark, tmp_path):
    archive.land(str(tmp_path))
    rows = [{"sequence": n, "operation": f'op "{n}" }},{{', "outcome": "SUCCESS", "raw_path": f"{n}.json", "bytes": n, "other": [n]} for n in range(1, 20_001)]
    (tmp_path / "healthy" / "raw" / "requests.json").write_text(json.dumps(rows))
    ledger = E.read_ledger(spark, str(tmp_path), range_bytes=1 << 16)
    assert [(r.sequence, r.operation, r.bytes) for r in ledger.orderBy("sequence").collect()] == [(r["sequence"], r["operation"], r["bytes"]) for r in rows]
    assert ledger.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {r.snapshot_id for r in ledger.select("snapshot_id").distinct().collect()} == {"healthy"}


def test_objects_without_brackets_are_one_token():
    rnd = random.Random(8)
    rows = json.dumps([{"id": f"r{n}", "text": 'a"}],{[\\', "n": n, "none": None} for n in range(50)]).encode()
    assert len(list(arrays.structure(io.BytesIO(rows), 0, arrays.OUTSIDE, coarse=True))) == 50 + 49 + 2
    texts = [rows, b'[1] {"a":1,"b":2}', b'{"a":1,"b":[{"c":1},{}],"d":{"e":1,"f":2}}', b'[{"a":"\\"}]"},{"b":{"c":1,"d":2}}]']
    texts += [bytes(rnd.choices(b'{}[],"\\a', k=rnd.randrange(1, 40))) for _ in range(3000)]
    for text in texts:
        for level in (1, 2):
            want, depth = [], 0
            for offset, token in arrays.structure(io.BytesIO(text), 0, arrays.OUTSIDE):
                if depth == level and token in b",]}" or depth == level - 1 and token == b"[":
                    want.append((offset, token, depth))
                depth += (token in b"[{") - (token in b"]}")
            tokens = arrays._levels(arrays.structure(io.BytesIO(text), 0, arrays.OUTSIDE, coarse=True), 0, level)
            assert [x for x in tokens if len(x[1]) == 1 and (x[2] == level and x[1] in b",]}" or x[2] == level - 1 and x[1] == b"[")] == want


def test_ranges_of_many_files_are_chained_by_many_tasks(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"id": n, "text": "x],[{" * k} for k in range(20)]))
    cut, tasks = arrays.cut_lineage, []

    def counted(frame):
        if "whole" in frame.columns:
            tasks.append(frame.select(F.spark_partition_id().alias("p")).distinct().count())
        return cut(frame)

    monkeypatch.setattr(arrays, "cut_lineage", counted)
    found = arrays.array_elements(X.list_files(spark, str(tmp_path)), None, 64).collect()
    assert sorted(r.element for r in found) == sorted(json.dumps({"id": n, "text": "x],[{" * k}) for n in range(40) for k in range(20))
    assert tasks[0] > 1


def test_hashes_and_secrets_in_pieces(spark, tmp_path):
    rnd = random.Random(3)
    secrets = ["secret-token", "tökén", "s", ""]
    for n in range(40):
        (tmp_path / f"f {n}%20.bin").write_bytes(rnd.randbytes(rnd.randrange(60)).replace(b"s", b"-") + (rnd.choice(secrets[:3]).encode() if n % 2 else b"secret-toke") * (n % 4 > 0) + b"\x00tail")
    for piece in (1, 7, 64):
        got = {r.path: r for r in X.scan_tree(spark, str(tmp_path), secrets[:2] + [""], piece).collect()}
        for path in tmp_path.iterdir():
            content, row = path.read_bytes(), got[f"file:{path}"]
            assert (row.bytes, row.checksum) == (len(content), "sha256:" + hashlib.sha256(content).hexdigest())
            assert row.has_secret == any(s.encode() in content for s in secrets[:2])
    assert not any(r.has_secret for r in X.scan_tree(spark, str(tmp_path)).collect())


def test_file_above_two_gibibytes(spark, tmp_path):
    path, size = tmp_path / "large.bin", (2 << 30) + 5
    with open(path, "wb") as file:
        file.truncate(size)
        file.seek((1 << 30) - 4)
        file.write(b"a secret")
    row = X.scan_tree(spark, str(tmp_path), ["a secret"]).first()
    with open(path, "rb") as file:
        assert (row.bytes, row.checksum, row.has_secret) == (size, "sha256:" + hashlib.file_digest(file, "sha256").hexdigest(), True)


def test_attachment_with_a_secret_is_refused_and_not_named(spark, tmp_path):
    folder = tmp_path / "s1" / "attachments"
    folder.mkdir(parents=True)
    (folder / "good.txt").write_bytes(b"12345")
    (folder / "bad.txt").write_bytes(b"lead personal-token trail")
    (tmp_path / "s1" / "manifest.json").write_text("{}")
    (tmp_path / "s1" / "notes.json").write_text('{"x": "personal-token"}')
    held = E.file_inventory(spark, str(tmp_path), ["personal-token", "never"])
    assert held.count() == 3
    assert [(r.code, r.key, r.detail) for r in E.secret_findings(held).collect()] == [("SECRET_IN_FILE", "notes.json", None)]
    pending = spark.createDataFrame([("s1", i, n, "PENDING") for i, n in (("good", 5), ("bad", 25), ("gone", 1))], "snapshot_id string, id string, expected_size long, download_status string")
    pending = pending.selectExpr("*", "CAST(NULL AS STRING) AS local_path", "CAST(NULL AS BIGINT) AS archived_size", "CAST(NULL AS STRING) AS checksum", "CAST(NULL AS STRING) AS error")
    out = {r.id: r for r in attachment_outcomes(pending, E.landed_attachments(held)).collect()}
    assert (out["good"].download_status, out["good"].local_path, out["good"].archived_size) == ("RETRIEVED", "attachments/good.txt", 5)
    assert (out["bad"].download_status, out["bad"].local_path, out["bad"].checksum) == ("UNRESOLVED", None, None)
    assert "secret" in out["bad"].error and "personal-token" not in out["bad"].error and out["gone"].error == "no landed file"


def test_bodies_are_fetched_only_when_sound(spark, tmp_path):
    archive.land(str(tmp_path))
    raw = tmp_path / "healthy" / "raw"
    (raw / "unwanted.bin").write_bytes(b"\x00" * 1000)
    (raw / "top.json").write_bytes(b"changed")
    sound, found = E.match_evidence(E.read_ledger(spark, str(tmp_path)), E.landed_bodies(spark, str(tmp_path)))
    assert "content" not in sound.columns and {r.code for r in found.collect()} == {"BYTES_DIFFER"}
    responses, _ = E.read_evidence(spark, str(tmp_path))
    assert {r.raw_path: json.loads(r.body) for r in responses.collect()} == {name: body for _, name, body in archive.BODIES if name != "top.json"}
