"""The stream reaches the batch result, whatever the order and number of repeats."""

import json
import random

import pytest

from sealcheck.operators.events import dedupe_events, latest_events
from sealcheck.operators.state import project_state
from sealcheck.sources.events import read_events, stream_events
from sealcheck.streaming import events as S
from sealcheck.streaming.events import dedupe_stream, read_appended, read_merged, run_available, state_stream

KINDS = [("operation.started", "STARTED", {}), ("operation.completed", "SUCCEEDED", {"archive_path": "/a"}), ("operation.failed", "FAILED", {"reason": "NETWORK_FAILURE"}),
         ("verification.recorded", "SUCCEEDED", {"result": "VERIFIED", "archive_path": "/a", "manifest_checksum": "c"}), ("connector.unhealthy", None, {"health_state": "DEGRADED", "reason": "NONE"})]


def line(operation, sequence, scope, chance):
    kind, outcome, metadata = chance.choice(KINDS)
    event = {"schema_version": chance.choice([1, 2]), "type": kind, "operation_id": f"op{operation:03d}", "sequence": sequence, "recorded_at": "2024-01-01T00:00:00Z",
             "source": {"connector": " c ", "workspace_id": f"w{scope}", "destination": "/d//x/"}, "operation": "backup", "stage": "scan", "message": "m", "metadata": metadata}
    return json.dumps(event | ({"outcome": outcome} if outcome else {}))


def test_stream_equals_batch(spark, tmp_path):
    chance = random.Random(5)
    lines = [line(operation, sequence, operation % 3, chance) for operation in range(40) for sequence in range(1, 8)]
    repeated = lines + chance.sample(lines, 120)
    chance.shuffle(repeated)
    damaged = ["not json", '{"schema_version":9}', lines[0].replace('"stage": "scan"', '"surprise": 1'), lines[0].replace("backup", "dance"), "x" * 70000,
               lines[0].replace('"connector"', '"owner": 1, "connector"'), lines[0].replace('"message"', '"foo_version": "1", "message"')]
    log = tmp_path / "log"
    log.mkdir()
    for number in range(8):
        (log / f"events-{number}.jsonl").write_text("\n".join(repeated[number::8] + ['', '  '] + damaged[number:number + 1]) + "\n")
    events, unreadable = read_events(spark, str(log))
    assert unreadable.first().unreadable == len(damaged)
    unique = dedupe_events(events)
    assert unique.count() == len(lines)
    assert {r.destination for r in unique.select("destination").distinct().collect()} == {"/d/x"}
    want = project_state(unique)
    stream = stream_events(spark, str(log), files_per_trigger=1).filter("NOT unreadable")
    run_available(state_stream(stream), str(tmp_path / "state"), str(tmp_path / "c1"))
    got = read_merged(spark, str(tmp_path / "state"))
    assert got.count() == 3 and got.select(*want.columns).exceptAll(want).count() == 0
    run_available(dedupe_stream(stream.select("operation_id", "sequence", "type")), str(tmp_path / "unique"), str(tmp_path / "c2"), mode="append")
    assert read_appended(spark, str(tmp_path / "unique")).count() == len(lines)


def test_a_batch_that_failed_counts_once(spark, tmp_path, monkeypatch):
    """The second batch fails half way and after its write; the run is taken up again and gives the batch result."""
    chance, log = random.Random(8), tmp_path / "log"
    log.mkdir()
    for n in range(4):
        (log / f"events-{n}.jsonl").write_text("".join(line(20 * n + i, 1, i % 5, chance) + "\n" for i in range(20)))
    stream = stream_events(spark, str(log), files_per_trigger=1).filter("NOT unreadable")
    want = project_state(read_events(spark, str(log))[0])
    state, rows = str(tmp_path / "state"), str(tmp_path / "rows")

    for early in (True, False):
        for mode, target, source, name in (("update", state + str(early), state_stream(stream), "merge_batch"),
                                           ("append", rows + str(early), stream.select("operation_id", "sequence", "type"), "append_batch")):
            whole, left = getattr(S, name), [1]

            def failing(*arguments, whole=whole, left=left, early=early):
                write = whole(*arguments)

                def run(batch, number):
                    if number != 1 or not left:
                        return write(batch, number)
                    left.pop()
                    if early:
                        (batch.limit(2)).write.mode("append").parquet(f"{arguments[0]}/{'version' if 'state' in arguments[0] else 'batch'}={number}")
                        (tmp_path / arguments[0].split("/")[-1] / f"{'version' if 'state' in arguments[0] else 'batch'}={number}" / "_SUCCESS").unlink()
                    else:
                        write(batch, number)
                    raise ValueError("lost")
                return run

            monkeypatch.setattr(S, name, failing)
            with pytest.raises(Exception, match="lost"):
                run_available(source, target, target + "-offsets", mode)
            run_available(source, target, target + "-offsets", mode)
            monkeypatch.setattr(S, name, whole)
        got = read_merged(spark, state + str(early))
        assert got.count() == want.count() == 5 and got.select(*want.columns).exceptAll(want).count() == 0
        assert read_appended(spark, rows + str(early)).count() == 80 == read_appended(spark, rows + str(early)).distinct().count()
        assert len([p for p in (tmp_path / f"state{early}").iterdir() if p.name.startswith("version=")]) == 2


def test_rotated_file_comes_before_the_current_one(spark, tmp_path):
    chance = random.Random(1)
    first, second = [json.loads(line(1, 1, 0, chance)) | {"message": m} for m in ("first", "second")]
    # The current file is older on disk, as after a copy.
    (tmp_path / "events.jsonl").write_text(json.dumps(second) + "\n")
    (tmp_path / "events.old.jsonl").write_text("\n" + json.dumps(first | {"writer_version": "1"}) + "\n")
    events, unreadable = read_events(spark, str(tmp_path), writer_key="writer_version")
    assert unreadable.first().unreadable == 0 and {r.schema_version for r in events.collect()} == {2}
    assert [r.message for r in dedupe_events(events).collect()] == ["first"]


def test_large_limits_are_cut_before_the_shuffle(spark):
    events = spark.range(100_000).selectExpr("id % 3 AS connector", "CAST(id AS STRING) AS operation_id", "id AS sequence")
    plan = latest_events(events, 5000, ["connector"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, plan
