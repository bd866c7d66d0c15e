from collections import Counter
from fractions import Fraction

import pytest

from sealcheck.llm import mixing
from tests.llm.cases import awkward, empty


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 3, 1, 1], [0.61, 0.2, 0.13, 0.05, 0.01], [1], [1] * 37])
def test_period_meets_every_window(weights):
    blocks = mixing.shares(weights)
    period = sum(blocks)
    slots = mixing.period_slots(blocks)
    assert sorted(t for s in slots for t in s) == list(range(period))
    owner = {t: i for i, s in enumerate(slots) for t in s}
    given = [0] * len(blocks)
    for t in range(period):
        given[owner[t]] += 1
        assert all(abs(g - a * (t + 1) / period) < 1 for g, a in zip(given, blocks))


def test_schedule_keeps_all_blocks_and_the_weights(spark):
    sizes = {"a": 400, "b": 130, "c": 37, None: 20}
    rows = [(i * 1000 + k, f"t{i}-{k}", s) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 2, "b": 1, "c": 1, None: 0.5}
    got = mixing.mix(docs, weights, block_rows=4, bucket_rows=16).orderBy("mix_position").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert len({r["mix_position"] for r in got}) == len(rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    seen, total, slots = Counter(), sum(weights.values()), {}
    for r in got:
        slots.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    for t in range(min(-(-n // 4) / weights[s] for s, n in sizes.items()).__floor__()):
        seen[next(iter(slots[t]))] += 1
        assert all(abs(seen[s] - weights[s] / total * (t + 1)) < 1 + 2e-3 * (t + 1) for s in weights)


@pytest.mark.parametrize("weights", [[0.9995, 0.0005], [1, 1, 1], [n ** 0.5 for n in (71, 13, 900, 4, 4, 57, 310, 2)], [0.61, 0.2, 0.13, 0.05, 0.01], [3e-9, 1, 7]])
def test_deviation_from_the_target_below_one_block_over_many_periods(weights):
    first = 20_000
    total = sum(Fraction(w) for w in weights)
    share = [Fraction(w) / total for w in weights]
    sizes = [int(first * x) + 1 for x in share]
    given, seen = [0] * len(weights), set()
    for source, block, release, slot, deadline in mixing.schedule(sizes, weights):
        assert block == given[source] and release <= slot < deadline and slot == len(seen)
        seen.add((source, block))
        given[source] += 1
        if slot + 1 <= first:
            assert release == block / share[source] // 1 and deadline == -(-(block + 1) / share[source] // 1) or given[source] == sizes[source]
            assert all(abs(g - x * (slot + 1)) < 1 for g, x in zip(given, share))
    assert given == sizes


def test_more_sources_than_the_old_limit(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"host{i % 2100}") for i in range(4300)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4300)) and sorted(r["mix_slot"] for r in got) == list(range(4300))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)


def test_weights_left_out_and_zero(spark):
    docs = spark.createDataFrame([(i, "x", "a" if i % 3 else "b") for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mix(docs, {"a": 1.0}, block_rows=1).orderBy("mix_position").collect()
    assert [r["source"] for r in got] == ["a"] * 60 + ["b"] * 30


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs)
    assert got.columns == docs.columns + ["mix_slot", "mix_release", "mix_deadline", "mix_position"]
    plain = lambda frame: sorted(map(repr, frame.select("doc_id", "text", "source", "`a.b`").collect()))
    assert plain(got) == plain(docs)
    assert mixing.mix(empty(spark)).count() == 0
