import hashlib
import random
import re
import zlib
from collections import defaultdict

from sealcheck.llm import threads
from sealcheck.llm.queries import QUERIES

SHAPE = "conv_id long, turn long, role string, text string, block long, node string, depth int"


def turn_id(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def paths(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    return {conv: [x[3:] for x in sorted(turns)] for conv, turns in said.items()}


def regrafted(said):
    out = {}
    for conv, own in said.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20 if conv >= 0 else -(abs(conv) % 20))
        out[conv] = said.get(base, [])[:h] + own[h:]
    return out


def brute(said):
    members = defaultdict(list)
    for conv, path in said.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[:len(node)] == node]
        children = {v for v in below if len(v) == len(node) + 1}
        leaves = sum(not any(len(u) == len(v) + 1 and u[:len(v)] == v for u in below) for v in below)
        saved = sum((len(members[v]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) for v in below if v)
        ends = ",".join(str(c) for c in sorted(convs) if len(said[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SHAPE)


def found(frame):
    return sorted([tuple(r) for r in frame.drop("turn_id").collect()], key=repr)


def talk(seed, convs, longest=13):
    rnd = random.Random(seed)
    rows = []
    for conv in range(convs):
        depth = rnd.randint(1, longest)
        for turn in range(depth):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "bot", "one two\tthree " * rnd.randint(0, 1) + str(rnd.randint(0, 1 if turn < 3 else 0))))
    return rows


AWKWARD = [(None, 1, "user", "lost"), (3, None, None, None), (3, 2, "user", "b"), (3, 2, "user", "b"), (3, 2, "bot", "a"), (4, 1, "us", "er x"), (5, 1, "user", " x"),
           (6, 1, "", ""), (7, 1, None, ""), (-21, 1, "user", "b"), (-21, 2, "user", "c"), (2 ** 40, 5, "user", "日本 語"), (8, 1, "user", "w " * 3000)]


def test_tree_against_brute_force(spark):
    for rows in (talk(1, 60), AWKWARD + [(c + 50, *r) for c, *r in talk(2, 30, 4)]):
        want = brute(paths(rows))
        for options in ({}, {"width": 1, "chunk": 2}, {"width": 3, "chunk": 1000}):
            assert found(threads.prefix_tree(threads.turns(table(spark, rows)), **options)) == want


def test_query_against_brute_force(spark, tmp_path):
    rows = [(c * 3 + 1, *r) for c, *r in talk(3, 40, 5)] + [(c + 200, *r) for c, *r in talk(4, 45, 5)] + AWKWARD
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    said = regrafted(paths(rows))
    assert any(not path for path in said.values())
    assert found(got) == brute(said)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "string"]


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(600)] + [(c, t, "user", f"same {t}") for c in range(2, 400) for t in range(2)]
    got = {(r.conv_id, r.depth): r for r in threads.prefix_tree(threads.turns(table(spark, rows)), chunk=50).collect()}
    assert len(got) == 603
    assert got[1, 600].ends_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[2, 2].ends_sha256 == hashlib.sha256(",".join(map(str, range(2, 400))).encode()).hexdigest()
    assert (got[1, 0].n_leaves, got[1, 0].saved_tokens, got[2, 1].saved_tokens) == (2, 397 * 4, 397 * 4)
    assert got[1, 300].parent_conv_id == 1


def test_texts_of_nodes(spark):
    frame = table(spark, AWKWARD)
    texts = {bytes(r.turn_id): (r.role, r.text) for r in threads.turn_texts(frame).collect()}
    assert all(bytes(r.turn_id) in texts for r in threads.prefix_tree(threads.turns(frame)).filter("depth > 0").collect())
    assert texts[turn_id("us", "er x")] == ("us", "er x")


def test_empty(spark):
    assert threads.prefix_tree(threads.regraft(threads.turns(table(spark, [])))).count() == 0
    assert threads.prefix_tree(threads.turns(table(spark, AWKWARD[:1]))).count() == 0
