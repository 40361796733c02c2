"""The trie of conversations against one made of all prefixes, at many sizes of shards and merges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from llm.conftest import multiset, pieces
from rowscrub.llm import turntrie as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, n_convs long, block int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def code(turn):
    role, text = turn[1] or "", turn[2] or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, *turn in rows:
        if c is not None:
            own[c].append(turn)
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, code(t)))
        own[c] = [(r or "", x or "") for _, r, x in turns]
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        full[c] = tuple(base[:h] + turns[h:])
    return full


def nodes(rows):
    """Every node, by all prefixes."""
    full = rebuilt(rows)
    members, children, below = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    found = []
    for p, convs in members.items():
        ends = sorted(c for c in convs if full[c] == p)
        saved = sum((len(members[q]) - 1) * len(pieces(q[-1][1])) for q in below[p] if q)
        leaves = sum(q not in children for q in below[p])
        parent = min(members[p[:-1]]) if p else None
        hash_ = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        found.append((min(convs), len(p), parent, len(convs), len(children[p]) if p in children else 0, leaves, saved, hash_))
    return sorted(found, key=repr)


def talk(seed, n):
    """Conversations with common beginnings, copies, beginnings of others, gaps, ties and nulls."""
    draw = random.Random(seed)
    lines = [" ".join(draw.choice("ab cé\t日") for _ in range(draw.randint(0, 9))) for _ in range(12)] + [None, ""]
    rows = []
    for c in range(n):
        kind = draw.random()
        if kind < 0.3:
            turns = [("user", "hello there"), ("assistant", "yes  sir")] + [("user", "go")] * draw.randint(0, 4)
        elif kind < 0.4:
            continue
        else:
            turns = [(draw.choice(["user", "assistant", None]), draw.choice(lines)) for _ in range(draw.randint(1, 7))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, None if i == 0 and draw.random() < 0.2 else i - draw.randint(0, 1), role, text))
    rows += [(None, 1, "user", "x"), (-7, 1, "user", "hello there"), (-40, 2, None, None), (5_000_000_000, 1, "user", "hello there")]
    rows += [(11, None, None, None), (11, None, None, None)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "p", 9, 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("turns", "together", "partitions", "broadcast"), [(4, 2, 9, True), (40, 3, 5, False), (1 << 17, 64, 4, True)])
def test_against_all_prefixes(spark, monkeypatch, turns, together, partitions, broadcast):
    rows = talk(turns, 260)
    monkeypatch.setattr(T, "SHARD_TURNS", turns)
    monkeypatch.setattr(T, "TOGETHER", together)
    if not broadcast:
        monkeypatch.setattr(T, "broadcast_bytes", lambda spark: 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = T.conversation_trie(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got[0].__fields__) == COLUMNS
    assert sorted(map(tuple, got), key=repr) == nodes(rows)


def test_many_shards_in_one_task(spark):
    """Nodes at borders inside a task have their ids and give their children theirs."""
    rows = talk(8, 260)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # each batch is a shard
    try:
        got = T.conversation_trie(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == nodes(rows)


@pytest.mark.parametrize("turns", [1, 3, 10, 1000])
def test_shards_and_merges_without_spark(turns):
    """Any cut into shards, merged two at a time, gives the same nodes."""
    full = sorted((bytes.fromhex("".join(code((None, *t)) for t in s)), c, [len(pieces(x)) for _, x in s]) for c, s in rebuilt(talk(3, 200)).items())
    out, left = T.Table(), []
    for a in range(0, len(full), turns):
        part = full[a : a + turns]
        found = T.shard_nodes([p for p, _, _ in part], [w for _, _, w in part], [c for _, c, _ in part], out)
        left = T.merged([left, found], out, False) if left else found
    assert T.merged([left], out, True) == []
    rows = [dict(zip(out.columns, r, strict=True)) for r in zip(*out.columns.values(), strict=True)]
    got = sorted((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in rows if r["kind"] == T.CLOSED)
    assert got == sorted((n[0], n[1], *n[3:7]) for n in nodes(talk(3, 200)))


def test_middle_first_keeps_the_tree_low():
    assert sorted(T.balanced(1000)) == list(range(1000))
    tree = T.SearchTree()
    for i in T.balanced(1000):
        tree.insert([i], i)

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.less[at]), height(tree.more[at]))

    assert height(tree.after[0]) == 10


def test_odd_tables(spark):
    assert T.conversation_trie(frame(spark, [], 1)).collect() == []
    assert T.conversation_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    assert sorted(map(tuple, T.conversation_trie(frame(spark, [(7, None, None, None)])).collect()), key=repr) == nodes([(7, None, None, None)])


def test_long_conversation_and_text(spark):
    rows = [(20, i, "user", f"turn {i}") for i in range(6000)] + [(40, 1, "user", "word " * 200_000), (60, 1, "user", "word " * 200_000)]
    got = {(r["conv_id"], r["depth"]): r for r in T.conversation_trie(frame(spark, rows)).collect()}
    assert len(got) == 6002
    assert got[20, 1]["saved_tokens"] == 0
    assert got[20, 6000]["n_children"] == 0
    assert got[40, 1]["saved_tokens"] == 200_000
    assert got[20, 0]["n_leaves"] == 2
    assert sum(multiset(frame(spark, rows)).values()) == 6002
