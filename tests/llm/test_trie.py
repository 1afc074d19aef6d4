"""The prefix trie against plain recursion over small conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, v string"


def by_hand(rows):
    """Node rows by recursion over prefixes as tuples."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest(), (r, t)))
    own = {c: [x[-1] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in children[node]) or 1
        saved = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(out[k][6] for k in children[node])
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest())
    return sorted(out.values(), key=str)


def some_conversations(rng, n, long=0):
    rows = []
    for c in rng.sample(range(-150, 650), n):
        for turn in range(rng.randint(1, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello", "größe", "日本"]), 1, "x"))
    rows += [(7, t, "user", f"t{t}", 1, "x") for t in range(long)]
    return rows


@pytest.mark.parametrize("size", [1024, 3])
def test_tries_of_random_conversations(spark, monkeypatch, size):
    """With slices of three turns every conversation runs over several of them."""
    monkeypatch.setattr(trie, "SLICE", size)
    monkeypatch.setattr(trie, "ENDS_BITS", 2)
    rows = some_conversations(random.Random(size), 90, long=40)
    rows += [(None, 1, "user", "gone", 1, "x"), (3, None, None, None, 1, "x"), (3, None, "user", "", 1, "x"), (900, 1, "user", "hi", 1, "x"), (900, 1, "user", "hi", 1, "x")]
    got = sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert got == by_hand(rows)


def test_no_conversations_and_turnless_ones(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(frame).collect() == []
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(alone, 1, "user", "hi", 1, "x")]
    assert [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()] == by_hand(rows)
    assert by_hand(rows)[0][:2] == (alone, 0)


def test_totals_of_chains_stars_and_combs(spark):
    """Trees as parents: a chain, a star, a comb (a chain with a leaf at each node), a balanced tree, random ones."""
    rng = random.Random(5)
    trees = [
        [max(0, i - 1) for i in range(150)], [0] * 60, [max(0, i - 2) if i % 2 else max(0, i - 2) for i in range(80)],
        [(i - 1) // 2 if i else 0 for i in range(127)], [rng.randrange(max(1, i)) for i in range(120)], [0],
    ]
    for parents in trees:
        rows = [(i, None if i == 0 else parents[i], i * i % 17, 1) for i in range(len(parents))]
        got = {r["v"]: (r["a"], r["b"]) for r in trie.subtree_totals(spark.createDataFrame(rows, "v long, p long, a long, b long"), ["a", "b"]).collect()}
        want = {i: [a, b] for i, _, a, b in rows}
        for i in range(len(parents) - 1, 0, -1):
            for k in (0, 1):
                want[parents[i]][k] += want[i][k]
        assert got == {i: tuple(x) for i, x in want.items()}


def test_shared_turns_are_crc32(spark):
    got = spark.range(-50, 50).select("id", trie.shared_turns(F.col("id")).alias("h")).collect()
    assert all(r["h"] == zlib.crc32(str(r["id"]).encode()) % 6 for r in got)
