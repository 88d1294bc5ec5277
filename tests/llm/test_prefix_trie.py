"""The trie of rebuilt conversations against dictionaries; small windows and blocks; hot groups, nulls, ties and long conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from glossgraph.llm import prefix_trie as trie


def rebuilt(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(x, key=lambda t: t[:2])] for c, x in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: h[c]] + own[c][h[c] :] for c in own}


def expected(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    subtree = lambda v: [u for u in members if u[: len(v)] == v]
    children = {}
    for v in members:
        if v:
            children.setdefault(v[:-1], []).append(v)
    out = []
    for v, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(v))
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in subtree(v) if u)
        parent = min(members[v[:-1]]) if v else None
        leaves = sum(u not in children for u in subtree(v))
        out.append((min(m), len(v), parent, len(m), len(children.get(v, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, partitions=4, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    nodes = trie.prefix_trie(*trie.borrowed(trie.numbered(df)), **sizes)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randrange(-12, 40), rng.randrange(100, 130)])
        first = rng.randrange(3)
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn * 10 + first, rng.choice(["user", "bot"]) if turn > 2 else "user", rng.choice(["hi", "é", "a b"]) if turn > 1 else "hello"))
    unique = {(c, t): (c, t, role, text) for c, t, role, text in rows}  # turns of one number are told apart below
    return list(unique.values())


@pytest.mark.parametrize(("window", "block"), [(8192, 256), (4, 256), (3, 2), (1, 1)])
def test_nodes_are_those_of_dictionaries(spark, window, block):
    rows = conversations(window, 60)
    assert found(spark, rows, window=window, block=block) == expected(rows)


def test_nulls_ties_and_absent_bases(spark):
    rows = [(5, None, None, "x"), (5, 0, "a", None), (5, 0, "b", "y"), (None, 1, "a", "lost"), (7, 3, "", "x"), (8, -1, None, "x"), (3, None, "z", ""), (13, 1, None, None), (99, 1, "a", "b"), (-3, 1, "a", "b")]
    rows += [(40 + k, 0, "a", "b") for k in range(1, 5)]  # conversation 40 is absent
    assert found(spark, rows) == expected(rows)
    assert any(len(turns) == 0 for turns in rebuilt(rows).values())


def test_copies_of_one_conversation_and_a_common_first_turn(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(12)] + [(200 + c, t, "user", "turn 0" if t == 0 else f"{c} {t}") for c in range(60) for t in range(10)]
    assert found(spark, rows, 8, window=16) == expected(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    rows = [(0, t, "user", str(t)) for t in range(400)] + [(5 * c, t, "user", str(t)) for c in range(1, 9) for t in range(100)]
    rows += [(1000, 1, "user", "same")] * 50  # repeated rows are turns of their own
    assert found(spark, rows, block=16) == expected(rows)


def test_places_of_turns(spark):
    df = spark.createDataFrame([(1, t, "r", str(t)) for t in random.Random(2).sample(range(500), 500)] + [(2, None, "r", "x"), (2, -5, "r", "y")], "conv_id long, turn long, role string, text string")
    placed = trie.numbered(df.repartition(7))
    assert sorted((r.conv_id, r.at) for r in placed.collect()) == [(1, k) for k in range(1, 501)] + [(2, 1), (2, 2)]


def test_sparse_table_holds_minima_of_all_stretches():
    values = np.random.default_rng(3).integers(0, 50, 37)
    for k, row in enumerate(trie.Runs._table(values)):
        assert row.tolist() == [values[i : i + 2**k].min() for i in range(len(values) - 2**k + 1)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "a", "b", 7, "c")], "conv_id long, turn long, role string, text string, at int, n string")
    assert found(spark, []) == []
    nodes = trie.prefix_trie(*trie.borrowed(trie.numbered(df)))
    assert nodes.count() == len(expected([(1, 0, "a", "b")]))
