"""Prefix tries against a plain version, with subtrees of all sizes; node tables against dictionaries."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkraster.llm import prefix_trie
from sparkraster.llm.prefix_trie import NodeTable, accumulate, member_hashes, op12_prefix_trie, trie

ROWS = "conv_id bigint, turn bigint, role string, text string, depth int, d1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        base = c - int(np.fmod(c, 100))
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own[c] if base == c else own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=str)


def sample():
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(201, 230), -7, -100, -205, 10**15 + 1]:
        for t in range(rng.choice([0, 1, 2, 4, 7])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ÿé", "", None, f"own {c}"])))
    same = [(300 + c, t, "user", f"turn {t}") for c in range(40) for t in range(9)]  # equal conversations, a run of crown nodes
    fork = [(400 + c, t, "user", f"turn {t}" if t < 5 + c % 3 else f"other {c % 4}") for c in range(30) for t in range(12)]
    odd = [(500, None, "user", "first"), (500, 3, "b", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (None, 1, "user", "nobody's"), (501, 1, "x" * 3000, "y" * 100000)]
    long = [(600, t, "user", str(t % 3)) for t in range(700)] + [(700, t, "user", str(t % 3)) for t in range(650)]
    rows += same + fork + odd + long
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [{}, {"SHARD_TURNS": 40, "SHARD_NODES": 5, "CHUNK_TURNS": 64, "CHUNK_IDS": 3}, {"SHARD_TURNS": 1, "SHARD_NODES": 1}])
def test_trie_matches_plain_version(spark, monkeypatch, size):
    for k, v in size.items():
        monkeypatch.setattr(prefix_trie, k, v)
    rows = sample()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    got = trie(df)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)
    assert trie(df.filter("false")).count() == 0


def test_node_table_is_minimal_and_perfect():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 30000):
        a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        t = NodeTable(a, b)
        assert sorted(t.slots(a, b)) == list(range(n))
        assert (t.slots(a + np.uint64(1), b) == -1).all()
    with pytest.raises(ValueError):
        NodeTable(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


def test_accumulate_goes_up_level_by_level():
    one = np.array
    parent, kids, leaves, saved = accumulate(one([1, 2, 3, 4]), one([0, 0, 0, 0]), one([9, 1, 2, 1]), one([9, 0, 0, 0]), one([4, 5, 6, 5]), one([0, 0, 1, 1]), one([1, 10, 100, 1000]))
    assert parent.tolist() == [-1, 0, 1, 0] and kids.tolist() == [2, 1, 0, 0] and leaves.tolist() == [2, 1, 1, 1] and saved.tolist() == [1111, 110, 100, 1000]


def test_member_hashes_of_long_lists(spark):
    ids = [*range(-30, 25000)]
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7)], "d1 bigint, d2 bigint, conv_id bigint")
    got = {(r["d1"], r["d2"]): r["ends_sha256"] for r in member_hashes(df).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op12_prefix_trie(spark, sf).select(*COLUMNS).collect()), key=str) == plain_trie(rows)
