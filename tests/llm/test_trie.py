"""The prefix trie against a plain one, with shards of all sizes; LOUDS against plain children."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.llm import trie

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """rows: (conv_id, turn, role, text). One tuple of COLS a node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(set)
    whole = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].add(c)
    under = defaultdict(lambda: [0, 0])
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, ms in members.items():
        saved = (len(ms) - 1) * len(brute.WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            under[node[:d]][0] += node not in kids
            under[node[:d]][1] += saved
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if whole[c] == node)
        up = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), up, len(ms), kids.get(node, 0), *under[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def talk(seed=0, convs=160):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, convs):
        if c % 7 == 0:
            continue  # some bases are absent
        same = rng.random() < 0.4
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"a b {t}" if same else f"w{rng.randint(0, 2)}\tx"))
    rows += [(500, None, None, None), (500, 0, "", ""), (500, 0, "", ""), (501, 3, "user", "")]
    rows += [(None, 0, "user", "nobody"), (600, 0, "user", "long " * 5000)]
    rows += [(700 + i, t, "user", f"chain {t}") for i in range(3) for t in range(90)]
    return rows


@pytest.mark.parametrize("light, nodes, piece", [(1024, 1 << 15, 4096), (40, 16, 7), (4, 1, 1), (0, 5, 3)])
def test_trie(spark, light, nodes, piece):
    rows = talk()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("depth", "n", "k1", "words", "place", "own", "h", "base", "below")})
    assert got(trie.prefix_trie(df.repartition(3), light, nodes, piece)) == plain(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3][:3]  # too short, without a base
    rows = [(c, 0, "user", "only") for c in odd if c > 20]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_query(spark, sf_dir):
    from motionlake.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_prefix_trie"](spark, sf_dir)) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=40), st.integers(1, 4))
def test_louds(draws, roots):
    parent = np.array([-1] * roots + [-1] * len(draws))
    for i, d in enumerate(draws):
        parent[roots + i] = d % (roots + i)
    level = np.zeros(len(parent), int)
    for i, p in enumerate(parent):
        level[i] = 0 if p < 0 else level[p] + 1
    key = np.stack([np.arange(len(parent)), np.zeros(len(parent), int)], 1)
    order, up = trie.level_order(np.zeros(len(parent), int), level, key, np.where(parent[:, None] < 0, -1, key[parent]))
    assert sorted(order) == list(range(len(parent))) and (np.diff(up) >= 0).all()
    assert all((up[i] < 0 and parent[n] < 0) or order[up[i]] == parent[n] for i, n in enumerate(order))
    one = trie.Louds.read(trie.Louds.of(up).write(), len(parent))
    assert one.parents().tolist() == up.tolist()
    assert one.children().tolist() == [int((up == i).sum()) for i in range(len(up))]
    assert [level[order[b]] for b, _ in one.levels()] == sorted(set(level)) and one.levels()[-1][1] == len(parent)
