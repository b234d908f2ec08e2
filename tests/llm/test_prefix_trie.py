import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from corpus_rows import SF_SMALL
from pulsegrid.llm import prefix_trie as T
from pulsegrid.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """conv_id -> its (role, text) turns, rebuilt as op12 asks for."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(paths):
    """Rows of the trie, node by node."""
    nodes = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes[tuple(paths[c][:d])].append(c)
    children = collections.defaultdict(list)
    for way in nodes:
        if way:
            children[way[:-1]].append(way)

    leaves, saved = {}, {}
    for way in sorted(nodes, key=len, reverse=True):
        below = children[way]
        leaves[way] = sum(leaves[b] for b in below) if below else 1
        saved[way] = sum(saved[b] for b in below) + ((len(nodes[way]) - 1) * len(way[-1][1].encode()) if way else 0)
    rows = []
    for way, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(paths[c]) == len(way))
        parent = min(nodes[way[:-1]]) if way else None
        rows.append((min(members), len(way), parent, len(members), len(children[way]), leaves[way], saved[way], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.QUERIES["op12_prefix_trie"](spark, SF_SMALL)) == trie(rebuilt(rows))


def some_turns(n, seed, texts=("a", "bé", ""), most=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, most])):
            rows.append((c - 3, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]), rng.choice([*texts, None])))
    rng.shuffle(rows)
    return rows


@pytest.fixture()
def seven_partitions(spark, many_chunks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("texts", [("a", "bé", ""), ("a",)])
def test_many_chunks(spark, seven_partitions, texts):
    """Prefixes and equal conversations reach over the cuts; ids may be negative, turns null or tied."""
    rows = some_turns(150, 1, texts)
    paths = T.with_shared_heads(T.sequences(spark.createDataFrame(rows, SCHEMA)))
    assert got(T.trie(paths)) == trie(rebuilt(rows))


def test_equal_conversations_fill_whole_chunks(spark, seven_partitions):
    """One conversation makes up most of the table, so its node has several pieces of ids."""
    rows = [(5 * c, t, "u", f"t{t}") for c in range(300) for t in range(2)] + [(5 * c, t, "u", f"t{t}") for c in range(300, 310) for t in range(3)]
    rows += [(5 * c, 0, "u", "t0") for c in range(310, 330)] + [(5 * c, 0, "z", "t0") for c in range(330, 340)]
    paths = T.with_shared_heads(T.sequences(spark.createDataFrame(rows, SCHEMA)))
    found = T.trie(paths)
    assert got(found) == trie(rebuilt(rows))
    assert found.where("n_convs = 340").count() == 1


def test_edges(spark, seven_partitions):
    rows = [(None, 1, "u", "lost"), (1, None, None, None), (1, None, "", ""), (2, 5, "u", "x" * 100_000), (2, 5, "u", "x" * 100_000), (7, 1, "u", "1:u"), (8, 1, "u1", ":u"), (10**15, 1, "u", "a")]
    extra = spark.createDataFrame([(*r, 1, "w", []) for r in rows], SCHEMA + ", chunk int, way string, path array<int>")
    assert got(T.trie(T.with_shared_heads(T.sequences(extra)))) == trie(rebuilt(rows))
    assert got(T.trie(T.with_shared_heads(T.sequences(extra.limit(0))))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    """h turns are taken from a conversation that is not there."""
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 1, "u", "a"), (lone, 2, "u", "b")]
    out = got(T.trie(T.with_shared_heads(T.sequences(spark.createDataFrame(rows, SCHEMA)))))
    assert out == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_range_minima_against_loops():
    rng = np.random.default_rng(0)
    for n in range(1, 40):
        v = rng.integers(0, 5, n)
        m = T.RangeMinima(v)
        for at in range(n):
            for d in range(6):
                r, left = at, at
                while r + 1 < n and v[r + 1] >= d:
                    r += 1
                while left >= 0 and v[left] >= d:
                    left -= 1
                assert m.right(np.array([at]), np.array([d])).tolist() == [r]
                assert m.left(np.array([at]), np.array([d])).tolist() == [left]
            for end in range(at, n):
                assert m.over(np.array([at]), np.array([end])).tolist() == [v[at : end + 1].min()]
