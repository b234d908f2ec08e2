import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import periodic_runs as R
from pulsegrid.llm import registry


def runs(w, least=12):
    """Every stretch with a period, period by period."""
    number = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.empty(0)
    found = {}
    for p in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], number[:-p] == number[p:], [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= max(least - p, p):
                found.setdefault((s, e - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w):
    drop = {j for s, n, p in runs(w) for j in range(s + p, s + n)}
    return " ".join(x for j, x in enumerate(w) if j not in drop)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@functools.cache
def digest(doc_id, text):
    w = planted(doc_id, text)
    found = runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w))]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = registry.QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()
    want = sorted(digest(r.doc_id, r.text) for r in rows)
    assert sorted(tuple(r) for r in got) == want
    assert sum(r[1] > 0 for r in want) > 15


def hard_texts():
    rng = random.Random(7)
    for _ in range(400):
        n, letters = rng.randint(0, 80), "abcdefgh"[: rng.choice([1, 2, 3, 5])]
        w = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 12)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        yield " ".join(w)
    yield "a " * 2500
    yield "a b " * 700 + "c " + "a b " * 700
    # a Fibonacci word has very many runs
    x, y = "a ", "a b "
    while len(y) < 1200:
        x, y = y, y + x
    yield y


def test_hard_texts_in_every_order(spark):
    texts = list(hard_texts())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in R.find_runs(docs).collect()}
    for i, t in enumerate(texts):
        assert [tuple(r) for r in got[i].runs] == runs(words(t)), t[:200]
        assert got[i].collapsed == collapsed(words(t))


def test_blocks_of_candidates_do_not_change_runs(monkeypatch):
    letters = np.concatenate([[-1], np.tile([1, 2, 3], 40), [-2], np.tile([2], 30), [-3]])
    want = [x.tolist() for x in R.runs_of(letters, np.array([1, 122]), np.array([120, 30]))]
    assert want == [[1, 122], [120, 30], [3, 1]]
    monkeypatch.setattr(R, "BLOCK", 3)
    assert [x.tolist() for x in R.runs_of(letters, np.array([1, 122]), np.array([120, 30]))] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12))
def test_grammar_extends_exactly(w, least):
    letters = np.array([-1, *w, -2], dtype=np.int64)
    grammar = R.Grammar(letters)
    pairs = [(i, j) for i in range(1, len(w) + 1) for j in range(i + 1, len(w) + 1)]
    if pairs:
        i, j = np.array(pairs).T
        right = [next(k for k in range(len(letters)) if letters[a + k] != letters[b + k]) for a, b in pairs]
        left = [next(k for k in range(len(letters)) if letters[a - k] != letters[b - k]) for a, b in pairs]
        assert grammar.agree(i, j, 1).tolist() == right
        assert grammar.agree(i, j, -1).tolist() == left
    least = max(least, 2)
    found = R.runs_of(letters, np.array([1]), np.array([len(w)]), least)
    assert [(s - 1, n, p) for s, n, p in zip(*(x.tolist() for x in found), strict=True)] == runs(w, least)


def test_edges(spark, edge, nothing):
    got = R.digests(R.find_runs(R.with_tails(edge))).collect()
    # a row without id keeps its text
    want = [digest(r.doc_id, r.text) if r.doc_id is not None else (None, *digest(1, r.text)[1:]) for r in edge.collect()]
    assert zlib.crc32(b"1") % 10
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    out = R.digests(R.find_runs(R.with_tails(nothing)))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.count() == 0


@pytest.mark.parametrize("text", [None, "", " \n\t"])
def test_no_words(spark, text):
    row = R.digests(R.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (1, 0, None, None, None, None, empty, empty)
