import collections
import random

import pytest

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import ngram_join, registry


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, size, percent):
    """doc_id, set size and component of rows (doc_id, text) by comparing all sets that share a shingle."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset({tuple(w)} if w else ()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common = collections.Counter(j for g in s for j in having[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            having[g].append(i)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), None if d is None else low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def joined(docs, size=3, percent=90):
    return sorted((tuple(r) for r in ngram_join.link_components(docs, size, percent).collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in registry.QUERIES["op1_ngram_jaccard_join"](spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_copies_in_chains_and_common_passages(spark, monkeypatch, size, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)  # so that small groups use pairs of shingles
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for length in (8, 20, 45, 130, 300):
        base = [word() for _ in range(length)]
        for _ in range(12):
            base = list(base)
            for _ in range(rng.randint(0, 2)):  # a chain: each differs a little from the one before
                base[rng.randrange(len(base))] = word()
            rows.append((n, " ".join(base)))
            n += 1
    for _ in range(15):
        rows.append((n, " ".join(passage + [word() for _ in range(rng.randint(0, 12))])))
        n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(docs, size, percent) == brute(rows, size, percent)


def test_edge_rows(edge):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert joined(edge) == brute(rows, 3, 90)


def test_nothing(nothing):
    assert joined(nothing) == []


def test_one_of_each_keeps_one_per_group_and_all_columns(edge):
    kept = ngram_join.one_of_each(edge, 5, 80)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 9] and ids.count(None) == 2


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other, alone = text + " end", "a text that is like no other one in this table", "quite another one that nothing here is like at all"
    rows = [(2, text), (5, near), (5, other), (7, other + " x"), (8, alone), (8, alone + " "), (9, text), (9, text), (11, "p q r s t u v w x y z"), (11, "P q r s t u v w x y z"), (12, None), (12, "m n o p q r s")]
    # two unlike and two like texts under one id, and an id with copies that all go
    rows += [(20, " ".join(f"v{i}" for i in range(40))), (20, " ".join(f"v{i}" for i in range(41))), (21, " ".join(f"v{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(docs, 5, 80).collect()), key=str)
    assert (5, other) in kept and (5, near) not in kept
    got = brute(kept, 5, 80)
    assert len({c for _, _, c in got}) == len({c for _, _, c in brute(rows, 5, 80)}) and (2, text) in kept
    # one row of every component, and no other
    sets = lambda x: frozenset(tuple(lowered(x).split()[i : i + 5]) for i in range(len(x.split()) - 4))
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) > 0
    texts = [t for _, t in kept if t]
    assert all(not alike(sets(a), sets(b)) for i, a in enumerate(texts) for b in texts[:i])
    assert all(any(alike(sets(t), sets(k)) for k in texts) for _, t in rows if t)
    assert [i for i, _ in kept] == [11, 12, 12, 2, 20, 5, 8]
