import random

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import decontaminate as D
from pulsegrid.llm import registry


def distance(pattern, text, anchored=False):
    """(least edit distance to a part of the text, its first end), cell by cell."""
    row = list(range(len(text) + 1)) if anchored else [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_search_equals_the_table():
    rng = random.Random(3)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        for anchored in (False, True):
            assert D.search(p, t, anchored) == distance(p, t, anchored)


def test_matches_equal_a_search_without_pieces():
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60)))) for i in range(30)] + [(30, ""), (31, "   ")]
    block = D.Items(items, 0.1)
    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50)))
        k = rng.randrange(30)
        edited = list(items[k][1])
        for _ in range(rng.randint(0, 7)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "a", "zz", "  "])
        text = text[:20] + "".join(edited).upper() + text[20:]
        flat = D.normal(text)
        want = set()
        for i, pattern in ((i, D.normal(t)) for i, t in items):
            if pattern and D.search(pattern, flat)[0] <= int(len(pattern) * 0.1 + 1e-9):
                want.add((i, D.search(pattern, flat)[0]))
        found = block.matches(text)
        assert {(i, d) for i, d, _, _ in found} == want
        by_id = dict(items)
        for i, d, a, b in found:
            pattern = D.normal(by_id[i])
            assert distance(pattern, flat[a:b])[0] == d


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, D.normal(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = set()
    for item_id, pattern in items[:12]:  # without pieces every item is searched in every text
        for doc_id, text in docs:
            d, _ = D.search(pattern, text)
            if d <= int(len(pattern) * D.BUDGET + 1e-9):
                want.add((doc_id, item_id, d))
    chosen = {i for i, _ in items[:12]}
    got = registry.QUERIES["op3_decontamination"](spark, SF_SMALL).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got if r.item_id in chosen} == want and len(got) > 0


def test_planted_passages_in_blocks_and_edge_rows(spark, edge, nothing, monkeypatch):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away from the farm"), (2, None), (3, ""), (4, "one two three one two three"), (5, "the quick brown fox jumps over the lazy dog and runs away from the farm")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(100, "x " + items[0][1].upper().replace(" ", "\n") + " y"), (101, items[0][1].replace("brown", "brawn").replace("dog", "hog")), (102, items[0][1][: len(items[0][1]) // 2])]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want = {(100, 1, 0), (100, 5, 0), (101, 1, 2), (101, 5, 2), (7, 4, 0), (8, 4, 0)}
    assert {tuple(r)[:3] for r in D.find_items(docs, benchmark).collect()} == want
    whole = D.blocks
    monkeypatch.setattr(D, "blocks", lambda items: whole(items, 20))
    assert {tuple(r)[:3] for r in D.find_items(docs, benchmark).collect()} == want
    kept = D.without_items(edge, benchmark)
    assert kept.schema == edge.schema and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 9, None}
    assert D.find_items(nothing, benchmark).count() == 0 == D.find_items(docs, benchmark.limit(0)).count()
    assert D.without_items(edge, benchmark.limit(0)).count() == edge.count()
