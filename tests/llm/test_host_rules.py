import collections
import random
import re

import pytest

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import host_rules as H
from pulsegrid.llm import registry


def rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


def key(r):
    return str(tuple(r))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = [(r.doc_id, *rules(r.text)) for r in rows]
    hosts = collections.defaultdict(list)
    for r, x in zip(rows, want, strict=True):
        hosts[r.source].append(x[-1])
    got = registry.QUERIES["op5_quality_rules"](spark, SF_SMALL).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    # no host of the tables is bad as a whole, so clean documents stay
    assert all(r.kept != r.base_failed for r in got)


def test_rules_on_hard_texts(spark, edge):
    rng = random.Random(0)
    texts = ["a\na\n\na", "\x00\n\x00\nx\n\n x\n x", "a b c d e f g h " * 5] + ["".join(rng.choice("ab# \n") for _ in range(rng.randint(0, 150))) for _ in range(800)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(tuple(r)[:7] for r in H.judge(docs, "source").collect()) == [(i, *rules(t)) for i, t in enumerate(texts)]
    want = sorted(((r.doc_id, *rules(r.text)) for r in edge.collect()), key=str)
    assert sorted((tuple(r)[:7] for r in H.judge(edge, "source").collect()), key=str) == want


@pytest.fixture(scope="module")
def hosts(spark):
    """Forty ordinary hosts, a bad one, one with two bad pages only, and rows without host."""
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows = [(h, f"host{h}", good() if rng.random() < 0.85 else "short") for h in range(40) for _ in range(30)]
    rows += [(100, "bad", good() if i % 10 == 0 else "short") for i in range(200)] + [(101, "small", "short"), (101, "small", "short"), (101, "small", good())] + [(102, None, good()), (102, None, "short")]
    return spark.createDataFrame([(i, h, t, "x") for i, (_, h, t) in enumerate(rows)], "doc_id long, source string, text string, bad string")


def test_a_bad_host_takes_its_good_documents_along(hosts):
    out = H.judge(hosts, "source").collect()
    assert not any(r.kept for r in out if r.host == "bad")
    assert all(r.kept != r.base_failed for r in out if r.host != "bad")


def test_rates_are_shrunk_towards_the_mean(hosts):
    rates = {r.host: r for r in H.host_rates(H.document_rules(hosts, "source")).collect()}
    assert rates["bad"].rate > 0.7 and 0.15 < rates["small"].rate < 0.6 < 2 / 3


def test_nothing(nothing):
    assert H.judge(nothing, "source").count() == 0


def test_equal_shares_give_a_firm_prior(spark):
    docs = spark.createDataFrame([(i, f"h{i % 4}", "short") for i in range(40)], "doc_id long, source string, text string")
    assert all(r.rate > 0.5 for r in H.host_rates(H.document_rules(docs, "source")).collect())
