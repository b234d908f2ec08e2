import hashlib
import random
import re

from corpus_rows import SF_SMALL, edge, nothing  # noqa: F401
from pulsegrid.llm import private_data as V
from pulsegrid.llm import registry

# The patterns of the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(0, m) for m in re.finditer(EMAIL, text)]
    found += [(1, m) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(2, m) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(3, m) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return sorted((k, m.start(), m.end()) for k, m in found)


def as_text(spans):
    return ",".join(f"{V.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def check(rows, found):
    by_row = sorted(((d, *(sum(s[0] == k for s in base(t or "")) for k in range(4)), hashlib.sha256(as_text(base(t or "")).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in found), key=str) == by_row
    texts = {d: t or "" for d, t in rows}
    for r in found:
        if r.doc_id is None:
            continue
        spans = [s for s in r.spans.split(",") if s]
        assert set(as_text(base(texts[r.doc_id])).split(",")) - {""} <= set(spans)
        ordered = [(V.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert ordered == sorted(ordered) and all(0 <= a < b <= len(texts[r.doc_id]) for _, a, b in ordered)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, registry.QUERIES["op2_private_data"](spark, SF_SMALL).collect())


def test_hard_texts(spark):
    rng = random.Random(4)
    texts = [
        "a@b.c_d@e.f x", "😀é x.y@z.com 4111 1111 1111 1111, +1 (017) 555-7713. 999.1.2.3 1.2.3.4.5.6.7.8 0001.2.3.255", "4111111111111111 4111-1111-1111-1112",
        "+12345678901234567890 +1 2", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "0" * 19, "0" * 20, "1." * 500 + "1", "a" * 5000 + "@" + "b.c" * 2000, "+1" + "(" * 3000 + "2345678901",
    ] + ["".join(rng.choice("a@.b1 2+-(3)_") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check([tuple(r) for r in docs.collect()], V.find(docs).collect())


def test_edge_rows(edge, nothing):
    check([tuple(r) for r in edge.select("doc_id", "text").collect()], V.find(edge).collect())
    assert V.find(nothing).count() == 0 and V.masked(nothing).count() == 0


def test_masking_takes_every_base_span_and_nothing_else(spark, edge):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    masked = V.masked(docs)
    assert masked.schema == docs.schema
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in masked.collect():
        spans = base(before[r.doc_id])
        assert not base(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
        assert sum(r.text.count(f"[{k.upper()}]") for k in V.KINDS) >= len(spans)
    same = {(r.doc_id, r.text) for r in V.masked(edge).collect()}
    assert {(r.doc_id, r.text) for r in edge.collect()} == same and V.masked(edge).columns == edge.columns


def test_labelers_are_weighed_by_their_agreement():
    # three labelers agree on most candidates, the fourth votes at random
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        sure = ["+-"[(rng.random() < 0.1) == real] for _ in range(3)]
        p = "3" + "".join(sure) + rng.choice("+-") + "b" + "w"
        counts[p] = counts.get(p, 0) + 1
    q, table = V.estimate(counts)
    assert q["3+++-bw"] > 0.95 and q["3---+bw"] < 0.05
    assert all(table[j][1][2] > 0.8 for j in range(3)) and abs(table[3][1][2] - 0.5) < 0.1
    weights = V.classifier(counts, q)
    assert V.score(weights, "3+++-bw") > 0.9 > 0.1 > V.score(weights, "3---+bw")


def test_plan_has_no_python(spark, plan):
    text = plan(V.find(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))) + plan(V.masked(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    assert not re.search("Python|Pandas|Arrow", text)
