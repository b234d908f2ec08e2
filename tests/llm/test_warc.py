import base64
import hashlib
import os

import pytest

from corpus_rows import SF_SMALL
from pulsegrid.llm import registry, warc


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    return sorted(((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if first.get(p, i) == i else ("revisit", first[p]))) for i, p in payloads), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    (1, "u", None), (2, None, ""), (3, "a b\r\nX: y", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (4, "u", "é日😀\r\n" * 30_000), (5, "u", "é日😀\r\n" * 30_000), (None, "u", "q"), (None, "u", "q"),
    (6, "v", "z"), (None, "v", "z"), (7, "w", "w"), (7, "w", "w"), (8, "w", "\x00\x1f " * 9000), (9, "w", "a" * 8192), (10, "w", "a" * 8192 * 4),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, `row` int, digest string")


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html").collect()]
    assert found(registry.QUERIES["op7_warc"](spark, SF_SMALL)) == brute(rows)


def test_edge_rows(pages):
    assert found(warc.round_trip(pages)) == brute([(i, h) for i, _, h in ROWS])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_shorter_payloads_are_never_revisits(pages):
    out = found(warc.round_trip(pages, min_bytes=2))
    assert all(r[3] == "response" for r in out if r[1] < 2) and [r for r in out if r[3] == "revisit"] == [r for r in brute([(i, h) for i, _, h in ROWS]) if r[3] == "revisit" and r[1] >= 2]


def test_archives_are_records_by_the_letter(pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    records = []
    for name in os.listdir(path):
        if name.startswith("part-"):
            data = open(os.path.join(path, name), "rb").read()
            records += [(h, bytes(b)) for h, b in warc.walk(data)]
    ids = [h["warc-record-id"] for h, _ in records]
    assert len(set(ids)) == len(ids)
    whole = {h["warc-record-id"] for h, _ in records if h["warc-type"] == "response"}
    parts = [h for h, _ in records if h["warc-type"] == "continuation"]
    assert parts and all(h["warc-segment-origin-id"] in whole and int(h["warc-segment-number"]) > 1 for h in parts)


def test_broken_input_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [bytes(b) for _, b in warc.walk(good * 2)] == [b"abcd"] * 2
    for bad in (good[:-6], b"nonsense", good + b"x"):
        with pytest.raises(ValueError):
            list(warc.walk(bad))
    assert warc.unchunk(b"4;ext=1\r\nabcd\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcd0123456789"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabcd\r\n0\r\n\r\n")


def test_a_missing_segment_is_an_error(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.records(pages).where("value not like '%WARC-Segment-Number: 2%'").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="is not complete"):
        warc.read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)).collect()


def test_segments_do_not_carry_the_whole_page(pages, plan):
    """Of the columns beside the generated ones none is an array or text of a page's length."""
    carried = [line.split("), ", 1)[1] for line in plan(warc.records(pages)).splitlines() if "Generate posexplode(blocks" in line]
    assert carried and not any(name in line for line in carried for name in ("blocks#", "frames#", "html#"))
