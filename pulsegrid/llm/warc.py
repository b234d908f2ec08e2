"""WARC archives: write pages as records, read archives back and put segmented records together.

Writing is DataFrame expressions. A record's block is an HTTP message with chunked transfer framing, cut at chunk borders
into segments of bounded size: a response and continuation records that name it. A record ends with two line breaks,
which is the separator that Spark's text writer sets between its rows, so its files are archives as they are, in any
store that Spark writes to. Archives hold a bounded number of bounded segments.

Reading takes whole archives (their size is bounded) and walks over the records by Content-Length. Only segments of
segmented records are shuffled: they are grouped by the record they belong to, sorted by segment number, checked
against the total length, and then the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, store
from pulsegrid.operators.joins import checked_broadcast
from pulsegrid.session import work_dir

# characters of a chunk, chunks of a segment, records of an archive
CHUNK_CHARS, SEGMENT_CHUNKS, ARCHIVE_RECORDS = 8192, 4, 2048
_BREAK = "\r\n"
_HEX5, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8: five hex digits are four digits of base 32."""
    digits = F.sha1(text.cast("binary"))
    fours = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fours), _HEX5, _BASE32)


def _lines(*lines: Column | str) -> Column:
    return F.concat(*(x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(_BREAK))))


def _after(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _optional(name: str, value: Column) -> Column:
    """A header line with its break, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_BREAK)), F.lit(""))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One text per WARC record, without its end; ``pages(page_id, url, html, ...)``.

    Of the pages with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are responses and
    others revisits of it; a page without id is only a response where no equal page has an id. A null html is empty.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    found = rows.where(F.col("bytes") >= min_bytes).select("digest", "bytes", "page_id")
    copied = found.groupBy(F.col("digest").alias("same"), F.col("bytes").alias("long")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    copied = checked_broadcast(copied.where("copies > 1 and first is not null").select("same", "long", "first"))
    rows = rows.join(copied, (F.col("digest") == F.col("same")) & (F.col("bytes") == F.col("long")), "left")
    rows = rows.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))

    def message(length: Column | str) -> Column:
        return _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", length, "")

    frames = F.transform(F.regexp_extract_all("html", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0)), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(_BREAK), c, F.lit(_BREAK)))
    frames = F.concat(frames, F.array(F.lit("0" + _BREAK + _BREAK)))
    blocks = F.when(F.col("revisit"), F.array(message(_after("Content-Length", F.col("bytes"))))).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size("frames"), F.lit(SEGMENT_CHUNKS)),
            lambda i: F.concat(F.when(i == 1, message("Transfer-Encoding: chunked")).otherwise(""), F.array_join(F.slice("frames", i, F.least(F.lit(SEGMENT_CHUNKS), F.size("frames") - i + 1)), "")),
        )
    )
    hexes = F.md5(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row").cast("string")))
    rows = rows.withColumn("id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">")))
    rows = rows.withColumn("frames", frames).withColumn("blocks", blocks)
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    # a segment's row has its own block alone: with all of them, rows would grow with the square of a page's length
    rows = rows.withColumns({"total": total, "segments": F.size("blocks")})
    parts = rows.select("page_id", "url", "digest", "first", "revisit", "id", "total", "segments", F.posexplode("blocks").alias("at", "block"))
    one, first, last = F.col("segments") == 1, F.col("at") == 0, F.col("at") == F.col("segments") - 1
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own_id = F.when(first, F.col("id")).otherwise(F.concat(F.expr("substring(id, 1, length(id) - 1)"), F.lit("/"), (F.col("at") + 1).cast("string"), F.lit(">")))
    head = F.concat(
        F.lit("WARC/1.1" + _BREAK), _lines(_after("WARC-Type", kind), _after("WARC-Record-ID", own_id), "WARC-Date: 2024-01-01T00:00:00Z", _after("WARC-Target-URI", F.col("url"))),
        _optional("WARC-Page-ID", F.when(first, F.col("page_id"))), _optional("WARC-Refers-To-Page-ID", F.when(F.col("revisit"), F.col("first"))),
        _optional("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _optional("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        _optional("WARC-Segment-Number", F.when(~one, F.col("at") + 1)), _optional("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        _optional("WARC-Segment-Total-Length", F.when(~one & last, F.col("total"))),
        _lines(F.when(first, F.lit("Content-Type: application/http; msgtype=response")).otherwise("Content-Type: application/octet-stream"), _after("Content-Length", F.octet_length("block")), ""),
    )
    return parts.select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("lineSep", _BREAK + _BREAK).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def walk(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record of an archive; header names in lower case. A broken archive is an error."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin, size = end + 4, int(headers["content-length"])
        if begin + size > len(archive):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, view[begin : begin + size]
        at = begin + size + 4


def unchunk(body: bytes) -> bytes:
    """The payload in a body with chunked transfer framing; extensions and trailers are passed over."""
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """(payload, stated Content-Length) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    stated = headers.get("content-length")
    return unchunk(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body, None if stated is None else int(stated)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


_PARTS = pa.schema([
    ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
PARTS = "origin string, segment int, total long, block binary, page_id long, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long"


def _parse(batches):
    """Whole records are decoded at once; segments keep their block and the name of their record."""
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, view in walk(content.as_py()):
                kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                segment = _number(h.get("warc-segment-number"))
                row = {
                    "origin": h.get("warc-segment-origin-id") or h["warc-record-id"], "segment": segment, "total": _number(h.get("warc-segment-total-length")), "page_id": _number(h.get("warc-page-id")),
                    "record_type": None if kind == "continuation" else kind, "refers_to": _number(h.get("warc-refers-to-page-id")), "stated_digest": digest,
                }
                if segment is not None:
                    row["block"] = view.tobytes()
                elif kind in ("response", "revisit"):
                    payload, stated = payload_of(view.tobytes())
                    revisit = kind == "revisit"
                    row |= {"payload_bytes": stated if revisit else len(payload), "payload_digest": digest if revisit else _digest(payload)}
                else:
                    continue
                rows.append(row)
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)


def _reassemble(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts = row.pop("parts")
            total = next((p["total"] for p in reversed(parts) if p["total"] is not None), None)
            block = b"".join([p["block"] for p in parts])
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                raise ValueError(f"record {row['origin']} is not complete: {len(block)} of {total} bytes in {len(parts)} segments")
            payload, _ = payload_of(block)
            rows.append(row | {"payload_bytes": len(payload), "payload_digest": _digest(payload)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in _PARTS if f.name not in ("segment", "total", "block")]))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of ``archives(content)``.

    The digest of a response is computed from its payload and must be the stated one; an incomplete or broken record is
    an error. A revisit has no payload: its length and digest are those it states.
    """
    parts = store(archives.select("content").mapInArrow(_parse, PARTS), "warc-parts")
    columns = ("page_id", "payload_bytes", "payload_digest", "stated_digest", "record_type", "refers_to")
    whole = parts.where("segment is null").select(*columns)
    grouped = parts.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        *(F.max(c).alias(c) for c in ("page_id", "stated_digest", "record_type", "refers_to")),
    )
    schema = "origin string, page_id long, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long"
    put = grouped.mapInArrow(_reassemble, schema).select(*columns)
    out = whole.unionByName(put)
    same = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest, page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return out.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages(page_id, url, html, ...)`` to the shared folder and return what they hold, a row per page.

    Equal rows stay as many rows. Pages with one id and equal payloads are all responses. A null url is empty, white space
    in it is dropped. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    path = work_dir(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))
