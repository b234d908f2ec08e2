"""Token ids in directly addressable codes.

An id is cut into levels of eight bits, the lowest first. A level holds the bytes of those ids that reach it, one bit
for each tells whether the id goes on, and a directory of the ones before every block of 512 bits gives the place
in the next level. So token i is read from one byte, one bit and one count per level, without decoding others.

A file is a Parquet table of segments: consecutive documents in ascending order of id with the codes of their
tokens, each ended by the end id. Segments are bounded in tokens, but a document is never cut.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import byte_pieces
from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches
from pulsegrid.session import work_dir

END = 0
SEGMENT_TOKENS = 1 << 19
BLOCK = 512
_MAGIC = b"DAC1"
_ONES = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


class Codes:
    """The levels of a row of ids; ``at`` reads one id, ``all`` every one."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        while True:
            low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-max(len(bits), 1) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
            padded[: len(bits)] = bits
            ones = _ONES[padded].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            levels.append((low, padded, (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")))
            rest = rest[more]
            if not len(rest):
                return cls(len(ids), levels)

    def at(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            block = i // BLOCK
            within = int(_ONES[bits[block * (BLOCK // 8) : byte]].sum()) + (int(bits[byte]) & (1 << bit) - 1).bit_count()
            i = int(ranks[block]) + within
        return value

    def all(self) -> np.ndarray:
        out = None
        for low, bits, _ in reversed(self.levels):
            value = low.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)] |= out << 8
            out = value
        return out

    def to_bytes(self) -> bytes:
        parts = [_MAGIC, struct.pack("<QI", self.n, len(self.levels))]
        for low, bits, ranks in self.levels:
            parts += [struct.pack("<QQQ", len(low), len(bits), len(ranks)), low.tobytes(), bits.tobytes(), ranks.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        if data[:4] != _MAGIC:
            raise ValueError("not a code segment")
        n, count = struct.unpack_from("<QI", data, 4)
        at, levels = 16, []
        for _ in range(count):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            low = np.frombuffer(data, np.uint8, a, at)
            bits = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u4", c, at + a + b)
            levels.append((low, bits, ranks))
            at += a + b + 4 * c
        return cls(n, levels)


SEGMENTS = "part int, segment int, doc_ids array<long>, counts array<long>, tokens long, codes binary"


def write_codes(docs: DataFrame, path: str, vocabulary: str, end: int | None = END, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs(doc_id, text, ...)`` and write the segments to ``path``, in ascending order of doc_id.

    A null id comes first, rows with one id are ordered by their text, a null text is empty. With ``end`` None
    no end id is added. Other columns are ignored; an empty table gives a file without segments.
    """
    bounded_batches(docs.sparkSession)

    def each(batches):
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, tokens = [], [], [], 0
        table = byte_pieces.memo(vocabulary)

        def batch():
            ids = np.concatenate(held) if held else np.empty(0, np.int32)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())), "tokens": pa.array([tokens], pa.int64()), "codes": pa.array([Codes.of(ids).to_bytes()], pa.binary()),
            })

        for piece in W.passes(batches, limit=1 << 20):
            chunks = byte_pieces.chunks_of(piece.column("text"))
            entries = table.of(chunks)
            n = table.per_text(chunks, entries)
            ids = table.numbers(entries)
            if end is not None:
                ids = np.insert(ids, np.cumsum(n), end)
                n = n + 1
            cut = np.concatenate([[0], np.cumsum(n)])
            begin = 0
            names = piece.column("doc_id").to_pylist()
            while begin < len(n):
                # as many whole documents as the segment still takes, one at least
                upto = max(int(np.searchsorted(cut, cut[begin] + segment_tokens - tokens, "right")) - 1, begin + (not doc_ids))
                doc_ids += names[begin:upto]
                counts += n[begin:upto].tolist()
                held.append(ids[cut[begin] : cut[upto]])
                tokens += int(cut[upto] - cut[begin])
                begin = upto
                if begin < len(n):
                    yield batch()
                    doc_ids, counts, held, tokens, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(each, SEGMENTS).write.parquet(path)


def read_codes(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file, decoded from its codes.

    Starts are sums over whole segments before, then inside the segment; the sums are one row per part and
    segment, so the window over them sees no token.
    """
    from pyspark.sql import Window

    sizes = segments.select("part", "segment", "tokens")
    per_part = sizes.groupBy("part").agg(F.sum("tokens").alias("total"))
    parts = per_part.collect()  # one row per written part
    before, rows = 0, []
    for r in sorted(parts, key=lambda r: r.part):
        rows.append((r.part, before))
        before += r.total
    spark = segments.sparkSession
    parts_before = F.broadcast(spark.createDataFrame(rows, "part int, part_start long"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "segment", inside.alias("inside")).join(parts_before, "part").select("part", "segment", (F.col("part_start") + F.col("inside")).alias("at"))

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = np.array(row.column("counts")[0].as_py(), dtype=np.int64)
                ids = Codes.from_bytes(row.column("codes")[0].as_py()).all().astype("<u4")
                cut = np.concatenate([[0], np.cumsum(counts)])
                data = ids.tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row.column("part")[0].as_py()] * n, pa.int32()), "segment": pa.array([row.column("segment")[0].as_py()] * n, pa.int32()),
                    "doc_id": pa.array(row.column("doc_ids")[0].as_py(), pa.int64()), "inner": pa.array(cut[:-1], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    found = segments.mapInArrow(each, "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("at") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, vocabulary: str, end: int | None = END) -> DataFrame:
    """Write a token file below the shared folder and return what it holds per document."""
    spark = docs.sparkSession
    path = work_dir(spark, "token-codes")
    write_codes(docs, path, vocabulary, end)
    return read_codes(spark.read.schema(SEGMENTS).parquet(path))
