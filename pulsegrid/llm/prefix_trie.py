"""Prefix trie of conversations from sorted sequences, by range minima over their common prefixes.

Each conversation is the sequence of its turns' digests. The sequences are sorted over the cluster (equal ones by id), and
neighbours have a longest common prefix each. A node of the trie is a prefix; its members are neighbours in the order,
namely those between which every common prefix is at least as long as the node is deep. A sparse table holds the minima
over all stretches of a power of two of common prefixes, and each candidate prefix searches its left and its right end in it
by halving steps, on its own and without a stack. All figures of a node are then sums over its interval.

The order is cut into chunks, one task each. A chunk also knows the last sequence before it and the first behind it, so
the common prefixes at the cuts are known. A node whose interval reaches over a cut is counted in parts, which are as many as
its chunks; parts are few: no chunk has more of them than its first and its last sequence have turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store
from pulsegrid.operators.joins import checked_broadcast

NO_ENDS = hashlib.sha256(b"").hexdigest()
DIGEST = 16


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and path, the (digest, bytes) of its turns in order, of ``turns(conv_id, turn, role, text, ...)``.

    Null turns come first; turns with one number are ordered by their digests. A null role or text is empty; rows without
    conv_id belong to no conversation. The texts end here: 16 bytes and a length of each turn are shuffled. The digests of
    one conversation become one row.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.unhex(F.left(whole, F.lit(2 * DIGEST))).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("at"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t["size"].alias("size"))).alias("path"))


def with_shared_heads(paths: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 5; h is crc32(c) % 9."""
    heads = paths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("donor"), F.slice("path", 1, 8).alias("head"))
    own = paths.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    joined = own.join(heads, own.conv_id - own.conv_id % 5 == heads.donor, "left")
    tail = "slice(path, h + 1, greatest(size(path) - h, 0))"
    return joined.select("conv_id", F.expr(f"if(head is null, {tail}, concat(slice(head, 1, h), {tail}))").alias("path"))


class RangeMinima:
    """Sparse table: ``table[k][i]`` is the minimum of ``values[i:i + 2**k]``."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.table = [values]
        while 2 << (len(self.table) - 1) <= self.n:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest r with all of ``values[at + 1 .. r]`` at ``least`` or more."""
        r = at.copy()
        for k in range(len(self.table) - 1, -1, -1):
            begin = r + 1
            fits = begin + (1 << k) <= self.n
            go = fits & (self.table[k][np.where(fits, begin, 0)] >= least)
            r[go] += 1 << k
        return r

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest l with all of ``values[l + 1 .. at]`` at ``least`` or more; -1 at the left end."""
        left = at.copy()
        for k in range(len(self.table) - 1, -1, -1):
            begin = left - (1 << k) + 1
            go = (begin >= 0) & (self.table[k][np.maximum(begin, 0)] >= least)
            left[go] -= 1 << k
        return left

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of ``values[first .. last]``."""
        out = np.empty(len(first), dtype=self.table[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(self.table[k][first[some]], self.table[k][last[some] - (1 << int(k)) + 1])
        return out


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per digest of a binary column."""
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, 2)
    return data[:, 0].astype(np.uint64), data[:, 1].astype(np.uint64)


def common_prefixes(high: np.ndarray, low: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Longest common prefix of every sequence ``offset[q]:offset[q + 1]`` but the first with the one before it."""
    length = np.diff(offset)
    upto = np.minimum(length[:-1], length[1:])
    a, b = W.ragged(offset[:-2], upto), W.ragged(offset[1:-1], upto)
    differ = (high[a] != high[b]) | (low[a] != low[b])
    inside = a - np.repeat(offset[:-2], upto)
    out = upto.copy()
    some = np.flatnonzero(upto)
    if some.size:
        starts = (np.cumsum(upto) - upto)[some]
        out[some] = np.minimum(np.minimum.reduceat(np.where(differ, inside, len(a)), starts), upto[some])
    return out


def _chunk_nodes(chunk: int, conv: np.ndarray, paths: pa.Array, before: list | None, behind: list | None) -> dict:
    """The nodes of sorted sequences, those that reach over an end of the chunk as parts (see ``NODES``)."""
    n = len(conv)
    flat = paths.flatten()
    high, low = _digests(flat.field("digest"))
    size = flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
    length = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ghosts = [_digests(pa.array(x or [], pa.binary())) for x in (before, behind)]
    all_length = np.concatenate([[len(ghosts[0][0])], length, [len(ghosts[1][0])]])
    all_offset = np.concatenate([[0], np.cumsum(all_length)])
    lcp = common_prefixes(np.concatenate([ghosts[0][0], high, ghosts[1][0]]), np.concatenate([ghosts[0][1], low, ghosts[1][1]]), all_offset)
    if before is None:
        lcp[0] = -1
    if behind is None:
        lcp[n] = -1
    offset = np.concatenate([[0], np.cumsum(length)])
    upto = np.concatenate([[0], np.cumsum(size)])

    def bytes_of(q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the first ``depth`` texts of sequence q."""
        return upto[offset[q] + np.maximum(depth, 0)] - upto[offset[q]]

    # a candidate for each prefix that the sequence before does not have; all of the first sequence's
    least = lcp[:n] + 1
    least[0] = 0
    row = np.repeat(np.arange(n), length - least + 1)
    depth = W.ragged(least, length - least + 1)
    minima = RangeMinima(lcp)
    left, right = minima.left(row, depth), minima.right(row, depth)
    open_ = (left < 0) | (right >= n)
    first, last = np.maximum(left, 0), np.minimum(right, n - 1)
    smallest = RangeMinima(conv).over(first, last)
    leaves = np.concatenate([[0], np.cumsum(lcp[1:] < length)])
    shared = np.concatenate([[0], np.cumsum(bytes_of(np.arange(n), lcp[:n]))])
    # sequences that begin a child of the node they part from
    begins = np.flatnonzero(length > lcp[:n])
    key = np.sort(lcp[begins] * (n + 1) + begins)
    children = np.searchsorted(key, depth * (n + 1) + last, "right") - np.searchsorted(key, depth * (n + 1) + first + 1, "left")
    children += (lcp[first] <= depth) & (length[first] > depth)
    sharing = shared[last + 1] - shared[np.where(left < 0, first, first + 1)]
    above = np.where(depth > 0, bytes_of(row, depth - 1), 0)
    # the parent is the candidate one higher of the same sequence, or the node in which the sequence parts
    at = np.full(len(row), -1, dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(length - least + 1)])
    inner = depth > least[row]
    at[inner] = np.flatnonzero(inner) - 1
    heads = np.flatnonzero(~inner & (depth > 0))
    host = minima.left(row[heads], depth[heads] - 1)
    host = np.maximum(host, 0)
    at[heads] = start[host] + depth[heads] - 1 - least[host]
    # equal sequences stand together, by id
    again = np.zeros(n, dtype=bool)
    again[1:] = (lcp[1:n] == length[1:]) & (length[1:] == length[:-1])
    group = np.flatnonzero(~again)
    group_end = np.append(group[1:], n)
    holds = np.full(n, -1, dtype=np.int64)
    holds[group] = np.arange(len(group))
    # the deepest candidate of a group's first sequence is where it ends; the first group may have begun before the chunk
    ends = np.full(len(row), -1, dtype=np.int64)
    deepest = depth == length[row]
    ends[deepest] = holds[row[deepest]]
    names = conv.tolist()
    pieces = [",".join(map(str, names[a:b])) for a, b in zip(group.tolist(), group_end.tolist(), strict=True)]
    # names of the nodes that reach over an end: digests of their prefix
    named: list[bytes | None] = [None] * len(row)
    cursor: dict[int, tuple[int, object]] = {}
    data = [high.astype(">u8"), low.astype(">u8")]
    for c in np.flatnonzero(open_).tolist():
        q, d = int(row[c]), int(depth[c])
        done, state = cursor.get(q, (0, hashlib.sha256()))
        for t in range(done, d):
            state.update(data[0][offset[q] + t].tobytes() + data[1][offset[q] + t].tobytes())
        cursor[q] = (d, state)
        named[c] = state.digest() + d.to_bytes(8, "big")
    parents = at.tolist()
    wide = open_.tolist()
    return {
        "node": pa.array(named, pa.binary()),
        "parent": pa.array([named[p] if p >= 0 and wide[p] else None for p in parents], pa.binary()),
        "parent_conv_id": pa.array([int(smallest[p]) if p >= 0 and not wide[p] else None for p in parents], pa.int64()),
        "chunk": pa.array(np.full(len(row), chunk), pa.int64()),
        "conv_id": pa.array(smallest, pa.int64()),
        "depth": pa.array(depth, pa.int64()),
        "n_convs": pa.array(last - first + 1, pa.int64()),
        "n_children": pa.array(children, pa.int64()),
        "n_leaves": pa.array(leaves[last + 1] - leaves[first], pa.int64()),
        "sharing": pa.array(sharing, pa.int64()),
        "above": pa.array(above, pa.int64()),
        "ends": pa.array([None if e < 0 else pieces[e] for e in ends.tolist()], pa.string()),
    }


NODES = (
    "node binary, parent binary, parent_conv_id long, chunk long, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, sharing long, above long, ends string"
)


def _of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in _arrow()})
    left = left.sort_by("place").combine_chunks()
    chunk, before, behind = (right.column(name)[0].as_py() for name in ("chunk", "before", "behind"))
    conv = left.column("conv_id").combine_chunks().to_numpy()
    return pa.table(_chunk_nodes(chunk, conv, left.column("path").combine_chunks(), before, behind))


def _arrow() -> list[tuple[str, pa.DataType]]:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return [(name, kinds[kind]) for name, kind in (part.split() for part in NODES.split(", "))]


def _joined_pieces(batches):
    """Checksum of the pieces of each node, which come one behind the other; holds one batch and one state."""
    name, state = None, None
    for batch in batches:
        out = []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != name:
                if name is not None:
                    out.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield _checksums(out)
    if name is not None:
        yield _checksums([(name, state.hexdigest())])


def _checksums(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"of": pa.array([r[0] for r in rows], pa.binary()), "ends_sha256": pa.array([r[1] for r in rows], pa.string())})


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``paths(conv_id, path)``; conversations without turns end at the root.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes
    of the subtree, the top included), saved_tokens (bytes that the subtree's nodes save by being stored once), ends_sha256
    (of the ids that end here, ascending, comma-joined). Ids are expected once each. No conversations, no nodes.

    A common first turn, or very many equal conversations, is cut like anything else, since the order goes by (path, id).
    The ids that end at one node are fed to its checksum piece by piece.
    """
    spark = paths.sparkSession
    bounded_batches(spark)
    order = paths.select("conv_id", "path").withColumn("way", F.col("path.digest"))
    order = order.repartitionByRange("way", "conv_id").sortWithinPartitions("way", "conv_id")
    placed = store(order.drop("way").withColumn("chunk", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()), "trie-order")
    # one row per chunk
    edges = placed.groupBy("chunk").agg(F.min_by("path", "place").alias("head"), F.max_by("path", "place").alias("tail"))
    by_chunk = Window.orderBy("chunk")
    edges = edges.select("chunk", F.lag("tail.digest").over(by_chunk).alias("before"), F.lead("head.digest").over(by_chunk).alias("behind"))
    found = placed.groupBy("chunk").cogroup(edges.groupBy("chunk")).applyInArrow(_of_chunk, NODES)
    nodes = store(found, "trie-nodes")
    saved = (F.col("sharing") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens")
    figures = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    whole = nodes.where("node is null").select(
        "parent", *figures, saved, F.when(F.col("ends").isNull(), F.lit(NO_ENDS)).otherwise(F.sha2("ends", 256)).alias("ends_sha256")
    )
    parts = nodes.where("node is not null")
    pieces = parts.where("ends is not null").select("node", "chunk", "ends").repartition("node").sortWithinPartitions("node", "chunk")
    ends = pieces.mapInArrow(_joined_pieces, "of binary, ends_sha256 string")
    merged = parts.groupBy("node", "depth").agg(
        F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "sharing")],
        F.max("above").alias("above"),
    )
    merged = store(
        merged.join(ends, merged.node == ends.of, "left").select(
            "node", "parent", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved,
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        ),
        "trie-merged",
    )
    every = whole.unionByName(merged.drop("node"))
    above = merged.select(F.col("node").alias("above_"), F.col("conv_id").alias("above_conv"))
    out = every.join(checked_broadcast(above), F.col("parent") == F.col("above_"), "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
