"""Similarity join on word shingles with prefixes of token combinations.

Every document is a set of shingles. All sets are sorted by one order, rare shingles first, then the frequent
ones by frequency. Of two sets with a Jaccard similarity of t or more, both share a shingle within their first
n - ceil(t n) + 1 (the prefix). A rare shingle of the prefix is a signature by itself. Where the prefix reaches the
frequent shingles, it is extended by g more, and then the two sets share at least g + 1 shingles of the extended
prefixes. Frequent shingles are dealt into g groups by their hash, so one group holds two shared ones: the
signatures are the pairs inside a group. g is a power of two by the set's size; a set near a step emits both.
If a rare shingle is shared in the extended prefix, it stands before a shared one of the plain prefix, hence is in
the plain prefix itself: nothing is lost. Of two sets the smaller shares more of itself, so for it the first
n - ceil(2 t n / (1 + t)) + 1 are enough (the index prefix); a signature tells whether it lies there, and two sets
are compared only if it does for the smaller one, or for both if they are of equal size.

Work is kept low in four ways. Equal sets are one class from the start. Sizes are dealt into bands by powers of
1 / t, and only classes of the same or the next band are compared. Of the classes of a signature and band, the one
with the fewest rare shingles in its prefix is the hub, and all others are compared with it; pairs that do not
involve a hub are compared only if their sides are still in different components. A bitmap of parities per set,
whose distance never exceeds the number of differing shingles, drops most pairs before the sets are fetched for the
exact count. No list of a signature's members is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store
from pulsegrid.llm.components import components
from pulsegrid.operators.joins import checked_broadcast

# counters of the frequency sketch, a shingle is counted by the top bits of its hash; 8 MB whatever the corpus
SKETCH_BITS = 20
SLICES = 16
# a counter this far above what an even spread of all shingles gives it is taken as frequent
FREQUENT = 48

# bits of a set's bitmap; sets of LONG shingles or more have a second, wider one
BITS, WIDE_BITS, LONG = 1024, 16384, 2000
_BAND = 47

_TAG = np.uint64(0xA24BAED4963EE407)


def _sets(piece: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each row with an id and at least one word."""
    words = W.Texts(piece.column("text")).words()
    value, owner, _ = W.windows(words, words.hashes(lower=True), size, short=True)
    bounds = np.searchsorted(owner, np.arange(piece.num_rows + 1))
    for row in range(piece.num_rows):
        yield row, np.unique(value[bounds[row] : bounds[row + 1]])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Documents by sketch counter, over the whole table. A copy inside one task counts once."""

    def count(batches):
        total, seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64), set()
        for piece in W.passes(batches):
            fresh = []
            for _, shingles in _sets(piece, size):
                if len(shingles) and (key := _digest(shingles)) not in seen:
                    seen.add(key)
                    fresh.append(shingles)
            if fresh:
                total += np.bincount((np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        for i, part in enumerate(np.split(total.astype("<u4"), SLICES)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(part, "<u4").astype(np.int64)
        for i, part in totals.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([np.minimum(part, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.int64)
    for row in parts.collect():  # at most SLICES rows of fixed size
        out[row.slice] = np.frombuffer(row.counts, "<u4")
    return out.reshape(-1)


def frequent_above(counts: np.ndarray) -> int:
    even = counts.sum() / len(counts)
    return int(even + 6 * even**0.5 + FREQUENT)


def groups_for(n: int) -> int:
    return 1 << max(0, n.bit_length() - 5)


def signatures(shingles: np.ndarray, counts: np.ndarray, limit: int, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of one sorted set, and how rare its prefix is (0 to 127, 0: no rare shingle).

    The lowest bit of a signature is 1 if it lies in the index prefix; it is no part of the signature's name.
    """
    n = len(shingles)
    if n < 2:  # a set of one shingle is like no other set
        return np.empty(0, dtype=np.uint64), 0
    least, least_small = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    prefix, index = n - least + 1, n - least_small + 1
    count = counts[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    often = count > limit
    rare = shingles[~often]
    bit = np.uint64(1)
    single = W.mix(rare[:prefix]) & ~bit
    single[:index] |= bit
    if len(rare) >= prefix:
        return single, 127
    usual, usual_count = shingles[often], count[often]
    usual = usual[np.lexsort((usual, usual_count))]
    out = [single]
    for g in {groups_for(least), groups_for(100 * n // percent)}:
        taken = usual[: max(0, min(n, prefix + g) - len(rare))]
        # the index prefix must reach the frequent shingles, else a shared one in it is rare
        inside = (np.arange(len(taken)) + len(rare) < index + g) & (len(rare) < index)
        spread = W.mix(taken + _TAG)
        group = spread % np.uint64(g)
        order = np.argsort(group, kind="stable")
        taken, inside, group = taken[order], inside[order], group[order]
        sizes = np.unique(group, return_counts=True)[1]
        base = np.cumsum(sizes) - sizes
        # for member i of a group of s, the pairs (i, i + 1 .. s - 1)
        inner = np.arange(len(taken)) - np.repeat(base, sizes)
        right = np.repeat(sizes, sizes) - inner - 1
        left = np.repeat(np.arange(len(taken)), right)
        other = W.ragged(np.arange(len(taken)) + 1, right)
        with np.errstate(over="ignore"):
            pair = W.mix(W.mix(taken[left] ^ _TAG) + W.mix(taken[other] ^ _TAG) + np.uint64(g)) & ~bit
        out.append(pair | (inside[left] & inside[other]).astype(np.uint64))
    return np.unique(np.concatenate(out)), 127 * len(rare) // prefix


def _bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """One bit per counter: whether an odd number of shingles falls on it."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sets_with_signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp of every row; key, bits and sigs of the first of equal sets in a task."""
    counts = sketch_counts(docs, size)
    limit = frequent_above(counts)
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))

    def each(batches):
        seen: set[bytes] = set()
        for piece in W.passes(batches):
            n, fp, key, bits, wide, sigs = [], [], [], [], [], []
            for _, shingles in _sets(piece, size):
                n.append(len(shingles))
                fp.append(digest := _digest(shingles) if len(shingles) else None)
                if digest is None or digest in seen:
                    key.append(None), bits.append(None), wide.append(None), sigs.append(None)
                    continue
                seen.add(digest)
                sig, rareness = signatures(shingles, shared.value, limit, percent)
                # sorts by rareness, so that the smallest key of a signature and band is the hub
                band = int(np.log(len(shingles)) / np.log(100 / percent) + 1e-9)
                key.append(rareness << 56 | min(band, 511) << _BAND | int.from_bytes(digest[:6], "big") >> 1)
                bits.append(_bitmap(shingles, BITS)), sigs.append(sig.view(np.int64))
                wide.append(_bitmap(shingles, WIDE_BITS) if len(shingles) >= LONG else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()),
                "key": pa.array(key, pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64())), "wide": pa.array(wide, pa.list_(pa.int64())), "sigs": pa.array(sigs, pa.list_(pa.int64())),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    schema = "doc_id long, n_shingles long, fp binary, key long, bits array<long>, wide array<long>, sigs array<long>"
    return store(rows.mapInArrow(each, schema), "ngram-sets")


def _fetch_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and shingles of the documents named by ``wanted(doc_id, fp)``."""

    def each(batches):
        for piece in W.passes(batches):
            sets = [s for _, s in _sets(piece, size)]
            same = pa.array([len(s) > 0 and _digest(s) == fp for s, fp in zip(sets, piece.column("fp").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_pydict({"fp": piece.column("fp"), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}).filter(same)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(checked_broadcast(wanted), "doc_id").select("fp", "text")
    return store(found.mapInArrow(each, "fp binary, shingles array<long>").dropDuplicates(["fp"]), "ngram-candidates")


def _distance(bits: str) -> Column:
    """Differing bits of the two sides' bitmaps; 0 where one has none."""
    words = F.zip_with(f"{bits}_a", f"{bits}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.coalesce(F.aggregate(words, F.lit(0), lambda total, x: total + x), F.lit(0))


def _verified(docs: DataFrame, pairs: DataFrame, marks: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of fingerprints whose sets are similar, from pairs of keys."""

    def side(x: str) -> DataFrame:
        return marks.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "bits", "wide", "doc_id")))

    na, nb = F.col("n_a"), F.col("n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * na >= percent * nb) & (100 * nb >= percent * na))
    # at most (1 - t) / (1 + t) of both sizes may differ
    most = (100 - percent) * (na + nb)
    near = both.where((100 + percent) * _distance("bits") <= most).where((100 + percent) * _distance("wide") <= most)
    near = store(near.select("fp_a", "fp_b", "doc_id_a", "doc_id_b"), "ngram-near")
    if near.isEmpty():
        return near.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    ends = near.select(F.col("doc_id_a").alias("doc_id"), F.col("fp_a").alias("fp")).unionByName(near.select(F.col("doc_id_b").alias("doc_id"), F.col("fp_b").alias("fp")))
    sets = _fetch_sets(docs, ends.distinct(), size)
    left = sets.select(F.col("fp").alias("fp_a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("fp").alias("fp_b"), F.col("shingles").alias("sb"))
    common = near.join(left, "fp_a").join(right, "fp_b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    enough = 100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))
    return store(common.where(enough).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")), "ngram-links")


def link_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text, ...)``.

    Two rows link when the Jaccard similarity of their sets of distinct ``size``-word shingles (words lower-cased
    in A-Z) is at least ``percent`` / 100; component_id is the smallest doc_id of the component. A row without words
    or text has no shingle, is linked with nothing and is its own component. A row without id takes part in no link
    and has no component. Repeated rows are returned as often as they come; rows that share an id are one node only
    where they share the set. Other columns are ignored. An empty table gives an empty result.
    """
    return _linked(docs, size, percent).select("doc_id", "n_shingles", "component_id").unionByName(_without_id(docs, size))


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp, component_id and first of every row with an id.

    first: the row has the component's smallest id and, of the sets under that id, the one with the smallest fp. A row
    without words has no fp and is first.
    """
    bounded_batches(docs.sparkSession)
    rows = sets_with_signatures(docs, size, percent)
    known = rows.where("fp is not null")
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    postings = known.select("key", F.col("n_shingles").alias("n"), F.explode("sigs").alias("s"))
    postings = postings.select("key", "n", F.col("s").bitwiseAND(F.lit(-2)).alias("sig"), F.col("s").bitwiseAND(1).cast("boolean").alias("inside"))
    shared = postings.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("inside").alias("any")).where("low < high and any").select("sig")
    members = postings.join(shared, "sig").groupBy("sig", "key", "n").agg(F.max("inside").alias("inside"))
    band = F.shiftrightunsigned("key", _BAND).bitwiseAND(511)
    members = store(members.withColumn("band", band.cast("int")), "ngram-members")
    hubs = members.where("inside").groupBy("sig", "band").agg(F.min("key").alias("hub"), F.min_by("n", "key").alias("n_hub"))
    marks = known.where("key is not null").select("key", "fp", F.col("n_shingles").alias("n"), "bits", "wide", "doc_id")
    marks = store(marks.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key", "fp"]), "ngram-marks")

    # the hub lies in the index prefix; the other side must where it is not larger
    with_hub = members.join(hubs, ["sig", "band"])
    pairs = with_hub.where(f"key <> hub and (n > n_hub or inside) and {_alike('n', 'n_hub', percent)}")
    links = _verified(docs, pairs.select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), marks, size, percent)
    parts = components(links, "ngram-parts")

    # the pairs across components, but for those with the hub of their band
    named = marks.select("key", "fp").join(parts, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("component", "fp").alias("part")).distinct()
    rest = members.join(named, "key")
    split = rest.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("sig")
    rest = store(rest.join(split, "sig").join(hubs.drop("n_hub"), ["sig", "band"], "left").withColumn("is_hub", F.col("key").eqNullSafe(F.col("hub"))), "ngram-rest")
    a, b = (rest.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "inside", "part", "band", "is_hub"))) for x in "ab")
    across = a.join(b, "sig").where(
        "key_a < key_b and part_a <> part_b and (n_a > n_b or inside_a) and (n_b > n_a or inside_b)"
        f" and {_alike('n_a', 'n_b', percent)} and not (band_a = band_b and (is_hub_a or is_hub_b))"
    )
    more = _verified(docs, across.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct(), marks, size, percent)
    if not more.isEmpty():
        parts = components(links.unionByName(more), "ngram-parts")

    # smallest id of each component and its set, for the classes that have copies or links
    linked = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", "copies", "component")
    low = linked.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("low"))
    names = linked.where("component is not null or copies > 1").join(low, "component", "left")
    names = names.select(F.col("fp").alias("of"), F.coalesce("low.doc_id", "doc_id").alias("low_id"), F.coalesce("low.fp", "fp").alias("low_fp"))
    component = F.coalesce("low_id", "doc_id")
    first = F.col("of").isNull() | ((F.col("doc_id") == component) & (F.col("fp") == F.col("low_fp")))
    return rows.join(names, F.col("fp") == F.col("of"), "left").select("doc_id", "n_shingles", "fp", component.alias("component_id"), first.alias("first"))


def _alike(a: str, b: str, percent: int) -> str:
    """Whether sets of sizes a and b can be similar."""
    return f"100 * {a} >= {percent} * {b} and 100 * {b} >= {percent} * {a}"


def _without_id(docs: DataFrame, size: int) -> DataFrame:
    """The rows without an id: the size of their set, and no component."""

    def each(batches):
        for piece in W.passes(batches):
            n = [len(s) for _, s in _sets(piece, size)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(n), pa.int64()), "n_shingles": pa.array(n, pa.int64()), "component_id": pa.nulls(len(n), pa.int64())})

    rows = docs.where("doc_id is null").select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of each component of ``docs(doc_id, text, ...)``, with all its columns.

    It is a row with the smallest id; of different sets under that id the one with the smallest fingerprint, and of rows with
    equal sets one with the smallest text. Rows without words are repeats of each other where id and text are equal; rows
    without an id all stay. An id may stand for several texts: where only some of its rows go, or equal ones come more than
    once, its rows are told apart by their sets. Only such ids and the ids to drop are joined; they are counted, broadcast
    if few, and else shuffled.
    """
    found = _linked(docs, size, percent)
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("first").alias("stay")).where("n > 1 or stay = 0")
    ids = store(ids, "ngram-ids")
    kept = docs.join(checked_broadcast(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    several = ids.where("n > 1 and stay > 0").select("doc_id")
    if several.isEmpty():
        return kept
    several = checked_broadcast(several)
    first = found.where("first").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("first_id_"), F.col("fp").alias("first_fp_")).distinct()
    first = checked_broadcast(store(first, "ngram-first"))

    def with_set(batches):
        for piece in W.passes(batches):
            fp = pa.array([_digest(s) if len(s) else None for _, s in _sets(piece, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns, fp], names=[*piece.schema.names, "set_fp_"])

    schema = StructType([*docs.schema.fields, StructField("set_fp_", BinaryType())])
    rows = docs.join(several, "doc_id", "left_semi").select(*docs.columns).mapInArrow(with_set, schema)
    rows = rows.join(first, (F.col("doc_id") == F.col("first_id_")) & F.col("set_fp_").eqNullSafe(F.col("first_fp_")), "left_semi")
    once = rows.groupBy("doc_id", "set_fp_", F.when(F.col("set_fp_").isNull(), F.col("text")).alias("bare_")).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row_"))
    return kept.unionByName(once.select("row_.*"))
