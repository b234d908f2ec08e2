"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words with one blank between them and an end behind. It is read byte by byte, each byte bit by
bit. Three predictors give the chance that the next bit is 1, each by the bits of the byte read so far and a hashed context:
the three bytes before within the word, all bytes before within the word (these two count over all training documents), and
the four bytes before, blanks included, learned within the text itself. A mixer adds their logits with weights. Gates choose
the weights: each bit of a byte has its own, the three bytes have others where the word so far was never seen, and the word has
others the surer it is. The weights move along the error of each bit. An adaptive table corrects the mixed probability once
more; the mean of both is what a bit costs.

The weights, the predictor of the text and the correction start anew every ``SEGMENT`` bytes, so that the segments of a
batch are read in step; contexts reach over these cuts. So a score depends on the text and the counts alone.

The counts grow with the corpus, so no task holds them. Documents form blocks of some thousand. A block counts its distinct
contexts and sends each, once, to the shard of the context's hash; the shard adds up the counts of all blocks and sends
back to each block the logits of what it asked for. So there are as many counters as contexts; none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store

# documents of a block, as a power of two
BLOCK_BITS = 13
# bytes that are read before the online parts start anew
SEGMENT = 4096
# bytes of text of one pass that counts and of one that scores, those of distinct units whose contexts are made at once, and
# segments that are read in step
STEP_BYTES = 16 << 20
READ_BYTES = 8 << 20
PART_BYTES = 1 << 20
LANES = 640
# steps that are looked up at once, a multiple of 8
AHEAD = 16
END = 0xFF
# what a bit counts beyond its count, and the logits' unit and bound as they are sent
PRIOR = 0.03
UNIT = 16.0
# the mixer's rate and first weights, for: three where the word is new, three, word if unsure, word if sure, own
MIX_RATE = np.float32(0.008)
WEIGHTS = (0.9, 0.45, 0.65, 0.7, 0.15)
SURE = 40
# buckets and rate of the correction
BUCKETS = 32
FIX_RATE = np.float32(0.03)
LEAST = np.float32(1 / 8192)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(256, dtype=np.uint32)[:, None]
# of each byte its bits, what they teach a state (three quarters of it stay), and the hashed tree nodes before them: a 1 and the bits above
_BITS = (_BYTES >> np.arange(7, -1, -1, dtype=np.uint32) & np.uint32(1)).astype(np.float32)
_TEACH = (_BITS * 66).astype(np.int8)
_SPREAD = np.uint32(0x85EBCA6B)
_NODES = ((_BYTES + np.uint32(256)) >> np.arange(8, 0, -1, dtype=np.uint32)) * np.uint32(0x9E3779B1) * _SPREAD
# lower case, and one kind of blank
_PLAIN = bytes(0x20 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END_WORD = W.mix(np.array([END], dtype=np.uint64))[0]

# the text's own predictor: a slot's state is a logit of 64 steps of an eighth, each bit moves it a quarter of the way to the end
SLOT_BITS = 12


class Units:
    """The distinct ones of units that lie one after the other and end at ``ends``; ``which`` says which one each is."""

    def __init__(self, ends: np.ndarray, data: np.ndarray):
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)]).dictionary_encode()
        self.which = spans.indices.to_numpy()
        _, offsets, distinct = spans.dictionary.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[: len(spans.dictionary) + 1]
        self.unit_length, self.unit_first = np.diff(offsets), offsets[:-1]
        self.unit_data = np.frombuffer(distinct, dtype=np.uint8)[: offsets[-1]]

    def contexts(self, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Per byte of the distinct units, or of some, the keys of the two counted contexts: 48 bits of hash, then the byte."""
        first, length = self.unit_first[some], self.unit_length[some]
        begin = int(first[0]) if len(first) else 0
        data, first = self.unit_data[begin : begin + int(length.sum())], first - begin
        place = W.ragged(np.zeros(len(length), dtype=np.int64), length)
        three = np.zeros(len(data), dtype=np.uint32)
        for back in (3, 2, 1):
            shifted = np.full(len(data), 256, dtype=np.uint32)
            np.copyto(shifted[back:], data[:-back], where=place[back:] >= back)
            three <<= np.uint32(9)
            three |= shifted
        value = W.byte_values(data, place % 4096 if int(length.max(initial=0)) > 4096 else place)
        with np.errstate(over="ignore"):
            if int(length.max(initial=0)) > 4096:
                value *= W.mix((place // 4096).astype(np.uint64)) | np.uint64(1)
            upto = np.cumsum(value) - value
            word = upto - np.repeat(upto[first], length) + place.astype(np.uint64) * _ODD
            return tuple(W.mix(context + np.uint64(k + 1) * _ODD) >> np.uint64(16) << np.uint64(8) | data for k, context in enumerate((three.astype(np.uint64), word)))

    def unit_words(self) -> np.ndarray:
        """Hash of the word of each distinct unit that has one."""
        masked = self.unit_data.copy()
        masked[self.unit_first + self.unit_length - 1] = 0x20
        some = self.unit_length > 1
        first = self.unit_first[some]
        return W.hash_spans(masked, first, first + self.unit_length[some] - 1)


class Stream(Units):
    """Lower-cased units of some texts: each word and the blank or, behind a text's last word, the end that follows it."""

    def __init__(self, column: pa.Array):
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
        # a blank behind every text, so that no word reaches into the next one
        texts = W.Texts(pc.binary_join_element_wise(pc.fill_null(column, ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
        self.n = texts.n
        data = np.frombuffer(texts.data.tobytes().translate(_PLAIN), dtype=np.uint8)
        blank = data == 0x20
        kept = ~blank
        # the blank behind each word, and that of a text without words
        behind = np.flatnonzero(blank[1:] & kept[:-1]) + 1
        per_text = np.diff(np.searchsorted(behind, texts.begin))
        kept[behind] = True
        kept[texts.begin[1:][per_text == 0] - 1] = True
        units = np.maximum(per_text, 1)
        self.owner = np.repeat(np.arange(texts.n), units)
        data = data[kept]
        ends = np.flatnonzero(data == 0x20) + 1
        last = ends[np.cumsum(units) - 1]
        data[last - 1] = END
        self.data, self.begin, self.length = data, np.append(0, last), np.diff(ends, prepend=0)
        super().__init__(ends, data)


_CODEC = pa.Codec("zstd", compression_level=1)


def _squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as bytes: of rising ones the differences, the n-th bytes of all together, compressed."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(values).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def _spread(data: bytes, kind, width: int, rising: bool = False) -> np.ndarray:
    """The numbers of ``_squeezed``; ``width``: bytes of one (or of one row of bytes)."""
    n = int.from_bytes(data[:8], "little")
    planes = _CODEC.decompress(data[8:], n * width, asbytes=True) if n else b""
    values = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T).view(kind)
    values = values.ravel() if np.dtype(kind).itemsize == width else values
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in rising order, and which one each key is; only the distinct ones are sorted."""
    found = pa.array(keys).dictionary_encode()
    unique = found.dictionary.to_numpy()
    order = np.argsort(unique)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return unique[order], rank[found.indices.to_numpy()]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, which = _distinct(keys)
    return unique, np.bincount(which, weights=counts, minlength=len(unique)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct contexts and words of each block with their counts in its training documents, by shard."""
    block, held, units = None, [], []
    for batch in W.passes(batches, limit=STEP_BYTES):
        numbers = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
            if block is not None and numbers[a] != block:
                yield _sent(block, [*held, *_counted(units)], shards)
                held, units = [], []
            block = int(numbers[a])
            part = batch.slice(a, b - a)
            stream = Stream(part.column("text"))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            count = np.bincount(stream.which, weights=train[stream.owner], minlength=len(stream.unit_length)).astype(np.int64)
            units.append((stream.unit_data, stream.unit_length, count, int(train.sum())))
            # contexts are made once of what several batches have
            if sum(len(data) for data, *_ in units) >= STEP_BYTES:
                held += _counted(units)
                units = []
    if block is not None:
        yield _sent(block, [*held, *_counted(units)], shards)


def _counted(found: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct contexts and words with their counts, if any, of the units that some batches have, how often, and their texts' ends."""
    if not found:
        return
    data, length, count = (np.concatenate([f[i] for f in found]) for i in range(3))
    units = Units(np.cumsum(length), data)
    count = np.bincount(units.which, weights=count, minlength=len(units.unit_length)).astype(np.int64)
    words, word_counts = np.append(units.unit_words(), _END_WORD), np.append(count[units.unit_length > 1], sum(f[3] for f in found))
    cuts = sorted({0, *np.searchsorted(units.unit_first, np.arange(PART_BYTES, len(units.unit_data), PART_BYTES)).tolist(), len(count)})
    parts = [_sums(np.concatenate(units.contexts(slice(a, b))), np.tile(np.repeat(count[a:b], units.unit_length[a:b]), 2)) for a, b in zip(cuts, cuts[1:], strict=False)]
    yield (*_merged(parts), *_sums(words, word_counts))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the sums of some parts; their keys are distinct within a part, so sorting beats a dictionary."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _sent(block: int, held: list, shards: int) -> pa.RecordBatch:
    (keys, sums), (words, word_sums) = _merged([h[:2] for h in held]), _merged([h[2:] for h in held])
    bits, shard = shards.bit_length() - 1, np.arange(shards, dtype=np.uint64)
    a, b = (np.append(np.searchsorted(x, shard << np.uint64(size - bits)), len(x)) for x, size in ((keys, 56), (words, 64)))
    some = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))

    def pieces(values: np.ndarray, cut: np.ndarray, rising: bool = False) -> pa.Array:
        return pa.array([_squeezed(values[cut[s] : cut[s + 1]], rising) for s in some], pa.binary())

    return pa.RecordBatch.from_pydict({
        "block": pa.array(np.full(len(some), block), pa.int64()), "shard": pa.array(some, pa.int64()), "keys": pieces(keys, a, True), "counts": pieces(sums, a),
        "words": pieces(words, b, True), "word_counts": pieces(word_sums, b),
    })


ASKED = "block long, shard long, keys binary, counts binary, words binary, word_counts binary"
ANSWERS = "block long, keys binary, logits binary, words binary, word_counts binary, tokens long, vocabulary long"


def logits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For sorted distinct keys the logit of each bit of their byte being 1 where it is read, in units, as bytes."""
    out = np.zeros((len(keys), 8), dtype=np.int8)
    if not len(keys):
        return out

    def group(shift: int) -> np.ndarray:
        named = keys >> np.uint64(shift)
        starts = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
        return np.repeat(np.add.reduceat(counts, starts), np.diff(starts, append=len(keys)))

    node = group(8)
    for j in range(8):
        child = group(7 - j)
        one = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
        logit = np.log((child + PRIOR) / (node - child + PRIOR)) * UNIT
        out[:, j] = np.clip(np.rint(np.where(one, logit, -logit)), -127, 127)
        node = child
    return out


def _answered(table: pa.Table) -> pa.Table:
    """The counts of all blocks added up: logits and word counts for each block, and the shard's totals in a row of its own."""
    n = table.num_rows
    column = {name: table.column(name).to_pylist() for name in table.column_names}

    def summed(name: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [_spread(x, np.uint64, 8, True) for x in column[name]]
        given = np.concatenate([_spread(x, np.int64, 8) for x in column[counts]])
        unique, which = _distinct(np.concatenate(parts))
        total = np.bincount(which, weights=given, minlength=len(unique)).astype(np.int64)
        return unique, total, which, np.cumsum([0, *map(len, parts)])

    keys, totals, which, cut = summed("keys", "counts")
    rows = logits(keys, totals)
    words, word_totals, word_which, word_cut = summed("words", "word_counts")
    blocks = [*column["block"], -1 - int(column["shard"][0])]
    return pa.table({
        "block": pa.array(blocks, pa.int64()),
        "keys": pa.array([*column["keys"], None], pa.binary()),
        "logits": pa.array([*(_squeezed(rows[which[cut[i] : cut[i + 1]]]) for i in range(n)), None], pa.binary()),
        "words": pa.array([*column["words"], None], pa.binary()),
        "word_counts": pa.array([*(_squeezed(word_totals[word_which[word_cut[i] : word_cut[i + 1]]]) for i in range(n)), None], pa.binary()),
        "tokens": pa.array([*([0] * n), int(word_totals.sum())], pa.int64()),
        "vocabulary": pa.array([*([0] * n), int(np.count_nonzero(word_totals))], pa.int64()),
    })


def costs(three: np.ndarray, word: np.ndarray, place: np.ndarray, data: np.ndarray, recent: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each segment ``data[begin:begin + length]``.

    ``three[place[i]]`` and ``word[place[i]]`` are the eight logits of byte i that the two counted predictors give, as one number,
    ``recent[i]`` is the hash of the bytes before. Segments of like length are read in step, as many as keep their tables in the
    processor's cache.
    """
    out = np.empty(len(begin), dtype=np.float64)
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        out[some] = _in_step(three, word, place, data, recent, begin[some], length[some])
    return out


def _in_step(three: np.ndarray, word: np.ndarray, place: np.ndarray, data: np.ndarray, recent: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``costs`` of a few segments, the longest first.

    All bits of a byte are mixed at once: each has weights of its own, and what the byte teaches is used from the next one on.
    Arrays are by lane, then bit, so what depends on the byte alone is a row of a table. What does not depend on the bytes before
    is looked up for ``AHEAD`` steps at once, and their probabilities are added up together; a lane that ends among these steps
    goes on to the last of them, but what it reads there costs nothing. Logits are in ``UNIT``; the weights are divided by it and
    have the other sign. Of a predictor's two sets of weights the one in use lies in ``weights``.
    """
    lanes = len(begin)
    total = np.zeros(lanes, dtype=np.float64)
    own = np.full(lanes << SLOT_BITS, 32, dtype=np.int8)
    first = -np.array(WEIGHTS, dtype=np.float32) / np.float32(UNIT)
    weights, unused = np.empty((3, lanes, 8), dtype=np.float32), np.empty((2, lanes, 8), dtype=np.float32)
    weights[:], unused[:] = first[[1, 2, 4], None, None], first[[0, 3], None, None]
    # eight weights as one value, to swap them
    used, spare = weights[:2].view("V32").ravel(), unused.view("V32").ravel()
    # the gates of the step before and of the steps ahead
    gates = np.zeros((AHEAD + 1, 2, lanes), dtype=bool)
    middle = (np.arange(BUCKETS) - BUCKETS / 2 + 0.5) / 2
    fixed = np.tile(1 / (1 + np.exp(-middle)), 8 * lanes).astype(np.float32)
    lane_slot = np.repeat(np.arange(lanes, dtype=np.uint32) << np.uint32(SLOT_BITS), 8)
    lane_bucket = np.arange(8 * lanes, dtype=np.int32) * np.int32(BUCKETS)
    ahead, sets = np.arange(AHEAD)[:, None], np.arange(AHEAD + 1) * 2 * lanes
    # a step's states, its logits, their products with the weights, and what is computed from them
    states, buckets, places = np.empty(8 * lanes, dtype=np.int8), np.empty(8 * lanes, dtype=np.int32), np.empty(8 * lanes, dtype=np.int64)
    inputs, products, floats = (np.empty((k, 8 * lanes), dtype=np.float32) for k in (3, 3, 4))
    steps = np.arange(0, int(length[0]) if lanes else 0, AHEAD)
    going, whole = np.searchsorted(-length, -steps, "left").tolist(), np.searchsorted(-length, -steps - AHEAD, "right").tolist()
    rate, half, one = MIX_RATE / np.float32(UNIT * UNIT), np.float32(0.5), np.float32(1)
    sides, furthest, middle_bucket = np.float32(-2), np.float32(7.99) * np.float32(2), np.float32(BUCKETS / 2)
    for t, m, through in zip(steps.tolist(), going, whole, strict=True):
        n = 8 * m
        at = begin[:m] + (ahead + t)
        byte = data.take(at, mode="clip").astype(np.intp)
        bits, teach, slots = (table.take(byte, axis=0).reshape(AHEAD, n) for table in (_BITS, _TEACH, _NODES))
        slots += recent.take(at, mode="clip").repeat(8).reshape(AHEAD, n)
        slots >>= np.uint32(32 - SLOT_BITS)
        slots += lane_slot[:n]
        slots = slots.astype(np.intp)
        unit = place.take(at, mode="clip").astype(np.intp)
        read = np.empty((AHEAD, 3, n), dtype=np.int8)
        read.view(np.uint64)[:, 0], read.view(np.uint64)[:, 1] = three.take(unit), word.take(unit)
        sure = np.abs(read[:, 1, ::8])
        gates[0] = gates[AHEAD]
        np.equal(sure, 0, out=gates[1:, 0, :m])
        np.greater(sure, SURE, out=gates[1:, 1, :m])
        gates[1:, :, m:] = gates[0, :, m:]
        turned = (gates[1:] != gates[:-1]).ravel().nonzero()[0]
        cuts = np.searchsorted(turned, sets).tolist()
        turned %= 2 * lanes
        chances = np.empty((AHEAD, n), dtype=np.float32)
        w, x, product = weights.reshape(3, -1)[:, :n], inputs[:, :n], products[:, :n]
        state, bucket, where = states[:n], buckets[:n], places[:n]
        dot, p, q, error = floats[:, :n]
        for s in range(AHEAD):
            r, y, slot, lesson = read[s], bits[s], slots[s], teach[s]
            own.take(slot, out=state, mode="clip")
            # an eighth of a logit for each state beyond the middle
            np.add(state, state, out=r[2])
            r[2] -= np.int8(63)
            x[:] = r
            turn = turned[cuts[s] : cuts[s + 1]]
            kept = used.take(turn)
            used[turn] = spare.take(turn)
            spare[turn] = kept
            np.multiply(w, x, out=product)
            np.add(product[0], product[1], out=dot)
            dot += product[2]
            np.exp(dot, out=p)
            p += one
            np.reciprocal(p, out=p)
            dot *= sides
            np.maximum(dot, -furthest, out=dot)
            np.minimum(dot, furthest, out=dot)
            dot += middle_bucket
            bucket[:] = dot
            bucket += lane_bucket[:n]
            where[:] = bucket
            fixed.take(where, out=q, mode="clip")
            np.add(p, q, out=chances[s])
            np.subtract(y, q, out=error)
            error *= FIX_RATE
            error += q
            fixed[where] = error
            p -= y
            p *= rate
            x *= p
            w += x
            lesson -= state
            lesson >>= np.int8(2)
            state += lesson
            own[slot] = state
        # the chances that the bits that came were given
        chances *= half
        chances -= bits
        np.abs(chances, out=chances)
        np.subtract(one, chances, out=chances)
        chances.clip(LEAST, 1 - LEAST, out=chances)
        chance = np.multiply.reduce(np.ascontiguousarray(chances.reshape(AHEAD * m, 8).T), axis=0).reshape(AHEAD, m)
        chance[:, through:][ahead + t >= length[through:m]] = 1
        # eight bytes of the least chances still are a number
        for some in np.log(np.multiply.reduce(chance.reshape(-1, 8, m), axis=1, dtype=np.float64)):
            total[:m] += some
    return total


def _recent(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the four bytes before each byte, within its text, spread as ``_NODES`` are."""

    def hashed(before: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(before[0]), dtype=np.uint32)
        for values in before:
            out *= np.uint32(0x01000193)
            out += values
        out *= np.uint32(0xC2B2AE35)
        out *= _SPREAD
        return out

    n = len(data)
    padded = np.concatenate([np.zeros(4, dtype=np.uint8), data])
    out = hashed([padded[4 - back : 4 - back + n] for back in (1, 2, 3, 4)])
    # the bytes at the head of a text have others before them
    length = np.minimum(np.diff(begin), 4)
    head, place = W.ragged(begin[:-1], length), W.ragged(np.zeros(len(length), dtype=np.int64), length)
    out[head] = hashed([np.where(place >= back, padded[head + 4 - back], np.uint32(256)) for back in (1, 2, 3, 4)])
    return out


def _score(texts: pa.Array, keys: np.ndarray, rows: np.ndarray, words: np.ndarray, word_counts: np.ndarray) -> dict[str, np.ndarray]:
    stream = Stream(texts)
    tables = []
    for asked in stream.contexts():
        unique, which = _distinct(asked)
        # the eight logits as one number
        tables.append(rows.view(np.uint64).ravel()[np.searchsorted(keys, unique)][which])
    begin = np.cumsum(stream.length) - stream.length
    place = np.repeat((stream.unit_first[stream.which] - begin).astype(np.int32), stream.length)
    place += np.arange(len(place), dtype=np.int32)
    sizes = np.diff(stream.begin)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(stream.n), parts)
    inner = W.ragged(np.zeros(stream.n, dtype=np.int64), parts) * SEGMENT
    cost = costs(*tables, place, stream.data, _recent(stream.data, stream.begin), stream.begin[owner] + inner, np.minimum(sizes[owner] - inner, SEGMENT))
    is_word = stream.unit_length > 1
    count = np.zeros(len(is_word), dtype=np.int64)
    count[is_word] = word_counts[np.searchsorted(words, stream.unit_words())]
    count = count[stream.which]
    word = is_word[stream.which]
    ends = int(word_counts[np.searchsorted(words, _END_WORD)])

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(stream.owner, weights=values, minlength=stream.n)

    return {
        "n_bytes": sizes,
        "n_tokens": per_text(word).astype(np.int64) + 1,
        "n_known": per_text(word & (count > 0)).astype(np.int64) + (ends > 0),
        "known_log10": per_text(np.where(word, np.log10(count + 1.0), 0.0)) + np.log10(ends + 1.0),
        "score": np.bincount(owner, weights=cost, minlength=stream.n) / np.log(10),
    }


SCORED = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, known_log10 double, score double, tokens long, vocabulary long"


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(name, pa.int64()) for name in ("n_bytes", "n_tokens", "n_known")]]
    kinds += [("known_log10", pa.float64()), ("score", pa.float64()), ("tokens", pa.int64()), ("vocabulary", pa.int64())]
    schema = pa.schema(kinds)
    if not docs.num_rows:
        # a shard's totals
        none = {name: pa.nulls(answers.num_rows, kind) for name, kind in kinds[:-2]}
        return pa.table({**none, "tokens": answers.column("tokens"), "vocabulary": answers.column("vocabulary")}, schema=schema)

    def joined(name: str, kind, width: int = 8, rising: bool = False) -> np.ndarray:
        return np.concatenate([_spread(x, kind, width, rising) for x in answers.column(name).to_pylist()])

    keys, rows = joined("keys", np.uint64, rising=True), joined("logits", np.int8)
    words, word_counts = joined("words", np.uint64, rising=True), joined("word_counts", np.int64)
    order, word_order = np.argsort(keys, kind="stable"), np.argsort(words, kind="stable")
    keys, rows, words, word_counts = keys[order], rows[order], words[word_order], word_counts[word_order]
    out = []
    # over the batches' ends, so that all lanes have something to read
    sizes = pc.fill_null(pc.binary_length(docs.column("text")), 0).to_numpy()
    cuts = (np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // READ_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, docs.num_rows], strict=True):
        piece = docs.slice(a, b - a)
        figures = _score(piece.column("text"), keys, rows, words, word_counts)
        zero = np.zeros(piece.num_rows, dtype=np.int64)
        out.append(pa.table({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), **figures, "tokens": zero, "vocabulary": zero}, schema=schema))
    return pa.concat_tables(out)


def mixed_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of ``docs(doc_id, text, ...)``.

    Rows for which ``held_out`` is not true are learned from. score is the log10 probability that the model gives the
    lower-cased text and its end; base_score that of its words and its end by single counts. A null or empty text is
    its end alone. Ids may be null or repeated, each row is scored and counted for itself; other columns are ignored;
    an empty table gives an empty result. A block of documents (``1 << BLOCK_BITS`` rows at most) is read by one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
    )
    blocked = store(rows, "lm-blocks", compression="zstd")
    blocks = blocked.select("block").distinct().count()
    shards = 1 << max(4, (max(1, blocks) - 1).bit_length())
    asked = blocked.select("block", "held_out", "text").mapInArrow(lambda batches: _asked(batches, shards), ASKED)
    answers = asked.groupBy("shard").applyInArrow(_answered, ANSWERS)
    scored = store(blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, SCORED), "lm-scores")
    totals = scored.where("n_tokens is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()
    whole = F.lit(float(totals.n + totals.v + 1))
    return scored.where("n_tokens is not null").select(
        "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("known_log10") - F.col("n_tokens") * F.log10(whole)).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def hashed_fold(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves 2 modulo 7; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))
