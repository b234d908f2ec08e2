"""Words of whole texts as flat numpy arrays, one Arrow batch at a time.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Those bytes never occur inside a multi-byte
UTF-8 character, so the batch is split on its bytes: no Python string is made per word. Nothing here knows Spark;
the operators call it inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes of text that one numpy pass takes; a longer text is a pass of its own
PASS_BYTES = 2 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base & 0xFFFFFFFFFFFFFFFF
    return out


_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_WORD_TABLE = np.where(_BLANK, np.uint64(0), _TABLE)
# a place in a span longer than this is weighed by its place modulo the length and by a second factor
_PLACES = 4096
_POWER = _powers(0xD6E8FEB86659FD93, _PLACES)


def hash_segments(data: np.ndarray, starts: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit sum over the bytes from each start to the next start (or the end), weighed by value and place."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    data, first = data[starts[0] :], starts - starts[0]
    lengths = np.diff(first, append=len(data))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    value = table[data]
    with np.errstate(over="ignore"):
        if int(lengths.max()) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            value[far] *= mix((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
            place[far] %= _PLACES
        value *= _POWER[place]
        return np.add.reduceat(value, first)


def byte_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What bytes at places of a span add to its sum."""
    with np.errstate(over="ignore"):
        return _TABLE[data] * _POWER[place]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes ``data[start:end]``; spans ascend and don't overlap."""
    inside = np.zeros(len(data), dtype=np.uint64)
    if not len(starts):
        return inside[:0]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    outside = np.cumsum(edge[:-1]) == 0
    masked = data.copy()
    masked[outside] = 0x20
    with np.errstate(over="ignore"):
        return mix(hash_segments(masked, starts, _WORD_TABLE) + (ends - starts).astype(np.uint64) * _ODD)


class Texts:
    """The bytes of some texts, one after the other; ``begin[i]:begin[i + 1]`` is text i. Null texts are empty."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        column = pc.fill_null(column, "")
        _, offsets, data = column.buffers()
        begin = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        self.begin = begin - begin[0]
        self.data = whole[begin[0] : begin[-1]]
        self.n = len(column)

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.begin[i + 1]].tobytes()

    def code_points(self) -> np.ndarray:
        """Characters of each text."""
        return np.diff(np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])[self.begin])

    def words(self) -> Words:
        return self._runs(~_BLANK[self.data], self.data)

    def letter_runs(self) -> Words:
        """Runs of A-Z, a-z and bytes above ASCII."""
        return self.runs(_LETTER[self.data])

    def runs(self, inside: np.ndarray) -> Words:
        """Runs of bytes that are inside."""
        return self._runs(inside, np.where(inside, self.data, 0x20).astype(np.uint8))

    def _runs(self, inside: np.ndarray, data: np.ndarray) -> Words:
        """``data``: the bytes, blank outside of the runs."""
        n = len(self.data)
        blank = ~inside
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.begin] = True
        before = np.ones(n, dtype=bool)
        before[1:] = blank[:-1]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.ones(n, dtype=bool)
        after[:-1] = blank[1:]
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        count = np.searchsorted(starts, self.begin)
        return Words(self, data, starts, ends, count)


class Words:
    """Word spans of some texts; ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: Texts, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.texts, self.data, self.starts, self.ends, self.first = texts, data, starts, ends, first
        self.per_text = np.diff(first)
        self.owner = np.repeat(np.arange(texts.n), self.per_text)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if asked for."""
        data = self.data
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
        with np.errstate(over="ignore"):
            return mix(hash_segments(data, self.starts, _WORD_TABLE) + (self.ends - self.starts).astype(np.uint64) * _ODD)


def windows(words: Words, hashes: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and first word of each window of ``size`` words inside one text.

    With ``short`` a text of fewer words (but some) has its whole sequence as one window.
    """
    n = len(hashes)
    whole = words.per_text >= size
    value = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            value = mix(value + hashes[i : i + len(value)] + np.uint64(i + 1) * _ODD)
    owner = words.owner[: len(value)]
    inside = np.flatnonzero(owner == words.owner[size - 1 :][: len(value)])
    value, owner, at = value[inside], owner[inside], inside
    if short and (few := np.flatnonzero(~whole & (words.per_text > 0))).size:
        extra = np.zeros(len(few), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size - 1):
                has = words.per_text[few] > i
                step = mix(extra[has] + hashes[words.first[few[has]] + i] + np.uint64(i + 1) * _ODD)
                extra[has] = step
            extra = mix(extra + words.per_text[few].astype(np.uint64) * _MIX1)
        value, owner, at = np.concatenate([value, extra]), np.concatenate([owner, few]), np.concatenate([at, words.first[few]])
        order = np.argsort(owner, kind="stable")
        value, owner, at = value[order], owner[order], at[order]
    return value, owner, at


def passes(batches, column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of text, never inside a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
