"""Chunks of texts that a tokenizer treats one by one, encoded once per distinct chunk.

A tokenizer that never joins bytes across certain places gives for a text the same ids as for its chunks between
those places. Natural text repeats its chunks, so each pass over a batch finds the distinct ones, looks them up in a
table that the Python worker keeps, and encodes only the new ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pulsegrid.llm import words as W

# distinct chunks a worker keeps, some 60 bytes each; beyond that the table starts anew
KEPT = 1_500_000


class Chunks:
    """Chunks of some texts; ``first[i]:first[i + 1]`` are those of text i, an empty text has none."""

    def __init__(self, texts: W.Texts, before: np.ndarray):
        """``before``: whether a chunk begins at a byte (a text's first byte always begins one)."""
        cut = before.copy()
        cut[texts.begin[:-1][np.diff(texts.begin) > 0]] = True
        self.texts = texts
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], len(texts.data))
        self.first = np.searchsorted(self.starts, texts.begin)

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return W.mix(W.hash_segments(self.texts.data, self.starts) + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def take(self, which: np.ndarray) -> list[bytes]:
        data = self.texts.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


class Memo:
    """Numbers of every chunk seen by this worker, by the chunk's hash: sorted runs that are merged as they grow."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        """``encode``: chunks to (all numbers one after the other, how many of each chunk)."""
        self.encode, self.kept = encode, kept
        self._clear()

    def _clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.start, self.count, self.values = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.size, self.used = 0, 0

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        out = np.empty(max(2 * len(array), used + more, 1024), dtype=array.dtype)
        out[:used] = array[:used]
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        place = np.full(len(hashes), -1, dtype=np.int64)
        for keys, ref in self.runs:
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            hit = keys[at] == hashes
            place[hit] = ref[at[hit]]
        return place

    def _add(self, hashes: np.ndarray, values: np.ndarray, count: np.ndarray) -> None:
        n, m = len(hashes), len(values)
        self.start, self.count = self._grown(self.start, self.size, n), self._grown(self.count, self.size, n)
        self.values = self._grown(self.values, self.used, m)
        self.start[self.size : self.size + n] = self.used + np.cumsum(count) - count
        self.count[self.size : self.size + n] = count
        self.values[self.used : self.used + m] = values
        keys, ref = hashes, np.arange(self.size, self.size + n, dtype=np.int32)
        self.size, self.used = self.size + n, self.used + m
        while self.runs and len(self.runs[-1][0]) < 2 * len(keys):
            old, old_ref = self.runs.pop()
            keys, ref = np.concatenate([old, keys]), np.concatenate([old_ref, ref])
            order = np.argsort(keys, kind="stable")
            keys, ref = keys[order], ref[order]
        self.runs.append((keys, ref))

    def of(self, chunks: Chunks) -> np.ndarray:
        """For every chunk its entry: ``start[e]:start[e] + count[e]`` of ``values``."""
        if self.size > self.kept:
            self._clear()
        unique, sample, which = np.unique(chunks.hashes(), return_index=True, return_inverse=True)
        place = self._find(unique)
        new = np.flatnonzero(place < 0)
        if new.size:
            begin = self.size
            values, count = self.encode(chunks.take(sample[new]))
            self._add(unique[new], np.asarray(values, np.int32), np.asarray(count, np.int32))
            place[new] = np.arange(begin, self.size)
        return place[which]

    def numbers(self, entries: np.ndarray) -> np.ndarray:
        return self.values[W.ragged(self.start[entries], self.count[entries].astype(np.int64))]

    def per_text(self, chunks: Chunks, entries: np.ndarray) -> np.ndarray:
        """How many numbers each text has."""
        return np.diff(np.concatenate([[0], np.cumsum(self.count[entries], dtype=np.int64)])[chunks.first])
