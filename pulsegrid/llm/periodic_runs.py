"""Periodic runs of words by recompression.

The words of a batch are the letters of one sequence, with a letter of its own between texts. Recompression rewrites
it in rounds: maximal blocks of one symbol become one symbol each, then, with the symbols dealt to a left and a right
side, every pair of a left symbol and a right one behind it becomes one symbol. Each round takes away at least about a
quarter of what still can shrink, so after a logarithmic number of rounds a text is a single symbol of a run-length
grammar. Equal pieces are rewritten equally except at their edges: how far two places agree is found by climbing
the rounds while the symbols agree and going down again where they part, without any suffix array.

A run of period p and length of at least 2 p holds two neighbours of the grid 0, p, 2 p, ...; so for each period the
places of a grid are extended to both sides, n / 1 + n / 2 + n / 3 + ... candidates in all, most of which differ in their
first letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches

# the shortest stretch that counts as a run, in words
MIN_LENGTH = 12
# candidates that are looked at in one go
BLOCK = 2_000_000


class Grammar:
    """Rounds of recompression over ``letters``; a negative letter is never joined with others and occurs once.

    Round k has its symbols, of each symbol the number of its parent in round k + 1, and for each parent its first
    symbol; ``block`` tells whether the parents are blocks of one symbol or pairs.
    """

    def __init__(self, letters: np.ndarray):
        self.symbols: list[np.ndarray] = [letters]
        self.parent: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.block: list[bool] = []
        self.fresh = int(letters.max(initial=0)) + 1
        rounds = 0
        while not self._done():
            self._blocks()
            # sides are dealt anew each round: no pair may come out of one dealing
            self._pairs(rounds := rounds + 1)

    def _done(self) -> bool:
        fixed = self.symbols[-1] < 0
        return bool((fixed[1:] | fixed[:-1]).all())

    def _named(self, names: np.ndarray, where: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Gives the symbols at ``where`` one new name per distinct (left, right)."""
        rules, which = np.unique(left << 32 | right, return_inverse=True)
        names[where] = self.fresh + which
        self.fresh += len(rules)
        return names

    def _push(self, starts: np.ndarray, names: np.ndarray, block: bool) -> None:
        n = len(self.symbols[-1])
        begins = np.zeros(n, dtype=np.int64)
        begins[starts] = 1
        self.parent.append(np.cumsum(begins) - 1)
        self.first.append(np.append(starts, n))
        self.block.append(block)
        self.symbols.append(names)

    def _blocks(self) -> None:
        s = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return
        length = np.diff(starts, append=len(s))
        names, many = s[starts], np.flatnonzero(length > 1)
        self._push(starts, self._named(names, many, names[many], length[many]), True)

    def _pairs(self, rounds: int) -> None:
        s = self.symbols[-1]
        with np.errstate(over="ignore"):
            side = (W.mix(s.astype(np.uint64) + np.uint64(rounds) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)).astype(bool)
        free = s >= 0
        near = free[:-1] & free[1:]
        one, other = near & ~side[:-1] & side[1:], near & side[:-1] & ~side[1:]
        pair = one if np.count_nonzero(one) >= np.count_nonzero(other) else other
        heads = np.flatnonzero(pair)
        if not heads.size:
            return
        whole = np.ones(len(s), dtype=bool)
        whole[heads + 1] = False
        starts = np.flatnonzero(whole)
        names = s[starts]
        where = np.searchsorted(starts, heads)
        self._push(starts, self._named(names, where, s[heads], s[heads + 1]), False)

    def _left_over(self, k: int, x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Parents of symbols of round k, and how many of the parent's symbols lie from each of them on."""
        parent, first = self.parent[k][x], self.first[k]
        return parent, first[parent + 1] - x if step > 0 else x - first[parent] + 1

    def _size(self, k: int, parent: np.ndarray) -> np.ndarray:
        return self.first[k][parent + 1] - self.first[k][parent]

    def agree(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many letters from ``i`` and from ``j`` on agree, to the right (step 1) or to the left (step -1); i < j."""
        a, b = i.copy(), j.copy()
        live = np.flatnonzero(self.symbols[0][a] == self.symbols[0][b])
        ended: list[np.ndarray] = []
        for k in range(len(self.parent)):
            if not live.size:
                break
            s, up = self.symbols[k], self.symbols[k + 1]
            x, y = a[live], b[live]
            px, rx = self._left_over(k, x, step)
            py, ry = self._left_over(k, y, step)
            inner = (rx < self._size(k, px)) | (ry < self._size(k, py))
            # inside a parent: up to the edge of the nearer one, symbol by symbol the same
            take = np.where(inner, np.minimum(rx, ry) if self.block[k] else 1, 0)
            x, y = x + step * take, y + step * take
            equal = s[x] == s[y]
            px, py = self.parent[k][x], self.parent[k][y]
            climb = equal & (up[px] == up[py])
            # both at an edge with equal symbols under unequal parents: they part within these
            part = np.flatnonzero(equal & ~climb)
            if part.size:
                more = self._common(k, x[part], y[part], step)
                x[part] += step * more
                y[part] += step * more
            a[live], b[live] = np.where(climb, px, x), np.where(climb, py, y)
            ended.append(live[~climb])
            live = live[climb]
        going = np.empty(0, dtype=np.int64)
        for k in range(len(ended) - 1, -1, -1):
            going = np.concatenate([going, ended[k]])
            if not k or not going.size:
                continue
            # what parted in round k is opened in round k - 1
            first, s = self.first[k - 1], self.symbols[k - 1]
            x, y = a[going], b[going]
            x, y = (first[x], first[y]) if step > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            same = np.flatnonzero(s[x] == s[y])
            more = self._common(k - 1, x[same], y[same], step)
            x[same] += step * more
            y[same] += step * more
            a[going], b[going] = x, y
        return (a - i) * step

    def _common(self, k: int, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Symbols that two different parents, entered at their edges, have in common."""
        if not self.block[k]:
            return np.ones(len(x), dtype=np.int64)
        return np.minimum(self._left_over(k, x, step)[1], self._left_over(k, y, step)[1])


def runs_of(letters: np.ndarray, begin: np.ndarray, count: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the runs of each text, by start, then period; starts count in ``letters``.

    Text t is ``letters[begin[t]:begin[t] + count[t]]``; a negative letter stands before, between and behind the texts.
    """
    grammar = Grammar(letters)
    texts = np.flatnonzero(count >= min_length)
    half = count[texts] // 2
    owner = np.repeat(texts, half)
    period = W.ragged(np.ones(len(texts), dtype=np.int64), half)
    # as many neighbouring places as a run has at least that agree with the place a period on
    step = np.maximum(period, min_length - period)
    grid = (count[owner] - period - 1) // step + 1
    upto = np.cumsum(grid)
    found = []
    cut = 0
    while cut < len(owner):
        done = upto[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        n, some = grid[cut:end], np.repeat(np.arange(cut, end), grid[cut:end])
        i = begin[owner[some]] + W.ragged(np.zeros(end - cut, dtype=np.int64), n) * step[some]
        p = period[some]
        like = np.flatnonzero(letters[i] == letters[i + p])
        i, p = i[like], p[like]
        right = grammar.agree(i, i + p, 1)
        left = grammar.agree(i - 1, i + p - 1, -1)
        good = left + right >= np.maximum(p, min_length - p)
        start, length, p = (i - left)[good], (left + right + p)[good], p[good]
        order = np.lexsort((p, length, start))
        start, length, p = start[order], length[order], p[order]
        new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
        found.append((start[new], length[new], p[new]))
        cut = end
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # a stretch is found under every multiple of its smallest period that fits in twice
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch(piece: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    texts = W.Texts(piece.column("text"))
    words = texts.words()
    count, n = words.per_text, texts.n
    # one place before each text and one behind the last are separators
    begin = words.first[:-1] + np.arange(n) + 1
    letters = np.full(len(words.starts) + n + 1, -1, dtype=np.int64)
    fixed = np.append(begin - 1, len(letters) - 1)
    letters[fixed] = -1 - np.arange(n + 1)
    at = np.arange(len(words.starts)) + words.owner + 1
    letters[at] = np.unique(words.hashes(), return_inverse=True)[1]
    start, length, period = runs_of(letters, begin, count, min_length)
    owner = np.searchsorted(begin, start, "right") - 1
    # dropped: from the second period of a run on
    edge = np.zeros(len(letters) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = (np.cumsum(edge[:-1]) == 0)[at]
    changed = np.zeros(n, dtype=bool)
    changed[owner] = True
    out, per = [], np.split(kept, words.first[1:-1])
    for t in range(n):
        parts = texts.text_bytes(t).split()
        if changed[t]:
            parts = [w for w, k in zip(parts, per[t].tolist(), strict=True) if k]
        out.append(b" ".join(parts).decode("utf-8"))
    fields = [pa.array(x, pa.int64()) for x in (start - begin[owner], length, period)]
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_words": pa.array(count, pa.int64()), "runs": runs, "collapsed": pa.array(out, pa.string())})


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed of every row of ``docs(doc_id, text, ...)``.

    A run is a stretch of at least ``min_length`` words and two periods that neither neighbour extends; starts count
    words from 0. collapsed is the text's words without those that a run repeats, joined by one space. A text that is null,
    empty or blank has no words, no runs and an empty collapsed text. Rows are independent: ids may be null or repeated, other
    columns are ignored, an empty table gives an empty result. A whole text is one row of one task.
    """
    bounded_batches(docs.sparkSession)

    def each(batches):
        for piece in W.passes(batches):
            yield _batch(piece, min_length)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, RUNS)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, chosen by the checksum of the id, gets a periodic tail.

    With h the checksum, g = h // 10 and n words, such a text (h % 10 = 0) repeats from word a = g % n on what stands
    there, with period 1 + (n - a) // (3 + g % 8). Its words are then joined by one space. A row without id stays.
    """
    h, w, i, n = F.crc32(F.col("doc_id").cast("string")), F.col("w"), F.col("i"), F.size("w").cast("long")
    g = F.expr("h div 10")
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("h", h)
        .withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
        .withColumn("a", F.when(n > 0, g % n))
        .withColumn("p", 1 + F.expr("(size(w) - a) div (3 + (h div 10) % 8)"))
    )
    tail = F.expr("array_join(transform(sequence(0, size(w) - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: doc_id, n_runs, the longest run and checksums of the runs and the collapsed text.

    The longest run is the one of greatest length (ties: smallest start, then period); without runs its columns are null.
    """
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
