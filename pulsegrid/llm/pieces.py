"""Encoding and decoding with a merge-type piece vocabulary, by an agenda of adjacent symbol pairs.

A text gets a space in front, spaces become U+2581, and each character is a symbol. Of all adjacent pairs whose
concatenation is a piece, the one with the highest score (the leftmost of equals) becomes one symbol, until none is
left; symbols that are no pieces fall back to the pieces of their bytes. No piece has U+2581 after another
character, so no pair reaches across the start of a word: words are encoded apart, each distinct one once.

Short words go through the agenda together, in a matrix of symbols with one merge per word and round; a long one
has a heap. Every distinct word is checked against the library, in the Arrow batch that brings it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.chunks import Chunks, Memo
from pulsegrid.llm.common import bounded_batches

SPACE = "▁"
# characters of a word that goes through the matrix; the matrix has rows of so many symbols
SHORT = 24
_NONE = -1


class Pieces:
    """A vocabulary read from a model file, with its pair table."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.piece = [library.id_to_piece(i) for i in range(n)]
        plain = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if plain[i]}
        self.byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(library.is_byte(i) for i in self.byte):
            raise ValueError("the vocabulary has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches across the start of a word")
        score = {i: library.get_score(i) for i in self.id.values()}
        # rank: 0 for the highest score, equal for equal scores
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {i: ranks[s] for i, s in score.items()}
        # symbols of the matrix: pieces have their id, other characters numbers from n on, which no pair has
        self.n = n
        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if (left := self.id.get(p[:k])) is not None and (right := self.id.get(p[k:])) is not None:
                    self.pairs[left, right] = i
        # a pair can also be made of a character that is no piece, if its concatenation is one
        self.loose = any(c not in self.id for p in self.id for c in p)
        keys = np.array([a * n + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        merged = np.array(list(self.pairs.values()), dtype=np.int32)[order]
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(merged, _NONE)
        self.rank_of = np.full(n + 1, np.iinfo(np.int32).max, dtype=np.int32)
        for i, r in self.rank.items():
            self.rank_of[i] = r
        self.text = [self._decoded(i) for i in range(n)]

    def _decoded(self, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(self.piece[i][3:5], 16)])
        if self.library.is_control(i):
            return b""
        return self.piece[i].replace(SPACE, " ").encode() if not self.library.is_unknown(i) else " ⁇ ".encode()

    # one word, by a heap

    def agenda(self, word: str) -> list[int]:
        """Ids of one word (with U+2581 for spaces)."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (found := self.id.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (self.rank[found], i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                found = self.id.get(s)
                out += [found] if found is not None else [self.byte[b] for b in s.encode()]
        return out

    # many short words at once

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, or the none piece n."""
        key = np.where((left < self.n) & (right < self.n) & (left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], self.n).astype(np.int32)

    def agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many of each; words of at most SHORT characters."""
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        seen, which = np.unique(points, return_inverse=True)
        names = [chr(c) for c in seen]
        numbers = np.array([self.id.get(c, self.n + k) for k, c in enumerate(names)], dtype=np.int32)
        row = np.repeat(np.arange(len(words)), lengths)
        column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        width = int(lengths.max())
        symbol = np.full((len(words), width), _NONE, dtype=np.int32)
        symbol[row, column] = numbers[which]
        left = symbol.copy()
        size = lengths.copy()
        found = np.full((len(words), max(width - 1, 1)), self.n, dtype=np.int32)
        if width > 1:
            found[:] = self._lookup(left[:, :-1].ravel(), left[:, 1:].ravel()).reshape(len(words), -1)
        rank = self.rank_of[found]
        none = np.iinfo(np.int32).max
        live = np.arange(len(words))
        while live.size:
            best = rank[live].argmin(axis=1)
            going = rank[live, best] < none
            live, best = live[going], best[going]
            if not live.size:
                break
            # the merged symbol stands at best, all symbols behind move one place to the left
            rows = left[live]
            rows[np.arange(len(live)), best] = found[live, best]
            places = np.arange(width)
            behind = places[None, :] > best[:, None]
            shifted = np.concatenate([rows[:, 1:], np.full((len(live), 1), _NONE, dtype=np.int32)], axis=1)
            rows = np.where(behind, shifted, rows)
            left[live] = rows
            size[live] -= 1
            f, r = found[live], rank[live]
            pad = np.full((len(live), 1), self.n, dtype=np.int32)
            f = np.where(behind[:, :-1], np.concatenate([f[:, 1:], pad], axis=1), f)
            r = np.where(behind[:, :-1], np.concatenate([r[:, 1:], np.full((len(live), 1), none, dtype=np.int32)], axis=1), r)
            at = np.arange(len(live))
            for offset in (-1, 0):
                place = best + offset
                ok = (place >= 0) & (place < width - 1)
                k, p = at[ok], place[ok]
                piece = self._lookup(rows[k, p], rows[k, p + 1])
                f[k, p], r[k, p] = piece, self.rank_of[piece]
            found[live], rank[live] = f, r
        out = left[np.arange(width)[None, :] < size[:, None]]
        owner = np.repeat(np.arange(len(words)), size)
        if (odd := np.flatnonzero(out >= self.n)).size:  # characters that are no pieces become bytes
            spelled = [[self.byte[b] for b in names[out[k] - self.n].encode()] for k in odd]
            count = np.ones(len(out), dtype=np.int64)
            count[odd] = [len(s) for s in spelled]
            wide = np.repeat(out, count)
            begin = np.cumsum(count) - count
            for k, s in zip(odd, spelled, strict=True):
                wide[begin[k] : begin[k] + len(s)] = s
            out, owner = wide, np.repeat(owner, count)
        return out, np.bincount(owner, minlength=len(words))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of any length."""
        short = np.array([len(w) <= SHORT and not self.loose for w in words], dtype=bool)
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[np.ndarray] = [np.empty(0, np.int32)] * len(words) if not short.all() else []
        ids = np.empty(0, dtype=np.int32)
        if short.any():
            ids, counts[short] = self.agendas([w for w, s in zip(words, short, strict=True) if s])
        if short.all():
            return ids, counts
        cut = np.concatenate([[0], np.cumsum(counts[short])])
        for k, i in enumerate(np.flatnonzero(short)):
            parts[i] = ids[cut[k] : cut[k + 1]]
        for i in np.flatnonzero(~short):
            parts[i] = np.array(self.agenda(words[i]), dtype=np.int32)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The text of some ids, without the step that drops the first space: runs of byte pieces are read as UTF-8."""
        return b"".join([self.text[i] for i in ids])


def chunks_of(column: pa.Array) -> Chunks:
    """Words with the spaces in front of them, of texts that have got their leading space."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, SPACE, " ")
    column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
    texts = W.Texts(column)
    before = np.zeros(len(texts.data), dtype=bool)
    before[1:] = (texts.data[1:] == 0x20) & (texts.data[:-1] != 0x20)
    return Chunks(texts, before)


@functools.lru_cache(maxsize=1)
def memo(path: str) -> tuple[Memo, Pieces]:
    """This worker's table of words and their ids, each checked against the library when it is new.

    The values of a word are one flag (1: decoding its ids gives the word back) and its ids.
    """
    pieces = Pieces(path)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c.decode().replace(" ", SPACE) for c in chunks]
        ids, counts = pieces.encode_words(words)
        cut = np.concatenate([[0], np.cumsum(counts)])
        # the library puts a space in front itself
        plain = [c[1:].decode() if c[:1] == b" " else None for c in chunks]
        told = iter(pieces.library.encode([p for p in plain if p], num_threads=1))
        out, total = [], np.empty(len(chunks), dtype=np.int32)
        flat = ids.tolist()
        for k, (chunk, p) in enumerate(zip(chunks, plain, strict=True)):
            own = flat[cut[k] : cut[k + 1]]
            if p and own != (told_ids := next(told)):
                raise AssertionError(f"the agenda gives {own} and the library {told_ids} for {p!r}")
            out.append(int(pieces.decode_bytes(own) == chunk))
            out += own
            total[k] = len(own) + 1
        return np.array(out, dtype=np.int32), total

    return Memo(encode), pieces


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs(doc_id, text, ...)``.

    A null text is empty, and an empty text has no ids and decodes to the empty text. Rows are independent, so ids
    may be null or repeated. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def each(batches):
        table, pieces = memo(model)
        decimal = [str(i).encode() for i in range(pieces.n)]
        for piece in W.passes(batches, limit=1 << 20):
            chunks = chunks_of(piece.column("text"))
            entries = table.of(chunks)
            start, count = table.start[entries], table.count[entries].astype(np.int64)
            back = table.values[start] == 1
            ids = table.values[W.ragged(start + 1, count - 1)].tolist()
            cut = np.concatenate([[0], np.cumsum(count - 1)])[chunks.first].tolist()
            data, begin = chunks.texts.data, chunks.texts.begin.tolist()
            n, ids_sha, text_sha = [], [], []
            for i in range(piece.num_rows):
                own = ids[cut[i] : cut[i + 1]]
                n.append(len(own))
                ids_sha.append(hashlib.sha256(b",".join([decimal[k] for k in own])).hexdigest())
                if back[chunks.first[i] : chunks.first[i + 1]].all():  # every word decodes to itself
                    decoded = data[begin[i] : begin[i + 1]].tobytes()
                else:
                    decoded = pieces.decode_bytes(own)
                    decoded = decoded.decode(errors="replace").encode()
                text_sha.append(hashlib.sha256(decoded[1:] if decoded[:1] == b" " else decoded).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
