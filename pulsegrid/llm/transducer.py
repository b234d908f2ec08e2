"""Token counts by a deterministic finite-state transducer compiled from a merge-type vocabulary.

The ids of a prefix of a text are those of a shorter prefix and one token, and two tokens follow each other in some
text exactly if their concatenation encodes to the two. So it is enough to know, while reading characters, the last
token of the prefixes that end where a piece can still begin: that is a finite state. A transition tells the next
state and how many tokens more (or fewer) the longer prefix has; the sum over a text is its number of tokens.
States and transitions are compiled when a text first reaches them, and a worker keeps them.

A text is read in chunks of equal length, all chunks of a batch in step. Where a word begins the state does not
depend on what came before, so a chunk's map from entry state to exit state is constant once a word begins in it:
its part from there on is read first, from the start state. A chunk inside one long word has a map of several entries. It
is read from the start state and from every state in which the chunk before can end, as its own map says, until no new
state turns up; since a state remembers little, that is a round or two, all chunks of all texts at once. The maps are
functions on numbered (chunk, state) pairs, composed along the chunks by doubling, so the pairs that the text really goes
through are found in a logarithmic number of steps.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches
from pulsegrid.llm.pieces import SPACE, Pieces

# characters of a chunk
CHUNK = 512
# transitions that a worker keeps; beyond that it starts anew
KEPT = 1_500_000
# fewer chunks than this are read one by one
FEW = 24
_START = 0


class Transducer:
    """States are numbers; state 0 is the start of a word."""

    def __init__(self, pieces: Pieces, kept: int = KEPT):
        self.pieces, self.kept = pieces, kept
        letters = sorted({c for p in pieces.id for c in p})
        self.letters = letters
        # classes: 0 to 3 for characters outside the vocabulary by their bytes in UTF-8, then the letters
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[0x80:0x800], self.class_of[0x800:0x10000], self.class_of[0x10000:] = 1, 2, 3
        self.class_of[[ord(c) for c in letters]] = np.arange(4, 4 + len(letters))
        self.classes = 4 + len(letters)
        self.space = int(self.class_of[ord(SPACE)])
        self.prefixes = {p[:k] for p in pieces.id for k in range(1, len(p) + 1)}
        self.follows: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[str, tuple[tuple[int, int, int], ...]]] = [("", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, dtype=np.int64)
        self.next, self.more = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.filled = 0
        if self.steps:
            keys = np.fromiter(self.steps, dtype=np.int64, count=len(self.steps))
            values = np.array(list(self.steps.values()), dtype=np.int32)
            self._insert(keys, values[:, 0], values[:, 1])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, following: np.ndarray, more: np.ndarray) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            at = slot[todo]
            free = self.keys[at] == -1
            # of several that want one slot, the last written keeps it
            self.keys[at[free]] = keys[todo[free]]
            got = self.keys[at] == keys[todo]
            won = todo[got]
            self.next[slot[won]], self.more[slot[won]] = following[won], more[won]
            todo = todo[~got]
            slot[todo] = (slot[todo] + 1) % len(self.keys)
        self.filled += len(keys)

    # compiling

    def _may_follow(self, before: int, token: int) -> bool:
        known = self.follows.get((before, token))
        if known is None:
            piece = self.pieces.piece
            if before < 0:
                known = self.pieces.agenda(piece[token]) == [token]
            else:
                known = self.pieces.agenda(piece[before] + piece[token]) == [before, token]
            if len(self.follows) > 4 * self.kept:
                self.follows.clear()
            self.follows[before, token] = known
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """(next state, tokens more) of a transition."""
        state, kind = divmod(key, self.classes)
        if kind < 4:
            return _START, kind + 1
        read, open_at = self.states[state]
        letter = self.letters[kind - 4]
        for length, before, behind in open_at:  # longest first
            token = self.pieces.id.get(read[len(read) - length :] + letter)
            if token is not None and self._may_follow(before, token):
                break
        else:
            raise AssertionError(f"no token ends {read + letter!r}")
        more = behind + 1
        longer = read + letter
        longest = next((longer[k:] for k in range(len(longer)) if longer[k:] in self.prefixes), "")
        kept = []
        for length, before, behind in open_at:
            if length < len(longest) and longest[len(longest) - length - 1 :] in self.prefixes:
                kept.append((length + 1, before, behind - more))
        kept.append((0, token, 0))
        new = (longest, tuple(kept))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, more

    def step(self, state: int, kind: int) -> tuple[int, int]:
        key = state * self.classes + kind
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._compile(key)
        return found

    def steps_of(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and tokens more, for many at once."""
        key = states * self.classes + kinds
        slot = self._slot(key)
        rest = np.flatnonzero(self.keys[slot] != key)
        while rest.size:
            held = self.keys[slot[rest]]
            new = rest[held == -1]
            if new.size:
                keys = np.unique(key[new])
                values = np.empty((len(keys), 2), dtype=np.int32)
                for i, k in enumerate(keys.tolist()):
                    found = self.steps.get(k)
                    if found is None:
                        found = self.steps[k] = self._compile(k)
                    values[i] = found
                if 2 * len(self.steps) > len(self.keys):
                    self._table(4 * len(self.keys))
                else:
                    self._insert(keys, values[:, 0], values[:, 1])
                slot = self._slot(key)
                rest = np.flatnonzero(self.keys[slot] != key)
                continue
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            rest = rest[self.keys[slot[rest]] != key[rest]]
        return self.next[slot], self.more[slot]

    # reading

    def _read(self, kinds: np.ndarray, reset: np.ndarray, more: np.ndarray, states: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Read ``kinds[begin:end]`` of every lane from its state, in step; fills ``more``, returns the exit states."""
        states = states.astype(np.int64)
        if len(states) < FEW:
            for lane in range(len(states)):
                state = int(states[lane])
                a, b = int(begin[lane]), int(end[lane])
                for p, kind, anew in zip(range(a, b), kinds[a:b].tolist(), reset[a:b].tolist(), strict=True):
                    state, more[p] = self.step(_START if anew else state, kind)
                states[lane] = state
            return states
        order = np.argsort(begin - end, kind="stable")  # the longest first
        lengths = (end - begin)[order]
        going = states[order]
        for t in range(int(lengths[0]) if len(lengths) else 0):
            lanes = int(np.searchsorted(-lengths, -t, "left"))
            place = begin[order[:lanes]] + t
            from_states = np.where(reset[place], _START, going[:lanes])
            going[:lanes], more[place] = self.steps_of(from_states, kinds[place])
        states[order] = going
        return states

    def count(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each text; text i is the code points ``first[i]:first[i + 1]``, spaces replaced and one in front."""
        if len(self.steps) > self.kept:
            self._clear()
        n = len(points)
        if not n:
            return np.zeros(len(first) - 1, dtype=np.int64)
        kinds = self.class_of[points]
        reset = kinds == self.space
        reset[1:] &= kinds[:-1] != self.space
        reset[first[:-1][np.diff(first) > 0]] = True
        more = np.zeros(n, dtype=np.int32)
        begin = np.arange(0, n, CHUNK)
        end = np.minimum(begin + CHUNK, n)
        places = np.flatnonzero(reset)
        at = np.searchsorted(places, begin)
        head = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], n)
        head = np.minimum(head, end)
        constant = head < end
        exits = np.full(len(begin), -1, dtype=np.int64)
        exits[constant] = self._read(kinds, reset, more, np.zeros(int(constant.sum()), np.int64), head[constant], end[constant])
        inside = np.flatnonzero(~constant & (begin > 0) & (head > begin))
        extra = np.zeros(len(begin), dtype=np.int64)
        if inside.size:
            exits[inside], extra[inside] = self._scan(kinds, reset, begin, end, exits, inside)
        # the heads of the others, whose entry is known now
        rest = np.flatnonzero(constant & (head > begin))
        self._read(kinds, reset, more, exits[rest - 1], begin[rest], head[rest])
        total = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
        # a chunk inside one word belongs to one text
        owner = np.searchsorted(first, begin[inside], "right") - 1
        return np.diff(total[first]) + np.bincount(owner, weights=extra[inside], minlength=len(first) - 1).astype(np.int64)

    def _scan(self, kinds: np.ndarray, reset: np.ndarray, begin: np.ndarray, end: np.ndarray, exits: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of the chunks ``inside`` a word, entered as the chunks before them end; ``exits`` of those outside are known."""
        open_ = np.zeros(len(begin), dtype=bool)
        open_[inside] = True
        leads = ~open_[inside - 1]
        # numbered pairs of a chunk and an entry state: what they lead to, and the pair that follows
        number: dict[tuple[int, int], int] = {}
        chunk, exit_, tokens = (np.empty(0, dtype=np.int64) for _ in range(3))
        todo_chunk, todo_state = inside, np.where(leads, exits[inside - 1], _START)
        while todo_chunk.size:
            new = len(number)
            number.update(zip(zip(todo_chunk.tolist(), todo_state.tolist(), strict=True), range(new, new + len(todo_chunk)), strict=True))
            out, count = self._lanes(kinds, reset, begin[todo_chunk], end[todo_chunk], todo_state)
            chunk, exit_, tokens = np.append(chunk, todo_chunk), np.append(exit_, out), np.append(tokens, count)
            following = np.flatnonzero(open_[np.minimum(todo_chunk + 1, len(begin) - 1)] & (todo_chunk + 1 < len(begin)))
            pairs = {(c, s) for c, s in zip((todo_chunk[following] + 1).tolist(), out[following].tolist(), strict=True)} - number.keys()
            fresh = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
            todo_chunk, todo_state = fresh[:, 0], fresh[:, 1]
        jump = np.array([number.get(pair, -1) for pair in zip((chunk + 1).tolist(), exit_.tolist(), strict=True)], dtype=np.int64)
        # where the text enters each run of chunks, and the pairs 1, 2, 4, ... chunks on
        starts = inside[leads]
        at = np.array([number[c, s] for c, s in zip(starts.tolist(), exits[starts - 1].tolist(), strict=True)], dtype=np.int64)
        lengths = np.diff(np.append(np.flatnonzero(leads), len(inside)))
        place = W.ragged(np.zeros(len(starts), dtype=np.int64), lengths)
        node = np.repeat(at, lengths)
        for k in range(int(place.max()).bit_length()):
            far = (place >> k) & 1 == 1
            node[far] = jump[node[far]]
            jump = np.where(jump >= 0, jump[jump], -1)
        return exit_[node], tokens[node]

    def _lanes(self, kinds: np.ndarray, reset: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of chunks that may be the same for several entry states."""
        lengths = end - begin
        upto = np.cumsum(lengths)
        copied = W.ragged(begin, lengths)
        more = np.zeros(len(copied), dtype=np.int32)
        out = self._read(kinds[copied], reset[copied], more, states, upto - lengths, upto)
        return out, np.add.reduceat(more.astype(np.int64), upto - lengths)


def count_texts(transducer: Transducer, column: pa.Array) -> np.ndarray:
    """Tokens of every text of an Arrow column (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    texts = [(" " + t).replace(" ", SPACE) if t else "" for t in column.to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return transducer.count(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), first)


@functools.lru_cache(maxsize=1)
def compiled(path: str) -> Transducer:
    """This worker's transducer for the model at ``path``."""
    return Transducer(Pieces(path))


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty, and an empty text has no tokens. Rows are independent, so ids may be null or
    repeated. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def each(batches):
        transducer = compiled(model)
        for piece in W.passes(batches):
            n = count_texts(transducer, piece.column("text"))
            size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
