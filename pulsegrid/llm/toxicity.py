"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: insult, degradation, disgust, then toxic as a whole. Each model is linear
in the words and word beginnings of a document and in the probabilities of the categories before it. So that a model
learns from the probabilities as they will be, not as they look on rows already seen, those of the training
rows are predicted by models that were fitted without the row's fold. The labels tell toxic or not, so the categories are
weak labels of their own: a toxic row has a category where it has one of the category's markers. Markers are the listed
words and, since those are of one language, the features that stand out in the toxic rows, dealt to the categories by the
rows they come in. Where no listed word comes, the categories are groups of markers without a meaning of their own.

Fitting sees a bounded sample of labelled rows. Their texts and features stay on the executors, which count the features by
label and fold; the driver gets the counts, of fixed size, and of each row the few features that models choose. Scoring is one pass over the documents with a table of
fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store
from pulsegrid.llm.labelled import TRAIN_ROWS, sample

# Words that markers of the weak categories start from.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser", "dumb", "fool", "imbecile", "jerk"),
    "degradation": ("scum", "trash", "worthless", "garbage", "vermin", "filth", "useless"),
    "disgust": ("disgusting", "pathetic", "revolting", "vile", "gross", "hideous"),
}
NAMES = (*CATEGORIES, "toxic")
BITS = 20
# features of one model, those that tell most
FEATURES = 2048
FOLDS = 4
THRESHOLD = 0.3
# a marker comes so often in toxic rows, as many times as often as in others, and stands out so far from its spread
LEAST_HITS, LIFT, STANDS_OUT = 3, 4, 3.0
# markers that share so much of their toxic rows are one
SAME_ROWS = 0.8
_BEGINNINGS = (4, 5, 6, 7)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every letter run and its beginnings, lower-cased in A-Z; features are numbers below 2^BITS."""
    texts = W.Texts(column)
    runs = texts.letter_runs()
    data = texts.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    whole = W.hash_spans(data, runs.starts, runs.ends)
    owners, values = [runs.owner], [whole]
    longest = max(_BEGINNINGS)
    long = np.flatnonzero(runs.ends - runs.starts > min(_BEGINNINGS))
    length = (runs.ends - runs.starts)[long]
    place = np.minimum(runs.starts[long, None] + np.arange(longest), max(len(data) - 1, 0))
    sums = np.cumsum(W.byte_values(data[place], np.arange(longest)), axis=1)
    for k in _BEGINNINGS:
        has = length > k
        owners.append(runs.owner[long[has]])
        values.append(W.mix(sums[has, k - 1] + np.uint64(k)))
    return np.concatenate(owners), (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int32)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner.astype(np.int64) << BITS | feature)
    return both >> BITS, (both & (1 << BITS) - 1).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Weights of chosen features, of earlier probabilities, and a bias."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _strength(with_it: np.ndarray, hits: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """Log odds by their spread; ``with_it`` texts have a feature, ``hits`` of them positive."""
    other = with_it - hits
    odds = np.log((hits + 0.5) / (positive + 1)) - np.log((other + 0.5) / (rows - positive + 1))
    return odds / np.sqrt(1 / (hits + 0.5) + 1 / (other + 0.5))


def select(with_it: np.ndarray, hits: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """The features whose log odds stand out most from their spread; ``with_it`` texts have one, ``hits`` of them positive."""
    some = np.flatnonzero(with_it >= 2)
    strength = np.abs(_strength(with_it[some], hits[some], rows, positive))
    top = np.argsort(-strength, kind="stable")[:FEATURES]
    return np.sort(some[top[strength[top] > 1.5]]).astype(np.int32)


def listed() -> list[np.ndarray]:
    """The features of the listed words of each category."""
    return [np.unique(features(pa.array([" ".join(words)]))[1][: len(words)]) for words in CATEGORIES.values()]


def standing_out(with_it: np.ndarray, hits: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """The features that may be markers; ``hits`` of the ``with_it`` texts that have one are toxic."""
    some = np.flatnonzero((hits >= LEAST_HITS) & ((hits + 0.5) / (positive + 1) > LIFT * (with_it - hits + 0.5) / (rows - positive + 1)))
    strength = _strength(with_it[some], hits[some], rows, positive)
    top = np.argsort(-strength, kind="stable")[:FEATURES]
    return np.sort(some[top[strength[top] > STANDS_OUT]]).astype(np.int32)


def markers(owner: np.ndarray, feature: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
    """The features that mark each category, from the distinct (owner, feature) of the toxic rows and those standing out.

    Listed words mark their own category. The other features that stand out are dealt in turn: a category with the
    fewest rows takes the one that comes in most toxic rows it has not, and with it those of almost the same rows. So
    every category reaches the rows of every language that have markers, and no feature marks two.
    """
    words = listed()
    ids, at = np.unique(owner, return_inverse=True)
    inside = np.isin(feature, found)
    has = np.zeros((len(found), len(ids)), dtype=np.float32)
    has[np.searchsorted(found, feature[inside]), at[inside]] = 1
    times = has.sum(axis=1)
    category = np.full(len(found), -1)
    covered = np.zeros((len(words), len(ids)), dtype=bool)

    def take(j: int, own: np.ndarray) -> None:
        for m in own:
            common = has @ has[m]
            near = common >= SAME_ROWS * (times + times[m] - common)
            category[near & (category < 0)] = j
        category[own] = j
        covered[j] |= has[category == j].any(axis=0)

    for j, own in enumerate(words):
        covered[j, at[np.isin(feature, own)]] = True
    for j, own in enumerate(words):
        take(j, np.flatnonzero(np.isin(found, own)))
    open_ = set(range(len(words)))
    while open_:
        j = min(open_, key=lambda c: (covered[c].sum(), c))
        gain = np.where(category < 0, has @ (~covered[j]).astype(np.float32), 0)
        if not len(gain) or gain.max() < 2:
            open_.remove(j)
        else:
            take(j, np.array([int(np.argmax(gain))]))
    return [np.union1d(own, found[category == j]) for j, own in enumerate(words)]


def fit(owner: np.ndarray, feature: np.ndarray, chosen: np.ndarray, earlier: np.ndarray, label: np.ndarray, rows: np.ndarray, steps: int = 100, decay: float = 2e-3) -> Linear:
    """A logistic model of the given rows in the chosen features, by gradient steps with adapted lengths."""
    n = len(label)
    positive = float(label[rows].sum())
    if positive in (0.0, float(len(rows))):  # one class only: its share, smoothed
        share = (positive + 0.5) / (len(rows) + 1)
        return Linear(np.empty(0, np.int32), np.empty(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    order = np.full(n, -1, dtype=np.int32)
    order[rows] = np.arange(len(rows))
    inside = (column[feature] >= 0) & (order[owner] >= 0)
    owner, at = order[owner[inside]], column[feature[inside]]
    y, e = label[rows].astype(float), earlier[rows]
    w, v, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), float(np.log(positive / (len(rows) - positive)))
    scale_w, scale_v, scale_b = np.full(len(chosen), 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, weights=w[at], minlength=len(rows)) + e @ v + b
        error = (sigmoid(z) - y) / len(rows)
        gw = np.bincount(at, weights=error[owner], minlength=len(chosen)) + decay / len(rows) * w
        gv, gb = e.T @ error + decay * v / len(rows), float(error.sum())
        scale_w, scale_v, scale_b = scale_w + gw * gw, scale_v + gv * gv, scale_b + gb * gb
        w, v, b = w - 0.3 * gw / np.sqrt(scale_w), v - 0.3 * gv / np.sqrt(scale_v), b - 0.3 * gb / np.sqrt(scale_b)
    return Linear(chosen, w, v, b)


def predict(model: Linear, owner: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model.chosen] = model.weights
    return sigmoid(np.bincount(owner, weights=table[feature], minlength=len(earlier)) + earlier @ model.earlier + model.bias)


@dataclass
class Chain:
    """What scoring needs: one row of weights per feature that any model uses."""

    used: np.ndarray
    weights: np.ndarray
    models: list[Linear]

    @classmethod
    def of(cls, models: list[Linear]) -> Chain:
        used = np.unique(np.concatenate([m.chosen for m in models])).astype(np.int32)
        weights = np.zeros((len(used), len(models)))
        for j, m in enumerate(models):
            weights[np.searchsorted(used, m.chosen), j] = m.weights
        return cls(used, weights, models)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """One column per category."""
        owner, feature = features(column)
        n = len(column)
        known = np.zeros(1 << BITS, dtype=bool)
        known[self.used] = True
        inside = known[feature]
        owner, feature = _distinct(owner[inside], feature[inside])
        row = np.searchsorted(self.used, feature)
        out = np.zeros((n, len(self.models)))
        for j, m in enumerate(self.models):
            z = np.bincount(owner, weights=self.weights[row, j], minlength=n) if len(owner) else np.zeros(n)
            out[:, j] = sigmoid(z + out[:, :j] @ m.earlier + m.bias)
        return out


def _count(parts: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Rows with each feature, by label and fold; parts are distinct (row, feature)."""
    out = np.zeros((len(labels), FOLDS, 1 << BITS), dtype=np.int32)
    for owner, feature in parts:
        for j, label in enumerate(labels):
            marked = label[owner] > 0
            np.add.at(out[j].reshape(-1), fold[owner[marked]].astype(np.int64) << BITS | feature[marked], 1)
    return out


def _pick(parts: Iterable[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each part the given features of the given rows."""
    known = np.zeros(1 << BITS, dtype=bool)
    known[wanted] = True
    for owner, feature in parts:
        inside = known[feature] & rows[owner]
        yield owner[inside], feature[inside]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, feature = (np.concatenate([np.empty(0, np.int32), *x]) for x in (list(zip(*parts, strict=True)) or [(), ()]))
    return own, feature


class Held:
    """Features of rows in memory."""

    def __init__(self, column: pa.Array, fold: np.ndarray, docs: int):
        self.fold, self.parts = fold, []
        for begin in range(0, len(column), docs):
            owner, feature = _distinct(*features(column.slice(begin, docs)))
            self.parts.append(((owner + begin).astype(np.int32), feature))

    def count(self, labels: np.ndarray) -> np.ndarray:
        return _count(self.parts, labels, self.fold)

    def pick(self, wanted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _joined(list(_pick(self.parts, wanted, rows)))


class Stored:
    """Features of sampled rows in a table; rows are numbered by the hash of their id."""

    def __init__(self, found: DataFrame):
        def each(batches):
            for piece in W.passes(batches):
                owner, feature = _distinct(*features(piece.column("text")))
                cuts = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                own = pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("row_", "order_", "label", "fold")), own], names=["row_", "order_", "label", "fold", "features"])

        rows = found.withColumn("row_", F.monotonically_increasing_id())
        self.rows = store(rows.mapInArrow(each, "row_ long, order_ long, label int, fold int, features binary"), "toxicity-rows")
        known = sorted((r.order_, r.row_, r.label, r.fold) for r in self.rows.drop("features").collect())  # four numbers a row
        _, row, label, fold = (np.array(x, dtype=np.int64) for x in (zip(*known, strict=True) if known else ((),) * 4))
        self.label, self.fold, self.number = label, fold, np.argsort(row)
        self.row = row[self.number]

    def _parts(self):
        row, number = self.row, self.number

        def parts(batches):
            for batch in batches:
                own = [np.frombuffer(x, "<i4") for x in batch.column("features").to_pylist()]
                at = number[np.searchsorted(row, batch.column("row_").to_numpy())]
                if own:
                    yield np.repeat(at, [len(x) for x in own]), np.concatenate(own)

        return parts

    def count(self, labels: np.ndarray) -> np.ndarray:
        parts, fold, schema = self._parts(), self.fold, "slice int, counts binary"

        def pack(i: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(x.astype("<i4").tobytes(), 1)], pa.binary())})

        def count(batches):
            for i, x in enumerate(_count(parts(batches), labels, fold).reshape(-1, 1 << BITS)):
                if x.any():
                    yield pack(i, x)

        def add(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, x in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    totals[i] = totals.get(i, 0) + np.frombuffer(zlib.decompress(x), "<i4")
            for i, x in totals.items():
                yield pack(i, x)

        slices = len(labels) * FOLDS
        out = np.zeros((slices, 1 << BITS), dtype=np.int32)
        added = self.rows.select("row_", "features").mapInArrow(count, schema).repartition(slices, "slice").mapInArrow(add, schema)
        for r in added.collect():  # at most one row of fixed size for each label and fold
            out[r.slice] = np.frombuffer(zlib.decompress(r.counts), "<i4")
        return out.reshape(len(labels), FOLDS, 1 << BITS)

    def pick(self, wanted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = self._parts()

        def each(batches):
            for owner, feature in _pick(parts(batches), wanted, rows):
                yield pa.RecordBatch.from_pydict({"owners": pa.array([owner.astype("<i4").tobytes()], pa.binary()), "features": pa.array([feature.tobytes()], pa.binary())})

        found = self.rows.select("row_", "features").mapInArrow(each, "owners binary, features binary").collect()
        owner, feature = _joined([(np.frombuffer(r.owners, "<i4"), np.frombuffer(r.features, "<i4")) for r in found])
        order = np.lexsort((feature, owner))
        return owner[order], feature[order]


def train(column: pa.Array, toxic: np.ndarray, fold: np.ndarray, docs: int = 64) -> Chain:
    """Fit the chain on labelled texts, whose features are taken a few texts at a time."""
    return _train(Held(column, fold, docs), toxic, fold)


def _train(sampled: Held | Stored, toxic: np.ndarray, fold: np.ndarray) -> Chain:
    n = len(toxic)
    labels = np.zeros((len(NAMES), n), dtype=np.int8)
    labels[-1] = toxic > 0
    # by fold: texts with a feature, and of those the ones with each label
    all_with, bad = sampled.count(np.vstack([np.ones(n, np.int8), labels[-1]]))
    found = standing_out(all_with.sum(axis=0), bad.sum(axis=0), n, int(labels[-1].sum()))
    owner, feature = sampled.pick(np.concatenate([found, *listed()]).astype(np.int64), labels[-1] > 0)
    for j, own in enumerate(markers(owner, feature, found)):
        labels[j, owner[np.isin(feature, own)]] = 1
    hits = [*sampled.count(labels[:-1]), bad]
    # a model without fold k is fitted on the others; the last is fitted on all
    left_out = [*range(FOLDS), None]
    rows_of = {k: np.flatnonzero(fold != k) if k is not None else np.arange(n) for k in left_out}
    chosen = {}
    for j in range(len(NAMES)):
        for k in left_out:
            others = [f for f in range(FOLDS) if f != k]
            chosen[j, k] = select(all_with[others].sum(axis=0), hits[j][others].sum(axis=0), len(rows_of[k]), float(labels[j, rows_of[k]].sum()))
    del all_with, hits, bad
    owner, feature = sampled.pick(np.unique(np.concatenate(list(chosen.values()))).astype(np.int64), np.ones(n, dtype=bool))

    models, earlier = [], np.zeros((n, 0))
    for j, label in enumerate(labels):
        models.append(fit(owner, feature, chosen[j, None], earlier, label, rows_of[None]))
        outside = np.zeros(n)
        for k in range(FOLDS):
            left = np.flatnonzero(fold == k)
            if len(left):
                part = fit(owner, feature, chosen[j, k], earlier, label, rows_of[k]) if len(rows_of[k]) else models[-1]
                outside[left] = predict(part, owner, feature, earlier)[left]
        earlier = np.column_stack([earlier, outside])
    return Chain.of(models)


def fit_chain(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain | None:
    """The chain fitted on at most ``rows`` labelled documents; none if no document is labelled."""
    bounded_batches(docs.sparkSession)
    sampled = Stored(sample(docs, labels, "toxic", rows))
    return _train(sampled, sampled.label, sampled.fold) if len(sampled.label) else None


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability per category and toxic (true from ``threshold`` on) of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has the probabilities of a text without words and is never toxic; without a chain all
    probabilities are 0. Rows are independent, so ids may be null or repeated. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def each(batches):
        for piece in W.passes(batches):
            p = _probabilities(shared.value, piece.column("text"))
            empty = W.Texts(piece.column("text")).letter_runs().per_text == 0
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), **{f"p_{name}": pa.array(p[:, j]) for j, name in enumerate(NAMES)}, "toxic": pa.array((p[:, -1] >= threshold) & ~empty)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, " + ", ".join(f"p_{name} double" for name in NAMES) + ", toxic boolean")


def _probabilities(chain: Chain | None, column: pa.Array) -> np.ndarray:
    return np.zeros((len(column), len(NAMES))) if chain is None else chain.probabilities(column)


def without_toxic(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs(text, ...)`` that are not toxic, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def each(batches):
        for piece in W.passes(batches):
            toxic = _probabilities(shared.value, piece.column("text"))[:, -1] >= threshold
            empty = W.Texts(piece.column("text")).letter_runs().per_text == 0
            yield piece.filter(pa.array(~toxic | empty))

    return docs.mapInArrow(each, docs.schema)
