"""Text quality from random-indexing word vectors and a small network.

Tokens are runs of letters and runs of other marks. Each token falls into one of a fixed number of rows by its hash. A
row has a sparse random index vector; its word vector is the sum of the index vectors of the tokens that stand
near it anywhere in the corpus, all documents counted, plus its own. Documents are the mean of their tokens' vectors,
weighed down for frequent rows, with a few figures of form. A network with one hidden layer, in numpy, is fitted on a
bounded sample of labelled rows; its logits are divided by a temperature that a part of them, kept from fitting, sets.

The table of vectors has a fixed size whatever the corpus, so it is broadcast.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches
from pulsegrid.llm.labelled import TRAIN_ROWS, sample
from pulsegrid.llm.toxicity import sigmoid

ROWS, DIM, NONZERO, NEAR = 1 << 14, 32, 2, 2
SLICES = 16
HIDDEN = 24
HELD_OUT = 2
PREDICTED = 0.7

_SPOTS = (W.mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(77)) % np.uint64(DIM)).astype(np.int32).reshape(ROWS, NONZERO)
_SIGNS = np.where(W.mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(7_777_777)) & np.uint64(1), 1, -1).astype(np.int8).reshape(ROWS, NONZERO)


def tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, row) of every token in order; white space separates tokens and is none."""
    letters = texts.letter_runs()
    marks = texts.runs(~(W._LETTER | W._BLANK)[texts.data])
    starts = np.concatenate([letters.starts, marks.starts])
    value = np.concatenate([letters.hashes(), marks.hashes()])
    owner = np.concatenate([letters.owner, marks.owner])
    order = np.argsort(starts, kind="stable")
    return owner[order], (value[order] >> np.uint64(64 - 14)).astype(np.int32)


def _neighbours(owner: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums of the index vectors near each row, and in the last column how often it comes."""
    out = np.zeros((ROWS, DIM + 1), dtype=np.int64)
    out[:, DIM] = np.bincount(row, minlength=ROWS)
    for step in range(1, NEAR + 1):
        if len(row) <= step:
            break
        same = owner[step:] == owner[:-step]
        left, right = row[:-step][same], row[step:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                at = a.astype(np.int64) * DIM + _SPOTS[b, k]
                out[:, :DIM] += np.bincount(at, weights=_SIGNS[b, k], minlength=ROWS * DIM).astype(np.int64).reshape(ROWS, DIM)
    return out


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x (DIM + 1) sums over all documents of ``docs(text)``; tasks send sums of fixed size, which are added by slice."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros((ROWS, DIM + 1), dtype=np.int64)
        for piece in W.passes(batches):
            total += _neighbours(*tokens(W.Texts(piece.column("text"))))
        if total[:, DIM].any():
            for i, part in enumerate(np.split(total, SLICES)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "sums": pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(zlib.decompress(part), "<i8")
        for i, part in totals.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "sums": pa.array([part.astype("<i8").tobytes()], pa.binary())})

    schema = "slice int, sums binary"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    out = np.zeros((SLICES, ROWS // SLICES * (DIM + 1)), dtype=np.int64)
    for r in texts.mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect():  # SLICES rows of fixed size
        out[r.slice] = np.frombuffer(r.sums, "<i8")
    return out.reshape(ROWS, DIM + 1)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of context plus the row's own index vector, and in the last column its weight in a document."""
    context, times = sums[:, :DIM].astype(float), sums[:, DIM].astype(float)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = np.zeros((ROWS, DIM))
    np.add.at(own, (np.repeat(np.arange(ROWS), NONZERO), _SPOTS.ravel()), _SIGNS.ravel() / NONZERO**0.5)
    vectors = context + own
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = times / max(times.sum(), 1)
    return np.column_stack([vectors, 1e-3 / (1e-3 + share)]).astype(np.float32)


def pooled(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """One row of figures per text: its mean vector (weighed and plain) and some figures of its form."""
    texts = W.Texts(column)
    owner, row = tokens(texts)
    n = texts.n
    count = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(count, 1)
    out = []
    weight = vectors[row, DIM].astype(float)
    total = np.maximum(np.bincount(owner, weights=weight, minlength=n), 1e-9)
    for j in range(DIM):
        value = vectors[row, j]
        out.append(np.bincount(owner, weights=value * weight, minlength=n) / total)
        out.append(np.bincount(owner, weights=value, minlength=n) / some)
    size = np.maximum(np.diff(texts.begin), 1)

    def share(inside: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(inside)])[texts.begin]) / size

    data = texts.data
    both = np.unique(owner.astype(np.int64) * ROWS + row)
    distinct = np.bincount(both // ROWS, minlength=n)
    out += [
        np.log1p(count), distinct / some, np.log1p(size), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(~(W._LETTER | W._BLANK)[data]),
        share(data == 10), share(data == 0x20), (count == 0).astype(float),
    ]
    return np.column_stack(out)


@dataclass
class Network:
    """Figures are centred and scaled, then tanh, then one logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, kept: np.ndarray, steps: int = 1500, batch: int = 256, decay: float = 3e-4) -> Network:
    """Fit on the rows that are not ``kept``, then set the temperature on those that are."""
    rng = np.random.default_rng(10)
    own = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(y))
    share = (y[own].sum() + 0.5) / (len(own) + 1)
    net = Network(
        x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-6), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(share / (1 - share))),
    )
    z, t = np.clip((x - net.mean) / net.scale, -8, 8), y.astype(float)
    names = ("first", "first_bias", "second", "second_bias")
    moments = {k: (np.zeros_like(getattr(net, k), dtype=float), np.zeros_like(getattr(net, k), dtype=float)) for k in names}
    for step in range(1, steps + 1):
        rows = rng.choice(own, min(batch, len(own)), replace=False)
        hidden = np.tanh(z[rows] @ net.first + net.first_bias)
        error = (sigmoid(hidden @ net.second + net.second_bias) - t[rows]) / len(rows)
        back = np.outer(error, net.second) * (1 - hidden**2)
        gradients = {"first": z[rows].T @ back + decay * net.first, "first_bias": back.sum(axis=0), "second": hidden.T @ error + decay * net.second, "second_bias": error.sum()}
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in gradients.items():
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = (m, v)
            setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    if kept.any() and len(np.unique(y[kept])) == 2:
        logits = net.logits(x[kept])
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [-np.mean(np.where(y[kept] == 1, np.log(sigmoid(logits / c) + 1e-12), np.log(1 - sigmoid(logits / c) + 1e-12))) for c in options]
        net.temperature = float(options[int(np.argmin(loss))])
    return net


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def sample_figures(found: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures, label and fold of the sampled rows in the order of their hashes. The texts stay on the executors."""
    shared = found.sparkSession.sparkContext.broadcast(vectors)

    def each(batches):
        for piece in W.passes(batches):
            x = pooled(shared.value, piece.column("text"))
            figures = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([figures, *(piece.column(c) for c in ("label", "fold", "order_"))], names=["figures", "label", "fold", "order_"])

    out = found.mapInArrow(each, "figures binary, label int, fold int, order_ long").collect()  # rows of fixed size
    out.sort(key=lambda r: (r.order_, r.figures))
    x = np.vstack([np.frombuffer(r.figures, "<f8") for r in out]) if out else np.empty((0, 0))
    return x, np.array([r.label for r in out]), np.array([r.fold for r in out])


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs(doc_id, text, ...)``.

    held_out: the CRC-32 of the id as text leaves 2 when divided by 4; labels of such rows are never used. The score is the
    probability of label 1, also of null and empty texts, which are texts without tokens; without any label it is
    0.5. Rows are independent but for the word vectors, so ids may be null (not held out) or repeated. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vectors = word_vectors(corpus_vectors(docs))
    x, label, fold = sample_figures(sample(docs, labels, "quality", rows, remainder() != HELD_OUT), vectors)
    net = train(x, (label > 0).astype(int), fold == 0) if len(x) else None
    shared = spark.sparkContext.broadcast((vectors, net))

    def each(batches):
        vectors, net = shared.value
        for piece in W.passes(batches):
            s = np.full(piece.num_rows, 0.5) if net is None else net.scores(pooled(vectors, piece.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= PREDICTED).astype(np.int32))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
