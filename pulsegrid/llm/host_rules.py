"""Quality rules per document and per host.

The rules of a document are computed from its whole text. A host's share of failed documents is shrunk towards
what hosts have in general: the shares of all hosts with at least ``MIN_DOCS`` documents give the mean and spread of a
beta distribution (by moments), and a host with f failures of n has the posterior mean (f + a) / (n + a + b). A host
of few documents stays near the mean of all, so it is not condemned for two bad pages. Documents of a host whose
shrunken rate is above ``MAX_RATE`` are dropped whatever they are themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import words as W
from pulsegrid.llm.common import bounded_batches, store
from pulsegrid.operators.joins import checked_broadcast

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MIN_DOCS = 5
MAX_RATE = 0.5

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated_words(words: W.Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window which the text has twice or more."""
    out = np.zeros(words.texts.n, dtype=np.int64)
    value, owner, at = W.windows(words, hashes, WINDOW)
    if not len(value):
        return out
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(v), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order[twice]]
    # covered words, by the starts and ends of the windows
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.owner[inside], minlength=words.texts.n).astype(np.int64)


def _repeated_lines(words: W.Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    texts = words.texts
    out = np.zeros(texts.n, dtype=np.int64)
    if not len(words.starts):
        return out
    data = texts.data
    starts = np.union1d(texts.begin[:-1][np.diff(texts.begin) > 0], np.flatnonzero(data[:-1] == 10) + 1)
    starts = starts[starts < len(data)]
    owner = np.searchsorted(texts.begin, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    # without the line's end
    ends = ends - ((data[ends - 1] == 10) & (ends > starts)).astype(np.int64)
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    # the hash of a segment includes its line's end, the last line of a text may have none
    sums = W.hash_segments(np.where(data == 10, 0, data).astype(np.uint8), starts, _LINE_TABLE)
    with np.errstate(over="ignore"):
        value = W.mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value, owner = value[full], owner[full]
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    again = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=texts.n).astype(np.int64)


# byte 0 also stands for a line's end here and weighs nothing; lengths tell lines with zero bytes apart
_LINE_TABLE = W.mix(np.arange(1, 257, dtype=np.uint64))
_LINE_TABLE[0] = 0


def _rules(batches):
    for piece in W.passes(batches):
        texts = W.Texts(piece.column("text"))
        words = texts.words()
        hashes = words.hashes()
        points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        inside = points[words.ends] - points[words.starts]
        chars = np.concatenate([[0], np.cumsum(inside)])[words.first]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[texts.data])])[texts.begin]
        repeated = _repeated_words(words, hashes)
        n = words.per_text
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id"), "host": piece.column("host"), "n_words": pa.array(n, pa.int64()), "word_chars": pa.array(np.diff(chars), pa.int64()),
            "n_symbols": pa.array(np.diff(symbols), pa.int64()), "n_dup_lines": pa.array(_repeated_lines(words), pa.int64()),
            "n_repeat_words": pa.array(repeated, pa.int64()), "base_failed": pa.array(failed),
        })


RULES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def document_rules(docs: DataFrame, host: str) -> DataFrame:
    """The rules of every row of ``docs(doc_id, text, <host>, ...)``; a null text has no words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rules, RULES)


def host_rates(rules: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """host, docs, failed, rate of every known host: the share of failed documents, shrunk by an empirical beta prior.

    With fewer than two hosts of ``min_docs`` documents, or without any spread between them, the prior is the overall
    share with the weight of ``min_docs`` documents.
    """
    hosts = rules.where("host is not null").groupBy("host").agg(F.count("*").alias("docs"), F.count_if("base_failed").alias("failed"))
    share = F.when(F.col("docs") >= min_docs, F.col("failed") / F.col("docs"))
    m = hosts.agg(F.count(share).alias("n"), F.avg(share).alias("mean"), F.var_samp(share).alias("var"), F.avg(F.when(share.isNotNull(), 1 / F.col("docs"))).alias("inverse"), F.sum("failed").alias("failed"), F.sum("docs").alias("docs")).first()
    a, b = _prior(m, min_docs)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))


def _prior(m, min_docs: int) -> tuple[float, float]:
    """Beta parameters by moments; the spread that sampling alone would give is taken off the variance."""
    if not m.docs:
        return 1.0, 1.0
    overall = m.failed / m.docs
    mean, weight = overall, float(min_docs)
    if (m.n or 0) >= 2 and 0 < m.mean < 1:
        between = m.var - m.mean * (1 - m.mean) * m.inverse
        mean = m.mean
        weight = m.mean * (1 - m.mean) / between - 1 if between > 0 else 1e6
        weight = min(max(weight, 1.0), 1e6)
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the rules, base_failed and kept of every row of ``docs(doc_id, text, <host>, ...)``.

    kept is false where the document fails itself or its host's shrunken rate is above ``max_rate``. A row without
    host is judged by itself alone. Rows are independent otherwise, so ids may be null or repeated; an empty table
    gives an empty result. Only condemned hosts are joined back: they are counted first and broadcast if few, else
    the join is shuffled and a large host is split by Spark.
    """
    rules = store(document_rules(docs, host), "host-rules")
    condemned = host_rates(rules).where(F.col("rate") > max_rate).select(F.col("host").alias("bad"))
    joined = rules.join(checked_broadcast(condemned), F.col("host") == F.col("bad"), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"), "host",
    )
