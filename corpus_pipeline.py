"""A pipeline from documents to token digests: five stages, each a DataFrame over all that the one before it kept.

All stages but the last return the columns of ``documents``. Each is written as Parquet below the shared folder and
reread, so a lost executor costs no more than its own stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontaminate, ngram_join, pieces, private_data, toxicity
from pulsegrid.llm.common import store, table

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain calls toxic. Fitted on the labelled rows among ``docs``."""
    return toxicity.without_toxic(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without words, and rows without id, are in no group and stay. Of equal rows one stays.
    """
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within its edit budget."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind in brackets; n_chars follows the new text."""
    return private_data.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("private_data", mask_private_data),
    ("sentencepiece", encode),
]

# fitted models and a tokenizer are not expressible; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, f"pipeline-{name}")
    return docs


