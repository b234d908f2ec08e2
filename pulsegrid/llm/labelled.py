"""Labelled rows for training, in bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# labelled rows that a model is fitted on; the first by the hash of their id
TRAIN_ROWS = 6_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, where: Column | None = None) -> DataFrame:
    """text, label, fold (0 to 3), order_ of at most ``rows`` labelled documents with a text; order_ is the hash of the id.

    Of several labels of one id the largest counts. Labels without such a document are left out before the choice. The
    chosen labels are few by construction and are broadcast. The texts are as long as they are: they are for executors.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    known = known.join(found.select(F.col("doc_id").alias("id_")), F.col("doc_id") == F.col("id_"), "left_semi")
    chosen = known.withColumn("order_", F.xxhash64("doc_id")).orderBy("order_", "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("id_"), "label", F.pmod(F.shiftright("order_", 20), F.lit(4)).cast("int").alias("fold"), "order_")
    return found.join(F.broadcast(chosen), F.col("doc_id") == F.col("id_")).dropDuplicates(["id_"]).select("text", "label", "fold", "order_")
