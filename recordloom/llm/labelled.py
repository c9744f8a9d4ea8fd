"""Labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import bounded_batches

#: Labelled rows that a model is fitted on, at most; which ones a hash of the id decides.
SAMPLE_ROWS = 12_000


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, one per distinct text.

    The ids of the sample are few enough to broadcast; documents are read once.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy(F.xxhash64("text").alias("_t")).agg(F.first("text").alias("text"), F.max("label").alias("label")).drop("_t")
