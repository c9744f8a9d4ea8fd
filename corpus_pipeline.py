"""From raw documents to packed sequences: five stages over the ``documents`` table.

Stages take rows as they come: a null or empty text is no toxic, near-duplicate
or contaminated one and stays, as an empty document of one id at the end; rows
that repeat an id are judged one by one, by their texts; an empty table passes
through; further columns are carried along up to packing. Names that begin with
``_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontam, neardup, packing, pii, toxicity
from recordloom.llm.queries import tokenizer_path
from recordloom.llm.state import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the lexicon on labelled documents among the input and keeps those below the threshold of 0.5.

    Without labels of both kinds the seeds alone decide.
    """
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component (five-word shingles, similarity 0.8 or more): the one with the least id.

    Of repeated rows one stays; rows with one id and different texts are different documents.
    """
    return neardup.without_near_duplicates(docs, k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark window: 13 words of an item, or a shorter item as a whole."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), percent=0)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in texts by their kind; n_chars follows the new text, a null text keeps it."""
    return pii.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token ids, kept with each piece, into sequences of at most 2048; columns are those of pieces.

    Workers outlive the stage, so they keep fewer words than in packing alone.
    """
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True, words_kept=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: The stages train a model and tokenise, which SQL cannot express; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents in order; each stage's rows are written and read again."""
    from recordloom.llm.state import cut_lineage

    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
