"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut_lineage, discard

__all__ = ["bounded_batches", "cut_lineage", "discard", "hot_at", "hot_keys", "join_hot", "table", "text_bytes"]

#: Rows in an Arrow batch, at most: with texts or sets of some 100 KB a batch stays below 100 MB.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; lowers the session's Arrow batch size, which counts rows whatever their length."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


#: At most so many keys of a table count as hot.
HOT = 4096


#: Narrow rows of one key that a task may well hold.
FEW = 10_000


def hot_at(rows: int) -> int:
    """Keys with more rows than this are hot; of a table with ``rows`` rows fewer than HOT can be."""
    return max(FEW, rows // HOT)


def hot_keys(counted: DataFrame, keys: list[str], rows: int, count: str = "m") -> DataFrame | None:
    """The hot keys of a table with ``rows`` rows, from its keys and their counts; None where there are none."""
    if rows <= FEW:
        return None
    found = cut_lineage(counted.where(F.col(count) > hot_at(rows)).select(*keys))
    return None if found.isEmpty() else found


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right (one narrow row a key) where some keys hold a large share of left's rows.

    ``hot`` names those keys, fewer than HOT, if there are any; their rows of
    right are broadcast and left's rows stay where they are. ``how`` is inner or
    left.
    """
    if hot is None:
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot.select(*keys)), keys, "left_semi").withColumn("_hot", F.lit(True))
    added = [c for c in right.columns if c not in keys]
    marked = left.join(F.broadcast(few), keys, "left")
    names = [*left.columns, *added]
    return marked.where("_hot").select(*names).unionByName(marked.where("_hot is null").drop("_hot", *added).join(right, keys, how).select(*names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text), by one scan."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0).cast("long"))).first()
    return int(row[0]), int(row[1])
