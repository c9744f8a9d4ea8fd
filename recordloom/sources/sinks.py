"""Record sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lanes import lane
from .records import timestamp


def write_jsonl(records: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, as read where a record still has its text."""
    records.select(F.coalesce("raw", F.to_json("v")).alias("value")).write.mode(mode).text(path)


def write_rotated(records: DataFrame, path: str, keep: int | None = None) -> None:
    """JSON lines in a folder per UTC day; records without a time go to ``undated``.

    All records are written. With ``keep``, folders of days before the present one
    and the ``keep`` before it are then deleted, as a rotating handler does.
    """
    day = F.date_format(timestamp(lane(F.col("v"), ("timestamp",)).string), "yyyy-MM-dd")
    rows = records.select(F.coalesce(day, F.lit("undated")).alias("day"), F.coalesce("raw", F.to_json("v")).alias("value"))
    rows.write.partitionBy("day").mode("append").text(path)
    if keep is not None:
        spark = records.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        days = sorted((f.getPath() for f in files.listStatus(root) if re.fullmatch(r"day=\d{4}-\d{2}-\d{2}", f.getPath().getName())), key=lambda p: p.getName())
        for old in days[: -(keep + 1)]:
            files.delete(old, True)
