"""The same filters over growing folders of JSON lines (an extension: plans themselves are finite)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import Expression, lower
from ..functions.lanes import lane
from ..sources.records import timestamp


def follow(spark: SparkSession, folder: str, expression: Expression) -> DataFrame:
    """A stream of raw, v for the records of new files that match."""
    rows = spark.readStream.text(folder).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).where(lower(expression, lambda p: lane(F.col("v"), p)))


def counts_by_window(stream: DataFrame, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of a string key by event-time window; records later than ``late`` are dropped by the watermark."""
    v = F.col("v")
    timed = stream.select(timestamp(lane(v, ("timestamp",)).string).alias("ts"), lane(v, (key,)).string.alias(key)).where("ts is not null")
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"))
