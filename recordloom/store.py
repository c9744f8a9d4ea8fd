"""Intermediate tables in the shared folder, which every executor can read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master, as in tests, gets one of our own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="recordloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again.

    Lost executors cost no recomputation, and a loop's plans stay small: unlike
    a checkpoint, the table brings no constraints of former plans along. Tables
    go when the driver's process ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._recordloom_path = path
    return out


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder of our own deleted when the driver's process ends."""
    if not _written:
        atexit.register(_clear)
    _written[path] = spark


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut_lineage wrote and that no DataFrame in use reads."""
    for df in tables:
        _delete(df._recordloom_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)
