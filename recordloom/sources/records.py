"""JSON-lines sources as a DataFrame of records.

Columns: ``_ord`` (global place), ``_origin`` struct<source, position, kind>,
``raw`` (the line), ``v`` VARIANT. User data lives in ``raw`` and ``v`` only.
"""

from __future__ import annotations

import glob as globbing
import json
import os
import re
import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ToolError

_DATED = re.compile(r"\.\d{4}-\d{2}-\d{2}$")
ORIGIN = "struct<source:string,position:bigint,kind:string>"


@dataclass
class Records:
    """Decoded records with the lines that were skipped and the warnings of a merge."""

    df: DataFrame
    skipped: DataFrame  # source, position, reason
    order: str = "concat"
    merge_warnings: DataFrame | None = None
    labels: list[str] = field(default_factory=list)

    def warnings(self) -> list[str]:
        """``out_of_order:<label>:<n>`` and ``untimestamped:<label>:<n>`` in source order."""
        if self.merge_warnings is None:
            return []
        rows = self.merge_warnings.orderBy("source_idx").collect()  # a row per source
        late = [f"out_of_order:{r.source}:{r.out_of_order}" for r in rows if r.out_of_order]
        return [*late, *(f"untimestamped:{r.source}:{r.untimestamped}" for r in rows if r.untimestamped)]


def rotation_order(paths: list[str]) -> list[str]:
    """Sorted paths; a live file that has dated siblings comes after them."""
    paths = sorted(paths)
    bases = {_DATED.sub("", p) for p in paths if _DATED.search(p)}
    live = [p for p in paths if p in bases]
    out = [p for p in paths if p not in bases]
    for base in live:
        last = max(i for i, p in enumerate(out) if _DATED.sub("", p) == base and p != base)
        out.insert(last + 1, base)
    return out


def expand(source: str | os.PathLike) -> list[str]:
    path = os.fspath(source)
    if not any(c in path for c in "*?["):
        return [path]
    found = globbing.glob(path)
    if not found:
        raise FileNotFoundError(f"no file matches {path}")
    return rotation_order(found)


def resolve(sources) -> list:
    """One entry per source: a path, ``"-"``, or an iterable of mappings. A list of mappings is one source."""
    if isinstance(sources, (str, os.PathLike)):
        sources = [sources]
    elif isinstance(sources, (list, tuple)) and any(not isinstance(s, Mapping) for s in sources):
        pass
    elif isinstance(sources, Iterable):
        sources = [sources]
    else:
        raise TypeError(f"not a source: {sources!r}")
    out = []
    for s in sources:
        if isinstance(s, (str, os.PathLike)) and os.fspath(s) != "-":
            out += expand(s)
        elif isinstance(s, (str, os.PathLike)):
            out.append("-")
        elif isinstance(s, Iterable):
            out.append(s)
        else:
            raise TypeError(f"not a source: {s!r}")
    return out


def timestamp(text: Column) -> Column:
    """ISO-8601 text as a UTC timestamp; without a zone it is UTC, and what cannot be read is null."""
    usable = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(usable, F.try_to_timestamp(F.regexp_replace(F.translate(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))


#: Tables with a row per split are broadcast up to so many rows, some tens of megabytes; 128 MB a split make it 128 TB.
SPLITS = 1_000_000


def _by_split(table: DataFrame, scanned: DataFrame) -> DataFrame:
    """A table with a row per split of a scan, broadcast if the scanned files' size (known without a job) keeps it small."""
    leaves = scanned._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    size = sum(int(x.stats().sizeInBytes()) for x in files)
    width = scanned.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return F.broadcast(table) if size // width <= SPLITS else table


def _uri(path: str) -> str:
    """The path of a file as the reader's metadata spell it, without scheme and slashes before it."""
    known = _SCHEME.match(path)
    rest = path[known.end() :] if known else os.path.abspath(path).lstrip("/")
    return "".join(c if c in _LEGAL or (ord(c) > 127 and c.isprintable()) else "".join(f"%{x:02X}" for x in c.encode()) for c in rest)


_SCHEME = re.compile(r"^(?:file:/+|[A-Za-z][A-Za-z0-9+.-]*://[^/]*/+)")
_LEGAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*,;:$&+=@/")


def _lines_of_files(spark: SparkSession, paths: list[tuple[int, str]]) -> DataFrame:
    """Physical lines of all files with their numbers, by one scan and without a shuffle.

    A split's rows are consecutive, so its least id and the counts of the file's
    splits before it give the numbers. The paths are distinct.
    """
    df = spark.read.text([p for _, p in paths])
    name = F.regexp_replace("_metadata.file_path", _SCHEME.pattern, "")
    df = df.select("value", name.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    parts = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    listed = spark.createDataFrame([(_uri(p), i, p) for i, p in paths], "_file string, source_idx int, source string")
    parts = parts.join(F.broadcast(listed), "_file", "left")  # a row per listed file, as the driver has them
    unknown = F.raise_error(F.concat(F.lit("a file that was not listed: "), "_file")).cast("int")
    parts = parts.withColumn("source_idx", F.coalesce("source_idx", unknown))
    numbered = df.join(_by_split(parts, df), ["_file", "_block"])
    position = F.col("_before") + F.col("_at") - F.col("_least") + 1
    return numbered.select("source_idx", "source", F.lit("file").alias("kind"), "_block", position.alias("position"), "value")


def _lines_of_rows(spark: SparkSession, rows: list[tuple[int, str]], label: str, kind: str, idx: int) -> DataFrame:
    df = spark.createDataFrame(rows, "position long, value string").coalesce(1)
    return df.select(F.lit(idx).alias("source_idx"), F.lit(label).alias("source"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("_block"), "position", "value")


def read_lines(spark: SparkSession, sources) -> tuple[DataFrame, list[str]]:
    """source_idx, source, kind, _block (split), position, value for all sources, and their labels."""
    frames, labels, files, memory = [], [], [], 0
    for idx, source in enumerate(resolve(sources)):
        if isinstance(source, str) and source == "-":
            labels.append("-")
            frames.append(_lines_of_rows(spark, list(enumerate(sys.stdin.read().splitlines(), 1)), "-", "stdin", idx))
        elif isinstance(source, str):
            labels.append(source)
            files.append((idx, source))
        else:
            label = "mem" if not memory else f"mem{memory}"
            memory += 1
            labels.append(label)
            rows = [(i, json.dumps(r, ensure_ascii=False) if isinstance(r, Mapping) else "[]") for i, r in enumerate(source)]
            frames.append(_lines_of_rows(spark, rows, label, "iterable", idx))
    while files:  # once, and again for paths that are listed again
        first = {path: (idx, path) for idx, path in reversed(files)}
        frames.append(_lines_of_files(spark, sorted(first.values())))
        now = set(first.values())
        files = [f for f in files if f not in now]
    if not frames:
        frames = [_lines_of_rows(spark, [], "", "iterable", 0)]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out, labels


def decode(lines: DataFrame) -> DataFrame:
    """Adds ``v`` and ``reason`` (null for a record): blank, malformed_json or non_object. Duplicate keys: the last wins."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The parser stops after a first value; as the only element of an array, that value must be all there is.
    whole = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    v = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))
    tag = F.schema_of_variant("v")
    reason = F.when(F.trim("value") == "", "blank").when(F.col("v").isNull(), "malformed_json").when(~tag.startswith("OBJECT"), "non_object")
    return lines.withColumn("v", v).withColumn("reason", reason)


def read_records(spark: SparkSession, sources, order: str = "concat") -> Records:
    """Records of the sources one after the other, or merged by timestamp (``order="time"``).

    The merge is not a sort: each source stays in its order, and a record waits
    for the latest timestamp before it in its own source. A record without a
    timestamp goes with the one before it.
    """
    if order not in ("concat", "time"):
        raise ToolError("plan_invalid", f"unknown order {order!r}")
    lines, labels = read_lines(spark, sources)
    decoded = decode(lines)
    skipped = decoded.where("reason in ('malformed_json', 'non_object')").select("source", "position", "reason")
    good = decoded.where("reason is null")
    warnings = None
    if order == "time":
        ts = timestamp(F.when(F.schema_of_variant(F.try_variant_get("v", "$.timestamp", "variant")) == "STRING", F.try_variant_get("v", "$.timestamp", "string")))
        good = merge_keys(good.withColumn("_ts", ts))
        counted = good.groupBy("source_idx", "source").agg(F.count_if(F.col("_ts") < F.col("_last")).alias("out_of_order"), F.count_if(F.col("_ts").isNull()).alias("untimestamped"))
        warnings = counted
    placed = concatenated(good) if order == "concat" else numbered_by(good, [F.col("_key").asc_nulls_first(), "source_idx", "position"])
    df = placed.select("_ord", F.struct("source", "position", "kind").cast(ORIGIN).alias("_origin"), F.col("value").alias("raw"), "v")
    return Records(df, skipped, order, warnings, labels)


def merge_keys(rows: DataFrame) -> DataFrame:
    """Adds ``_key`` (the latest ``_ts`` of the source up to the row) and ``_last`` (the one before the row).

    Splits are summed up first, so no window is longer than a split.
    """
    split = ["source_idx", "_block"]
    sums = rows.groupBy(*split).agg(F.max("_ts").alias("_most"), F.max_by("_ts", F.when(F.col("_ts").isNotNull(), F.col("position"))).alias("_end"))
    earlier = W.partitionBy("source_idx").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*split, F.max("_most").over(earlier).alias("_most"), F.last("_end", True).over(earlier).alias("_end"))
    within = W.partitionBy(*split).orderBy("position")
    rows = rows.withColumn("_own", F.max("_ts").over(within.rowsBetween(W.unboundedPreceding, 0))).withColumn("_prior", F.last("_ts", True).over(within.rowsBetween(W.unboundedPreceding, -1)))
    joined = rows.join(_by_split(sums, rows), split)
    return joined.withColumn("_key", F.greatest("_own", "_most")).withColumn("_last", F.coalesce("_prior", "_end")).drop("_own", "_prior", "_most", "_end")


def concatenated(rows: DataFrame) -> DataFrame:
    """Adds ``_ord`` from 0 by source and split without moving a row: within a split rows are read in order."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    counts = placed.groupBy("source_idx", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("source_idx", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = placed.join(_by_split(counts, rows), ["source_idx", "_block"])
    return joined.withColumn("_ord", F.col("_first") + F.col("_at") - F.col("_least"))


def numbered_by(rows: DataFrame, keys: list, name: str = "_ord") -> DataFrame:
    """Adds a number from 0 in the order of ``keys``, by a range-partitioned sort: no task holds all rows."""
    ranked = rows.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_least"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(F.broadcast(counts), "_part")  # a row per shuffle partition
    return placed.withColumn(name, F.col("_first") + F.col("_place") - F.col("_least")).drop("_place", "_part", "_n", "_least", "_first")


def from_table(df: DataFrame, ordinal: str, fields: dict[str, Column], source: str = "table") -> DataFrame:
    """Records from a typed table: ``fields`` become keys where their value is not null. JSON null needs ``fields`` of VARIANT."""
    values = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[_as_variant(c) for c in fields.values()])), lambda _, x: x.isNotNull())
    raw = F.to_json(values)
    return df.select(F.col(ordinal).cast("long").alias("_ord"), F.struct(F.lit(source), F.col(ordinal).cast("long"), F.lit("iterable")).cast(ORIGIN).alias("_origin"), raw.alias("raw"), F.parse_json(raw).alias("v"))


def _as_variant(value: Column) -> Column:
    return value.cast("variant")
