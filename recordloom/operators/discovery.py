"""Fields and scalar values that records hold."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language import FilterChoice, FilterCompletion, format_field_path

#: Distinct entries a task holds before it passes its counts on.
FLUSH = 100_000
_SCHEMA = "path array<string>, source string, kind string, spelling string, n long"


def spell(value) -> str:
    """A scalar's JSON spelling; 1 and 1.0 differ, control characters beyond ASCII are escaped."""
    text = json.dumps(value, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0x7F <= ord(c) <= 0x9F else c for c in text)


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number" if math.isfinite(value) else "unsupported"
    return "collection"


def walk(record: dict):
    """(path, source, kind, spelling) for each path, and for immediate scalar elements of arrays."""
    todo = [((), record)]
    while todo:
        at, item = todo.pop()
        for key, value in item.items():
            if not key:
                yield at, "field", "unsupported_path", ""
                continue
            path, kind = (*at, key), _kind(value)
            yield path, "field", kind, "" if kind in ("collection", "unsupported") else spell(value)
            if isinstance(value, dict):
                todo.append((path, value))
            elif isinstance(value, list):
                for element in value:
                    kind = _kind(element)
                    yield path, "array_element", "unsupported" if kind == "collection" else kind, "" if kind in ("collection", "unsupported") else spell(element)


def _batch(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([list(k[0]) for k in keys], pa.list_(pa.string())), *(pa.array([k[i] for k in keys], pa.string()) for i in (1, 2, 3)), pa.array([counts[k] for k in keys], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "source", "kind", "spelling", "n"])


def entries(records: DataFrame) -> DataFrame:
    """path, source, kind, spelling, n: every distinct entry of the records' JSON once, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                counts.update(walk(json.loads(line)))
                if len(counts) >= FLUSH:
                    yield _batch(counts)
                    counts.clear()
        if counts:
            yield _batch(counts)

    walked = records.select("raw").mapInArrow(run, _SCHEMA)
    return walked.groupBy("path", "source", "kind", "spelling").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.StringType())
def _spelled(paths: pd.Series) -> pd.Series:
    return paths.map(lambda path: format_field_path(tuple(path)))


def fields(found: DataFrame, prefix: str = "", parent: tuple[str, ...] | None = None) -> DataFrame:
    """path, spelling, occurrences, collections; restricted to spellings (or components under ``parent``) with a prefix."""
    own = found.where("source = 'field' and kind <> 'unsupported_path'")
    out = own.groupBy("path").agg(F.sum("n").alias("occurrences"), F.sum(F.when(F.col("kind") == "collection", F.col("n")).otherwise(0)).alias("collections"))
    if parent is not None:
        head = F.array(*[F.lit(p) for p in parent]) if parent else F.array().cast("array<string>")
        out = out.where((F.size("path") == len(parent) + 1) & (F.slice("path", 1, len(parent)) == head) & F.element_at("path", -1).startswith(prefix))
        return out.withColumn("spelling", _spelled("path"))
    return out.withColumn("spelling", _spelled("path")).where(F.col("spelling").startswith(prefix))


def values(found: DataFrame, path: tuple[str, ...] | None = None, prefix: str = "", kinds: tuple[str, ...] = (), source: str | None = None) -> DataFrame:
    """path, source, kind, spelling, n of scalar values. Order: by count and spelling, or with a prefix by spelling."""
    out = found.where(F.col("kind").isin("null", "boolean", "string", "number"))
    if path is not None:
        out = out.where(F.col("path") == F.array(*[F.lit(p) for p in path]))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if source:
        out = out.where(F.col("source") == source)
    if prefix:
        return out.where(F.col("spelling").startswith(prefix)).orderBy("spelling")
    return out.orderBy(F.col("n").desc(), "spelling")


def complete(found: DataFrame, request: FilterCompletion, offset: int = 0, limit: int = 20) -> FilterCompletion:
    """The request with what the records offer in its place, ahead of the grammar's choices: fields, or values of the field.

    A page of ``limit`` observations from ``offset`` on; a prefix restricts them.
    """
    if limit < 0 or offset < 0:
        raise ValueError("offset and limit must not be negative")
    parent, offered = request.field_path, []
    if request.kind in ("field", "expression"):
        bracket = request.prefix.startswith('"')
        prefix = request.prefix[1:] if bracket else request.prefix
        seen = fields(found, prefix, parent if parent or bracket else None).orderBy("spelling").offset(offset).limit(limit)
        for row in seen.collect():
            name = json.dumps(row["path"][-1], ensure_ascii=False) if bracket else format_field_path(tuple(row["path"][-1:])) if parent else row["spelling"]
            if parent and not bracket and name.startswith("["):
                continue  # a name that only brackets can spell
            offered.append(FilterChoice(row["spelling"], name, f"{row['occurrences']} records"))
    elif request.kind == "value" and parent:
        kinds = ("string",) if request.value_kind == "string" else ()
        seen = values(found, parent, request.prefix, kinds, request.value_source).offset(offset).limit(limit)
        wrap = "[{}]" if request.value_kind == "array" else "{}"
        offered = [FilterChoice(r["spelling"], wrap.format(r["spelling"]), f"{r['kind']}, {r['n']} times") for r in seen.collect()]
    told = {c.insertion for c in offered}
    guidance = request.guidance if offered or request.kind not in ("field", "value") else f"{request.guidance}; the records offer none"
    return replace(request, choices=(*offered, *(c for c in request.choices if c.insertion not in told)), guidance=guidance)


def unsupported(found: DataFrame) -> DataFrame:
    """One row: paths, values and elements that discovery cannot offer."""

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    return found.agg(
        total(F.col("kind") == "unsupported_path").alias("paths"),
        total((F.col("kind") == "unsupported") & (F.col("source") == "field")).alias("values"),
        total((F.col("kind") == "unsupported") & (F.col("source") == "array_element")).alias("elements"),
    )
