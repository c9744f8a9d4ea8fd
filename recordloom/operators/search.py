"""Literal text search in decoded records."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields a console line shows first, those it hides, and stand-ins for a primary field that is absent.
PRIMARY = ("timestamp", "level", "logger", "message", "span")
HIDDEN = frozenset(
    """file func line trace_id span_id parent_span_id event duration_ms exception stack error error_type status filename function lineno span_name
    trace_name pathname module funcName process processName thread threadName stack_info exc_info traceback name created msecs relativeCreated""".split()
)
FALLBACKS = (("span", "span_name"),)


@dataclass(frozen=True)
class SearchProjection:
    """Which fields of a record are visible: primary and included ones, those not hidden, and stand-ins of absent primary ones.

    A record without any primary field shows all, if ``generic``.
    """

    primary: tuple[str, ...] = PRIMARY
    hidden: frozenset[str] = HIDDEN
    included: tuple[str, ...] = ()
    fallbacks: tuple[tuple[str, str], ...] = FALLBACKS
    generic: bool = True

    def visible(self, record: dict) -> dict:
        if self.generic and record.keys().isdisjoint(self.primary):
            return record
        stand_ins = {other for name, other in self.fallbacks if name not in record}
        shown = {*self.primary, *self.included, *stand_ins}
        return {k: v for k, v in record.items() if k in shown or k not in self.hidden}


CONSOLE = SearchProjection()


@dataclass(frozen=True)
class SearchOptions:
    """``scope`` is full or console; a console scope looks at what the projection shows."""

    text: str
    case_sensitive: bool = False
    whole_word: bool = False
    scope: str = "full"
    projection: SearchProjection = CONSOLE

    def __post_init__(self):
        if not isinstance(self.text, str):
            raise TypeError("the text to search must be a string")
        if self.scope not in ("full", "console"):
            raise ValueError("scope is 'full' or 'console'")


def texts(value) -> list[str]:
    """Every nested key and every leaf, each as a text of its own."""
    out, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, dict):
            for key, inner in item.items():
                out.append(key)
                todo.append(inner)
        elif isinstance(item, list):
            todo += item
        else:
            out.append(item if isinstance(item, str) else json.dumps(item))
    return out


def _word(char: str) -> bool:
    return char.isalnum() or char == "_" or unicodedata.category(char).startswith("M")


def ranges(text: str, options: SearchOptions) -> list[tuple[int, int]]:
    """Non-overlapping matches as (start, stop) in the text's own code points.

    Without case the texts are case-folded, and a match must begin and end
    between whole characters of the text: "ss" is in "ß", "s" is not.
    """
    needle = options.text if options.case_sensitive else options.text.casefold()
    if not needle:
        return []
    if options.case_sensitive:
        folded, edges = text, None
    else:
        parts = [c.casefold() for c in text]
        folded, edges, total = "".join(parts), {0: 0}, 0
        for i, p in enumerate(parts):
            total += len(p)
            edges[total] = i + 1
    out, at = [], 0
    while (found := folded.find(needle, at)) >= 0:
        end = found + len(needle)
        start, stop = (found, end) if edges is None else (edges.get(found), edges.get(end))
        fits = start is not None and stop is not None
        if fits and options.whole_word:
            fits = not (start and _word(text[start - 1])) and not (stop < len(text) and _word(text[stop]))
        if fits:
            out.append((start, stop))
        at = end if fits else found + 1
    return out


def matches(record: dict, options: SearchOptions) -> bool:
    shown = record if options.scope == "full" else options.projection.visible(record)
    return any(ranges(t, options) for t in texts(shown))


@functools.cache
def _folds() -> dict[str, str]:
    """Characters beyond ASCII whose folded form holds an ASCII character."""
    return {c: f for c in map(chr, range(128, sys.maxunicode + 1)) if any(map(str.isascii, f := c.casefold()))}


def possible(raw: Column, options: SearchOptions) -> Column | None:
    """A test on the JVM that every matching line passes; None where there is none.

    A record can only match where its line holds the text, an escape, or a
    character that folds to one of the text's.
    """
    text = options.text if options.case_sensitive else options.text.lower()
    if not text.isascii() or not text.isprintable() or set(text) & set('"\\/'):
        return None
    if options.case_sensitive:
        return F.contains(raw, F.lit(text)) | F.contains(raw, F.lit("\\u"))
    near = "".join(c for c, f in _folds().items() if set(f) & set(text))
    bare = F.contains(F.lower(raw), F.lit(text)) | F.contains(raw, F.lit("\\u"))
    return bare | (F.translate(raw, near, "") != raw) if near else bare


def search(records: DataFrame, options: SearchOptions) -> DataFrame:
    """The records that match; an empty text matches none. Lines that cannot match never leave the JVM."""
    if not options.text:
        return records.where(F.lit(False))

    @F.pandas_udf("boolean")
    def test(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: line is not None and matches(json.loads(line), options)).astype(bool)

    first = possible(F.col("raw"), options)
    return (records if first is None else records.where(first)).where(test("raw"))


def neighbour(found: DataFrame, cursor: int, forward: bool = True) -> DataFrame:
    """One row: the ordinal of the next or previous match around a cursor, wrapping at the ends; null without matches."""
    ordinal = F.col("_ord")
    if forward:
        return found.agg(F.coalesce(F.min(F.when(ordinal > cursor, ordinal)), F.min(ordinal)).alias("ordinal"))
    return found.agg(F.coalesce(F.max(F.when(ordinal < cursor, ordinal)), F.max(ordinal)).alias("ordinal"))


def match_ranges(text: Column, options: SearchOptions) -> Column:
    """array<struct<start, stop>> for highlighting one text column."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def spans(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [] if t is None else [{"start": a, "stop": b} for a, b in ranges(t, options)])

    return spans(text)
