"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of 13 consecutive words of a benchmark item, or a shorter
item as a whole. Patterns of one length share a table: blocks of two words give
the shift by which a search may move on; a shift of nothing leads to the bucket
of patterns that end in that block, and those are compared, by hash and then
word for word. Many documents are searched in step, each with its own place.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import ALNUM, U64, Words, mix, windows, word_slices
from .state import bounded_batches, cut_lineage

WINDOW = 13
#: Benchmark text that is searched in one pass over the documents; more takes more passes.
BLOCK_BYTES = 4 << 20


class WuManber:
    """Patterns of one length: words[i] are the byte words of pattern i."""

    def __init__(self, patterns: list[tuple[bytes, ...]], hashes: np.ndarray, runs: np.ndarray):
        """hashes: of each pattern; runs: (patterns, length) of word hashes."""
        self.length = runs.shape[1]
        self.block = min(2, self.length)
        self.bits = max(12, min(24, int(4 * runs.size).bit_length()))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int32)
        for at in range(self.length - self.block + 1):
            place = self._place(runs[:, at : at + self.block])
            np.minimum.at(self.shift, place, self.length - self.block - at)
        ends = self._place(runs[:, self.length - self.block :])
        order = np.argsort(ends, kind="stable")
        self.ends, self.order = ends[order], order
        self.patterns, self.hashes = patterns, hashes

    def _place(self, block: np.ndarray) -> np.ndarray:
        raw = block[:, 0] if self.block == 1 else block[:, 0] * U64(0x9FB21C651E98DF25) + block[:, 1]
        return (mix(raw) >> U64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first words, patterns) of all occurrences."""
        n = len(words.hashes)
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none
        blocks = words.hashes[:, None] if self.block == 1 else np.stack((words.hashes[:-1], words.hashes[1:]), axis=1)
        place = self._place(blocks)
        at = words.first[:-1] + self.length - self.block  # each document's first block to look at
        end = words.first[1:] - self.block
        found = []
        active = at <= end
        at, end = at[active], end[active]
        while len(at):
            move = self.shift[place[at]]
            stop = move == 0
            if stop.any():
                found.append(at[stop])
            at = at + np.maximum(move, 1)
            active = at <= end
            at, end = at[active], end[active]
        if not found:
            return none, none
        at = np.concatenate(found)
        first = np.searchsorted(self.ends, place[at], "left")
        count = np.searchsorted(self.ends, place[at], "right") - first
        row = np.repeat(np.arange(len(at)), count)
        pattern = self.order[np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
        starts = at[row] - (self.length - self.block)
        same = windows(words.hashes, self.length)[starts] == self.hashes[pattern]
        starts, pattern = starts[same], pattern[same]
        equal = [all(words.text(s + k) == w for k, w in enumerate(self.patterns[p])) for s, p in zip(starts.tolist(), pattern.tolist(), strict=True)]
        return starts[np.array(equal, bool)], pattern[np.array(equal, bool)]


def compile_items(items: list[tuple[str, str]], window: int) -> list[tuple[WuManber, list[set[str]]]]:
    """Tables by pattern length, each with the ids of the items that hold a pattern."""
    patterns: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    runs: dict[tuple, np.ndarray] = {}
    texts = pa.array([t for _, t in items], pa.large_string())
    for at, words in word_slices(texts, ALNUM, lower=True):
        for i in range(len(words)):
            span = words.of(i)
            n = span.stop - span.start
            if not n:
                continue
            length = min(window, n)
            own = [words.text(w) for w in range(span.start, span.stop)]
            for k in range(n - length + 1):
                key = tuple(own[k : k + length])
                patterns[length][key].add(items[at + i][0])
                runs[key] = words.hashes[span.start + k : span.start + k + length]
    out = []
    for length, found in sorted(patterns.items()):
        keys = list(found)
        table = np.stack([runs[k] for k in keys])
        whole = windows(table.ravel(), length)[::length]
        out.append((WuManber(keys, whole, table), [found[k] for k in keys]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", clean_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are maximal runs of digits, letters and non-ASCII characters, A-Z
    lower-cased. A null or empty text has no words and is clean. Benchmark rows
    without an id or without words are ignored; rows that repeat an item count
    once. contaminated: n_hit > 0 and 100 * n_hit >= percent * n_words. Without
    documents there are no rows, without items all are clean; other columns are
    ignored. With ``clean_rows`` the result is the input's rows that are clean.
    """
    spark = docs.sparkSession
    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if clean_rows else []
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("cover"), F.lit(None).cast("array<string>").alias("items"), *whole)
    kind = rows.schema["doc_id"].dataType.simpleString()
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        chosen = [(r[0], r[1]) for r in part.collect()]  # about block_bytes
        shared = spark.sparkContext.broadcast(compile_items(chosen, window))
        final = block == blocks - 1

        def search(batches: Iterator[pa.RecordBatch], shared=shared, final=final) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in batches:
                for at, words in word_slices(batch.column(1), ALNUM, True):
                    n = len(words)
                    covers, items = batch.column(2).slice(at, n), [set(x or ()) for x in batch.column(3).slice(at, n).to_pylist()]
                    change = np.zeros(len(words.hashes) + 1, np.int32)
                    for table, owners in tables:
                        starts, found = table.search(words)
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + table.length, -1)
                        for doc, p in zip(np.searchsorted(words.first, starts, "right").tolist(), found.tolist(), strict=True):
                            items[doc - 1] |= owners[p]
                    hit = np.cumsum(change[:-1]) > 0
                    for i in range(n) if covers.null_count < n else ():
                        if covers[i].is_valid:
                            span = words.of(i)
                            hit[span] |= np.unpackbits(np.frombuffer(covers[i].as_buffer(), np.uint8), count=span.stop - span.start).astype(bool)
                    ids = batch.column(0).slice(at, n)
                    lists = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                    if not final:
                        packed = [np.packbits(hit[words.of(i)]).tobytes() for i in range(n)]
                        yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(at, n), pa.array(packed, pa.binary()), lists, *(c.slice(at, n) for c in batch.columns[4:])], names=batch.schema.names)
                        continue
                    n_words = np.diff(words.first)
                    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[words.first])
                    sums = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                    bad = (n_hit > 0) & (100 * n_hit >= percent * n_words)
                    if clean_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(4).slice(at, n).filter(pa.array(~bad))], names=["row"])
                        continue
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sums, pa.string()), pa.array(bad), lists], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

        if final and clean_rows:
            return rows.mapInArrow(search, T.StructType([rows.schema["row"]])).select("row.*")
        if final:
            return rows.mapInArrow(search, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")
        rows = cut_lineage(rows.mapInArrow(search, rows.schema))
    raise AssertionError


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 0) -> DataFrame:
    """The documents that are not contaminated, with all their columns; see decontaminate.

    By default any hit word makes a document go, so none that is kept holds an
    occurrence of a window. A null or empty text has no words and stays.
    """
    return decontaminate(docs, benchmark, window, percent, clean_rows=True)
