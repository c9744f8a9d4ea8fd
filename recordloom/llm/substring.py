"""Removal of repeated word windows, found through difference-cover anchors.

A window is ``window`` consecutive words. With a difference cover D modulo v,
any two equal windows hold equal anchors (runs of window - v + 1 words) at
places that are both in D modulo v, at the same offset. So only anchors at cover
places are hashed for the search, 4 of 13 here. Windows around an anchor that
occurs twice are then compared by their full hash, the extension step.

Documents are dealt into cells by id and text, once; a cell's text is bounded.
Cells exchange only distinct hashes, so a passage that a third of all rows share
counts once for each cell: neither a key nor a task grows with its copies. Only
rows that repeat both id and text share a cell whatever their number.

Equal 64-bit hashes count as equal words. A window goes wrongly only if its hash
meets another's and both hold an anchor that occurs twice: among n windows of
repeated passages, n * n / 2**65 pairs are expected to, one for n of 6e9.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, windows, word_slices
from .state import text_bytes

#: Difference covers (fixed values): every residue modulo the key is a difference of two entries.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Text in a cell, and text whose hashes meet in one bucket, about.
CELL_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20
LEAST = np.iinfo(np.int64).min


class _Cell:
    """The documents of one cell in order of id, then the text's hash."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        keys = ids.fill_null(LEAST).to_numpy(zero_copy_only=False)
        texts = table.column("text").combine_chunks().fill_null("")
        ties = table.column("tie").to_numpy() if table.num_rows else np.zeros(0, np.int64)
        order = np.lexsort((ties, keys))
        self.ids, self.keys, self.ties, self.texts = ids.take(pa.array(order)), keys[order], ties[order], texts.take(pa.array(order)).cast(pa.large_string())
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, words in word_slices(self.texts, SPACED, lower=False):
            hashes.append(words.hashes)
            counts.append(np.diff(words.first))
        self.counts, self.window = np.concatenate(counts), window
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.words = np.concatenate(hashes)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def starts(self, length: int) -> np.ndarray:
        """Places at which a run of ``length`` words of one document begins."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 : length - 1 + n])

    def anchors(self, modulus: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs at cover places."""
        length = self.window - modulus + 1
        at = self.starts(length)
        cover = np.zeros(modulus, bool)
        cover[list(COVERS[modulus])] = True
        at = at[cover[(at - self.first[self.doc[at]]) % modulus]]
        return at, windows(self.words, length)[at] if len(at) else np.zeros(0, np.uint64)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts[back] > 1


def _dealt(cell: int, buckets: int, hashes: np.ndarray, *more: np.ndarray) -> pa.Table:
    """One row per bucket that has hashes: bucket, cell, and each array's bytes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    lead = np.flatnonzero(np.diff(bucket, prepend=-1))
    tail = np.append(lead, len(bucket))[1:]
    columns = [pa.array(bucket[lead], pa.int64()), pa.array(np.full(len(lead), cell), pa.int64())]
    columns += [pa.array([x[order][a:b].tobytes() for a, b in zip(lead, tail, strict=True)], pa.binary()) for x in (hashes, *more)]
    return pa.table(columns, names=["bucket", "cell", "hashes", *("ids", "ties", "starts")[: len(more)]])


def _gathered(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]


def _back(cells: list[int], parts: list[np.ndarray]) -> pa.Table:
    full = [(c, p.tobytes()) for c, p in zip(cells, parts, strict=True) if len(p)]
    return pa.table([pa.array([c for c, _ in full], pa.int64()), pa.array([p for _, p in full], pa.binary())], names=["cell", "hashes"])


def _heard(table: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_gathered(table, "hashes", np.uint64)]))


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    Words are maximal runs without ASCII white space. A word goes if a window
    over it has a word sequence that also starts earlier: at a smaller id, or
    earlier in the same document. Windows are judged on the input. A null text
    has no words (kept text empty). Rows that repeat an id are ordered by a hash
    of their texts (xxhash64, signed); a null id comes before all others. An empty table gives no rows;
    other columns are ignored.
    """
    modulus = max(m for m in COVERS if m == 1 or m <= window - 7)
    _, total = text_bytes(docs, text_col)
    cells, buckets = max(16, -(-total // CELL_BYTES)), max(16, -(-total // BUCKET_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    # All three passes read this one exchange.
    dealt = source.withColumn("cell", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(cells))).repartition(cells, "cell")

    def tell_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, hashes = _Cell(table, window).anchors(modulus)
        return _dealt(key[0].as_py(), buckets, np.unique(hashes))

    def met_elsewhere(table: pa.Table) -> pa.Table:
        parts = _gathered(table, "hashes", np.uint64)
        twice = np.split(_repeated(np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])
        return _back(table.column("cell").to_pylist(), [p[t] for p, t in zip(parts, twice, strict=True)])

    def tell_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, shared = _Cell(left, window), _heard(right)
        at, hashes = cell.anchors(modulus)
        at = at[np.isin(hashes, shared)]
        near = np.zeros(len(cell.words) + 1, np.int32)
        np.add.at(near, np.maximum(at - modulus + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        starts = cell.starts(window)
        starts = starts[np.cumsum(near)[starts] > 0]
        # Equal hashes are kept once, at their first place: places are in order of id and start.
        own, lead = np.unique(windows(cell.words, window)[starts] if len(starts) else np.zeros(0, np.uint64), return_index=True)
        starts = starts[lead]
        docs_ = cell.doc[starts]
        return _dealt(key[0].as_py(), buckets, own, cell.keys[docs_], cell.ties[docs_], starts - cell.first[docs_])

    def first_elsewhere(table: pa.Table) -> pa.Table:
        parts = _gathered(table, "hashes", np.uint64)
        hashes = np.concatenate(parts)
        order = np.lexsort((*(np.concatenate(_gathered(table, c, np.int64)) for c in ("starts", "ties", "ids")), hashes))
        later = np.zeros(len(hashes), bool)
        later[order[1:]] = hashes[order][1:] == hashes[order][:-1]
        late = np.split(later, np.cumsum([len(p) for p in parts])[:-1])
        return _back(table.column("cell").to_pylist(), [p[t] for p, t in zip(parts, late, strict=True)])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, foreign = _Cell(left, window), _heard(right)
        starts = cell.starts(window)
        hashes = windows(cell.words, window)[starts] if len(starts) else np.zeros(0, np.uint64)
        repeat = np.ones(len(hashes), bool)
        repeat[np.unique(hashes, return_index=True)[1]] = False
        starts = starts[repeat | np.isin(hashes, foreign)]
        change = np.zeros(len(cell.words) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        stays = np.cumsum(change[:-1]) == 0
        kept_n = np.diff(np.concatenate(([0], np.cumsum(stays)))[cell.first])
        sums, texts = [], []
        for i, text in enumerate(cell.texts):
            words = text.as_buffer().to_pybytes().split()
            if kept_n[i] < cell.counts[i]:
                words = compress(words, stays[cell.first[i] : cell.first[i + 1]])
            kept = b" ".join(words)
            sums.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        return pa.table([cell.ids, pa.array(cell.counts), pa.array(cell.counts - kept_n), pa.array(sums, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])], names=names)

    told = dealt.groupBy("cell").applyInArrow(tell_anchors, "bucket long, cell long, hashes binary")
    shared = told.groupBy("bucket").applyInArrow(met_elsewhere, "cell long, hashes binary")
    told = dealt.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(tell_windows, "bucket long, cell long, hashes binary, ids binary, ties binary, starts binary")
    foreign = told.groupBy("bucket").applyInArrow(first_elsewhere, "cell long, hashes binary")
    kinds = {"doc_id": "long", "n_words": "long", "n_removed": "long"}
    return dealt.groupBy("cell").cogroup(foreign.groupBy("cell")).applyInArrow(remove, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))

