"""Lempel-Ziv fingerprints: the distinct phrases of an LZ78 parse of a text, min-hashed.

A phrase is the shortest run of bytes from the present place that is not yet in
the dictionary, which is a trie. Phrases are hashed as spans of the text
and one-permutation min-hashing keeps BINS values of 16 bits. The likeness of
two fingerprints is the share of equal values, an estimate of the Jaccard
similarity of the phrase sets, as compression distances measure it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _BASE, _SYMBOL, _WBASE, U64, OnePermutation, inverse, mix, powers
from .state import bounded_batches, text_bytes

BINS = 128
#: Text in a range of ids, about, and ranges at most: the driver and each task know the bounds of all.
#: Texts of a range are read one after the other, so its size bounds a task's time, not its memory.
CELL_BYTES, CELLS = 4 << 20, 20_000
LEAST = np.iinfo(np.int64).min
_HASHER = OnePermutation(BINS)


def parse(data: bytes, at: int = 0, trie: dict[int, int] | None = None) -> tuple[list[int], dict[int, int]]:
    """(ends of the phrases from ``at`` on, the dictionary as a trie). The last phrase may be an old one.

    The trie maps node * 256 + byte to a node. Each new phrase adds one entry, so
    the first k entries are the dictionary after k phrases.
    """
    trie = {} if trie is None else trie
    ends, node, new = [], 0, len(trie) + 1
    put, step = ends.append, trie.get
    for end, byte in enumerate(data[at:] if at else data, at + 1):
        key = node << 8 | byte
        node = step(key)
        if node is None:
            trie[key] = new
            new += 1
            node = 0
            put(end)
    if node:
        put(len(data))
    return ends, trie


def span_hashes(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """A hash of each run data[bounds[i]:bounds[i+1]], by its bytes only."""
    code = np.frombuffer(data, np.uint8)
    n = len(code)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_SYMBOL[code] * powers(_BASE, n), out=total[1:])
        raw = (total[bounds[1:]] - total[bounds[:-1]]) * powers(inverse(_BASE), n + 1)[bounds[:-1]]
        return mix(raw + np.diff(bounds).astype(U64) * U64(_WBASE))


def _signature(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(BINS, ">u2")
    return (mix(_HASHER.signature(np.sort(hashes))) & U64(0xFFFF)).astype(">u2")  # repeats change no minimum


def fingerprint(text: str | bytes) -> str:
    """The fingerprint of one text in hexadecimal; an empty text has zeros."""
    data = text.encode() if isinstance(text, str) else text
    return _signature(span_hashes(data, np.array([0, *parse(data)[0]]))).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal values, 0 to 1."""
    return float(np.mean(np.frombuffer(bytes.fromhex(a), np.uint16) == np.frombuffer(bytes.fromhex(b), np.uint16)))


class _Print:
    """A text, its parse and signature."""

    __slots__ = ("id", "data", "ends", "trie", "hashes", "signature")

    def __init__(self, id_, data: bytes):
        self.id, self.data = id_, data
        ends, self.trie = parse(data)
        self.ends = np.array([0, *ends])
        self.hashes = span_hashes(data, self.ends)
        self.signature = _signature(self.hashes)

    def edited(self, other: _Print) -> tuple[int, bytes, np.ndarray]:
        """(code points, the edited text, its signature); the parse goes on from the last phrase before the edit."""
        text, given = self.data.decode(), other.data
        n = len(text)
        half = n // 2
        head = text[: n - half].encode()
        data = head + given.decode()[:half].encode()
        k = int(np.searchsorted(self.ends, len(head), "right")) - 1
        start = int(self.ends[k])
        rest = parse(data, start, dict(islice(self.trie.items(), k)))[0]
        more = span_hashes(data[start:], np.array([start, *rest]) - start)
        return n, data, _signature(np.concatenate((self.hashes[:k], more)))


class Ranges:
    """Ranges of (id, hash of the text) from quantiles of the ids. An id that takes several is split by the hash."""

    def __init__(self, marks: np.ndarray):
        self.bounds, times = np.unique(marks, return_counts=True)
        self.parts = np.where(times > 1, times, 0)  # ranges of the rows with just this id; the rest of its interval is one more
        self.first = np.concatenate(([0], 1 + np.concatenate(([0], np.cumsum(self.parts + 1)))))[: len(self.bounds) + 1]

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The number of each row's range; numbers ascend with (id, hash)."""
        place = np.searchsorted(self.bounds, keys, "right")
        cell = self.first[place].astype(np.int64)
        inner = place > 0
        at = place[inner] - 1
        share = ties[inner].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        part = ((share >> np.uint64(32)) * self.parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell[inner] += np.where(keys[inner] == self.bounds[at], part, self.parts[at])
        return cell

    def numbered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(self.of(keys, ties)), *batch.columns], names=["cell", "key", "tie"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many of the next document's first, or all it has. The next document is the
    one with the next larger id; after the last comes the first; of rows that
    repeat an id the order is that of a hash of their texts (xxhash64, signed),
    and a null id comes before all. A null text is empty. A lone document follows itself. An
    empty table gives no rows; other columns are ignored.

    Texts move once, compressed, into ranges of ids whose bounds are quantiles.
    A range's first document is also sent to the range before it. Only rows that
    repeat both id and text share a range whatever their number.
    """
    source = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LEAST))).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    count, total = text_bytes(source)
    cells = max(16, min(CELLS, -(-total // CELL_BYTES)))
    marks = source.agg(F.percentile_approx("key", [k / cells for k in range(1, cells)], 20 * cells)).first()[0] or []
    ranges = Ranges(np.array(marks, np.int64))
    leasts = source.select("key", "tie").mapInArrow(ranges.numbered, "cell long, key long, tie long").groupBy("cell").agg(F.min(F.struct("key", "tie")).alias("least")).orderBy("cell").collect()  # one row a range
    before = {(int(r["least"][0]), int(r["least"][1])): int(leasts[i - 1]["cell"]) for i, r in enumerate(leasts)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            packed = [squeeze.compress((x.as_py() or "").encode()) for x in batch.column(2)]
            pairs = list(zip(keys.tolist(), ties.tolist(), strict=True))
            extra = [i for i, pair in enumerate(pairs) if pair in before]
            at = np.array([*range(len(keys)), *extra], np.int64)
            cell = ranges.of(keys, ties)[at]
            cell[len(keys) :] = [before[pairs[i]] for i in extra]
            last = np.zeros(len(at), bool)
            last[len(keys) :] = True
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(last), pa.array(keys[at]), pa.array(ties[at]), pa.array([packed[i] for i in at.tolist()], pa.binary())], names=["cell", "last", "key", "tie", "packed"])

    def emit(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held, place, closed, rows = None, None, False, []
        for batch in batches:
            for cell, last, key, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != place:
                    held, place, closed = None, cell, False
                elif closed:  # another row with the id of the first of the next range
                    continue
                now = _Print(key, expand.decompress(packed))
                if held is not None:
                    n, data, edited = held.edited(now)
                    rows.append((None if held.id == LEAST else held.id, n, hashlib.sha256(data).hexdigest(), held.signature.tobytes().hex(), edited.tobytes().hex(), float(np.mean(held.signature == edited)), float(np.mean(held.signature == now.signature))))
                held, closed = now, last
                if len(rows) >= 500:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    ranged = source.mapInArrow(send, "cell long, last boolean, key long, tie long, packed binary").repartition(cells, "cell").sortWithinPartitions("cell", "last", "key", "tie", "packed")
    return ranged.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
