"""Vectorised text kernels over Arrow string batches.

A batch's UTF-8 buffer is cut into words with byte tables and every word gets a
64-bit hash from prefix sums of a polynomial modulo 2**64, so no Python object
is made per word. Work proceeds in slices of about ``CHUNK`` bytes: memory is
bounded by the slice, or by the longest single text.

Fixed values: the odd multipliers below are arbitrary constants of this module.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_WBASE = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))

#: Byte tables: lower-casing of A-Z, and which bytes belong to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_lo : _hi + 1] = False


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        step = U64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + more] = out[:more] * step
        have += more
    return out


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; a table of CHUNK entries is kept, longer ones are made for the call."""
    table = _tables.get(base)
    if table is None or (len(table) < n and n <= 2 * CHUNK):
        table = _tables[base] = _powers(base, min(max(n, 1 << 16), 2 * CHUNK))
    return table[:n] if n <= len(table) else _powers(base, n)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """Words of several texts: byte spans, hashes, and each text's range of words."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data, starts, ends, hashes, first):
        self.data, self.starts, self.ends, self.hashes, self.first = data, starts, ends, hashes, first

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k + 1]))

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def cut(data: np.ndarray, bounds: np.ndarray, member: np.ndarray, lower: bool) -> Words:
    """Words of the texts data[bounds[k]:bounds[k+1]]; no word crosses a bound."""
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_SYMBOL[data] * powers(_BASE, n), out=total[1:])
        raw = (total[ends] - total[starts]) * powers(inverse(_BASE), n + 1)[starts]
        hashes = mix(raw + (ends - starts).astype(U64) * U64(_WBASE))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def slices(column: pa.Array, size: int = CHUNK):
    """(first row, bytes, bounds) for runs of rows of about ``size`` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, places, payload = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_slices(column: pa.Array, member: np.ndarray, lower: bool, size: int = CHUNK):
    """(first row, Words) for runs of rows."""
    for at, data, bounds in slices(column, size):
        yield at, cut(data, bounds, member, lower)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries (n - k + 1 of them, none if n < k)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(_WBASE, n), out=total[1:])
        return mix((total[k:] - total[: n - k + 1]) * powers(inverse(_WBASE), n - k + 1) + U64(k))


def shingle_sets(words: Words, k: int):
    """Per text: its sorted distinct k-word shingle hashes; with fewer words the whole sequence is one."""
    every = windows(words.hashes, k)
    for i in range(len(words)):
        span = words.of(i)
        n = span.stop - span.start
        if n >= k:
            yield np.unique(every[span.start : span.stop - k + 1])
        elif n:
            yield windows(words.hashes[span], n)
        else:
            yield np.zeros(0, U64)


class OnePermutation:
    """One-permutation min-hashing with optimal densification.

    The range of 64-bit hashes is cut into ``bins`` equal parts and the least
    hash of each part kept. An empty bin i copies the first non-empty bin of a
    probe sequence that depends on i and the attempt only, so each bin still
    agrees between two sets with a probability of their Jaccard similarity.
    """

    def __init__(self, bins: int):
        self.bins = bins

    def probes(self, empty: np.ndarray, attempt: int) -> np.ndarray:
        seed = empty.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(attempt * 0xA0761D6478BD642F & _MASK)
        return ((mix(seed) >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """For sorted hashes, at least one; repeats change nothing."""
        out = np.zeros(self.bins, U64)
        at = ((hashes >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)
        lead = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[lead]] = hashes[lead]
        full = np.zeros(self.bins, bool)
        full[at[lead]] = True
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            attempt += 1
            from_ = self.probes(empty, attempt)
            hit = full[from_]
            out[empty[hit]] = out[from_[hit]]
            empty = empty[~hit]
        return out

    def bands(self, signature: np.ndarray, rows: int) -> np.ndarray:
        """A hash for each band of ``rows`` consecutive bins, the band's number mixed in."""
        table = signature.reshape(-1, rows)
        with np.errstate(over="ignore"):
            raw = (mix(table) * powers(_WBASE, rows + 1)[1:]).sum(axis=1, dtype=U64)
            return mix(raw + np.arange(1, len(table) + 1, dtype=U64) * U64(_BASE))


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
