"""Quality by a factorisation machine over hashed words and structure statistics.

y = b + w.x + the sum over pairs i < j of <v_i, v_j> x_i x_j. The pairwise part is
half of (sum v x)^2 - sum (v x)^2 in each factor, so a text is scored in time
linear in its words. Each word occurrence is a feature of its hashed slot, with
a value that falls with the text's length; statistics are features beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, cut, slices
from .labelled import held_out, training_rows
from .state import bounded_batches

SLOTS = 1 << 15
FACTORS = 6

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _MARK[_a:_b] = True
_CLASSES = (_UPPER, _DIGIT, _MARK, np.arange(256) >= 128, np.arange(256) == 10, np.arange(256) == 46, np.arange(256) == 44, np.arange(256) == 124)
STATS = len(_CLASSES) + 6


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, slots of all words, words of each text, statistics (texts, STATS)) for runs of texts."""
    for at, data, bounds in slices(column):
        words = cut(data, bounds, SPACED, lower=True)
        n = np.diff(words.first)
        size = np.maximum(np.diff(bounds), 1)
        table = np.empty((len(n), STATS))
        for k, member in enumerate(_CLASSES):
            table[:, k] = np.diff(np.concatenate(([0], np.cumsum(member[data])))[bounds]) / size
        last, before = (words.data[np.maximum(words.ends - j, 0)] for j in (1, 2))
        marked = np.concatenate(([0], np.cumsum(_MARK[last] & (last == before))))[words.first]
        short = np.concatenate(([0], np.cumsum(words.ends - words.starts <= 2)))[words.first]
        per = np.maximum(n, 1)
        table[:, -6] = np.diff(marked) / per
        table[:, -5] = np.diff(short) / per
        table[:, -4] = np.log1p(n) / 10
        table[:, -3] = np.minimum(size / per, 50) / 10
        table[:, -2] = [len(np.unique(words.hashes[words.of(i)])) / per[i] for i in range(len(n))]
        table[:, -1] = n == 0
        yield at, (words.hashes >> np.uint64(49)).astype(np.int32), n, table


def _segments(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, n[i] of them for text i."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.concatenate(([0], np.cumsum(n)))
    return total[ends[1:]] - total[ends[:-1]]


class Machine:
    """The trained parameters: bias, linear weights and factors of slots, and those of the statistics."""

    def __init__(self, bias, slots, factors, stats, stat_factors, mean, scale):
        self.bias, self.slots, self.factors, self.stats, self.stat_factors, self.mean, self.scale = bias, slots, factors, stats, stat_factors, mean, scale

    @staticmethod
    def value(n: np.ndarray) -> np.ndarray:
        """The value of a word occurrence in a text of n words."""
        return 1 / np.maximum(n, 1) ** 0.75

    def raw(self, slots: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
        x, s = self.value(n), (table - self.mean) / self.scale
        linear = _segments(self.slots[slots].astype(float), n) * x + s @ self.stats
        v = self.factors[slots].astype(float)
        one = _segments(v, n) * x[:, None] + s @ self.stat_factors
        two = _segments((v * v).sum(axis=1), n) * x * x + (s * s) @ (self.stat_factors**2).sum(axis=1)
        return self.bias + linear + ((one * one).sum(axis=1) - two) / 2

    def score(self, slots: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(slots, n, table), -30, 30)))


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, batch: int = 128, seed: int = 3) -> Machine:
    """From (slots, statistics, label) of each text, by Adam on the logistic loss with a small decay."""
    rng = np.random.default_rng(seed)
    stats = np.array([t[1] for t in texts])
    labels = np.array([t[2] for t in texts], float)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    machine = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.02, (SLOTS, FACTORS)), np.zeros(STATS), rng.normal(0, 0.02, (STATS, FACTORS)), mean, scale)
    machine.bias = float(np.log(share / (1 - share)))
    state = {k: (np.zeros_like(getattr(machine, k)), np.zeros_like(getattr(machine, k))) for k in ("slots", "factors", "stats", "stat_factors")}
    rate, decay, step = 0.02, 1e-4, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            slots = np.concatenate([texts[i][0] for i in some])
            n = np.array([len(texts[i][0]) for i in some])
            s, x = (stats[some] - mean) / scale, machine.value(n)
            owner = np.repeat(np.arange(len(some)), n)
            v = machine.factors[slots]
            one = _segments(v, n) * x[:, None] + s @ machine.stat_factors
            two = _segments((v * v).sum(axis=1), n) * x * x + (s * s) @ (machine.stat_factors**2).sum(axis=1)
            out = machine.bias + _segments(machine.slots[slots], n) * x + s @ machine.stats + ((one * one).sum(axis=1) - two) / 2
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[some]) / len(some)
            own = (error * x)[owner]
            grads = {
                "slots": np.bincount(slots, own, SLOTS),
                "factors": np.stack([np.bincount(slots, own * (one[owner, f] - v[:, f] * x[owner]), SLOTS) for f in range(FACTORS)], axis=1),
                "stats": s.T @ error,
                "stat_factors": s.T @ (error[:, None] * one) - ((s * s).T @ error)[:, None] * machine.stat_factors,
            }
            step += 1
            for k, g in grads.items():
                p, (first, second) = getattr(machine, k), state[k]
                g += decay * p
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            machine.bias -= rate * float(error.sum())
    machine.slots, machine.factors = machine.slots.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, slots, n, table in features(batch.column(0)):
            ends = np.concatenate(([0], np.cumsum(n)))
            raw = [slots[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in table], pa.binary()), batch.column(1).slice(at, len(n))], names=["slots", "stats", "label"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Machine | None:
    """A machine from at most ``rows`` labelled documents; None if the sample lacks one of the labels."""
    sample = training_rows(docs, labels, "quality", rows).mapInArrow(_sampled, "slots binary, stats binary, label int").collect()
    texts = sorted(((bytes(a), bytes(b), c) for a, b, c in sample))  # in an order that does not depend on partitions
    texts = [(np.frombuffer(a, np.int32), np.frombuffer(b), c) for a, b, c in texts]
    if len({t[2] for t in texts}) < 2:
        return None
    return train(texts, epochs=max(8, min(60, 40_000 // len(texts))))


def scores(docs: DataFrame, model: Machine | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text counts as empty, whose score comes from the bias and the
    statistics of an empty text. Without a model every score is 0.5. A null id
    is not held out. An empty table gives no rows; other columns are ignored.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for at, slots, n, table in features(batch.column(2)):
                values = machine.score(slots, n, table) if machine else np.full(len(n), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
