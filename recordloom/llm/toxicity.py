"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, maps homoglyphs of Latin letters and digits that stand for
letters. Lexicon entries are word beginnings, and whole words where those are
shorter. Their weights, and entries beyond the seeds, come from labelled texts:
word beginnings are counted by label, those with a high likelihood ratio are
candidates, and a cover of the toxic texts that spares clean ones is picked. A
match inside an exception phrase does not count. The sum of weights, as it is
and relative to the length, enters a logistic score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE_ROWS, held_out, training_rows
from .state import bounded_batches, cut_lineage, discard

# Look-alikes of Latin letters, digits used as letters, seeds and exceptions.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁɡһкмтвнαεοριυνκτ", "aeopcyxijsdghkmtbhaeopiuvkt", strict=True))
DIGITS = dict(zip("0134579@", "oieastga", strict=True))
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "imbecile", "bastard")
EXCEPTIONS = ("trash can", "trash bin", "trashcan", "clownfish", "clown fish", "idiot proof", "idiotproof", "sore loser policy")
FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD))
#: Marks an entry that is a whole word, not a word's beginning.
WHOLE = "$"

_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


class Lexicon:
    """Word beginnings with weights, and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], coefficients: tuple[float, ...] = (-3.0, 2.0, 0.5), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.coefficients, self.exceptions = weights, coefficients, exceptions
        self._automaton = None

    def __reduce__(self):
        return Lexicon, (self.weights, self.coefficients, self.exceptions)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton, known = ahocorasick.Automaton(), {}
            for phrase in map(fold, self.exceptions):
                known[phrase] = [len(phrase), True, None, None]
            for entry in self.weights:
                word = entry.rstrip(WHOLE)
                known.setdefault(word, [len(word), False, None, None])[3 if entry.endswith(WHOLE) else 2] = entry
            for word, found in known.items():
                if word:
                    self._automaton.add_word(word, tuple(found))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) of entries that begin a word, outside exception phrases; in order of their starts, then ends.

        A match is spared where one exception phrase holds it: of the phrases that
        begin no later, the furthest end decides, which one sweep keeps track of.
        """
        if not len(self.automaton()):
            return []
        spared, found = [], []
        for end, (size, exception, beginning, word) in self.automaton().iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            if exception:
                spared.append((start, end))
            if beginning is not None:
                found.append((start, end, beginning))
            if word is not None and not (end + 1 < len(folded) and folded[end + 1].isalpha()):
                found.append((start, end, word))
        if not spared:
            return [(s, entry) for s, _, entry in sorted(found)]
        spared.sort()
        out, reach, at = [], -1, 0
        for start, end, entry in sorted(found):
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if end > reach:
                out.append((start, entry))
        return out

    def features(self, text: str) -> tuple[float, float]:
        """(log of 1 + weight, weight for each 100 words)."""
        total = sum(self.weights[entry] for _, entry in self.matches(fold(text)))
        return (math.log1p(total), min(20.0, 100 * total / max(1, text.count(" ") + text.count("\n") + 1))) if total else (0.0, 0.0)

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _beginnings(folded: str, shortest: int, longest: int) -> set[str]:
    words = set(_WORD.findall(folded))
    return {w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)} | {w + WHOLE for w in words if 1 < len(w) < shortest}


def _counter(shortest: int, longest: int):
    """Word beginnings with the numbers of toxic and clean texts that have them, summed over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def told():
            names = list(toxic.keys() | clean.keys())
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([toxic[x] for x in some], pa.int64()), pa.array([clean[x] for x in some], pa.int64())], names=["entry", "toxic", "clean"])
            toxic.clear()
            clean.clear()

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_beginnings(fold(text), shortest, longest))
                if len(toxic) + len(clean) > 500_000:
                    yield from told()
        yield from told()

    return run


def _ratio(n1: int, n0: int):
    """The log-likelihood ratio of an entry in ``toxic`` of n1 toxic and ``clean`` of n0 clean texts, as a column."""

    def term(k, n):
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    a, b, n = F.col("toxic"), F.col("clean"), F.lit(n1 + n0)
    one, two = F.lit(n1), F.lit(n0)
    return term(a, one) + term(one - a, one) + term(b, two) + term(two - b, two) - term(a + b, n) - term(n - a - b, n)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, shortest: int = 4, longest: int = 8, ratio: float = 6.0) -> Lexicon:
    """A lexicon from labelled documents; without both labels in the sample, the seeds at weight 1.

    At most ``rows`` labelled documents are the sample. Entries are beginnings of
    ``shortest`` to ``longest`` letters and whole words of fewer, at least two;
    all with a log-likelihood ratio above ``ratio`` that lean to toxic texts four
    to one are candidates, however many there are.
    """
    sample = cut_lineage(training_rows(docs, labels, "toxic", rows))
    try:
        sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            return Lexicon({fold(s): 1.0 for s in SEEDS})
        counts = sample.mapInArrow(_counter(shortest, longest), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        strong = counts.where((F.col("toxic") >= 3) & (F.col("toxic") * n0 > 4 * F.col("clean") * n1) & (_ratio(n1, n0) > ratio))
        best = {r["entry"] for r in strong.select("entry").collect()} | {fold(s) for s in SEEDS}  # from the sample's words
        probe = Lexicon(dict.fromkeys(sorted(best), 1.0))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted({e for _, e in probe.matches(fold(t))}) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["entries", "label"])

        seen = [(set(r[0]), r[1]) for r in sample.mapInArrow(met, "entries array<string>, label int").collect()]  # a row per sampled document
        weights = {}
        for entry in _cover(seen, n1) | {fold(s) for s in SEEDS}:
            a, b = sum(label for found, label in seen if entry in found), sum(1 - label for found, label in seen if entry in found)
            weights[entry] = max(0.0, min(5.0, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)))) if a + b else 1.0
        model = Lexicon({e: w for e, w in sorted(weights.items()) if w > 0})

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.array([model.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1]), batch.column(1)], names=["x", "y", "label"])

        points = np.array(sorted(tuple(r) for r in sample.mapInArrow(measured, "x double, y double, label int").collect()), float)
        return Lexicon(model.weights, _logistic(points[:, :2], points[:, 2]))
    finally:
        discard(sample)


def _cover(texts: list[tuple[set[str], int]], toxic: int) -> set[str]:
    """Entries picked one by one for the toxic texts that they add, less three times the clean texts; of equals the longest, then the last.

    An entry's gain only falls as others are picked, so one whose gain, taken
    anew, still leads the heap is the best.
    """
    by_entry: dict[str, set[int]] = {}
    for i, (entries, _) in enumerate(texts):
        for e in entries:
            by_entry.setdefault(e, set()).add(i)
    clean = {e: sum(1 - texts[i][1] for i in rows) for e, rows in by_entry.items()}
    adds = {e: {i for i in rows if texts[i][1]} for e, rows in by_entry.items()}

    def rank(e: str, gain: int) -> tuple:
        return -gain, -len(e), tuple(-ord(c) for c in e), e

    heap = [rank(e, len(rows) - 3 * clean[e]) for e, rows in adds.items()]
    heapq.heapify(heap)
    covered: set[int] = set()
    chosen: set[str] = set()
    least = max(2, toxic // 500)
    while heap:
        gain, *_, entry = heap[0]
        adds[entry] -= covered
        now = len(adds[entry]) - 3 * clean[entry]
        if now < -gain:
            heapq.heapreplace(heap, rank(entry, now))
            continue
        if now < least:
            break
        heapq.heappop(heap)
        chosen.add(entry)
        covered |= adds[entry]
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps for a ridge-penalised logistic regression; the intercept is free, slopes are not negative."""
    design = np.column_stack((np.ones(len(x)), x))
    beta, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta = np.clip(beta + step, [-30, 0, 0], [30, 30, 30])
    return tuple(float(b) for b in beta)


def scores(docs: DataFrame, model: Lexicon, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text counts as empty and has the score of a text without matches; a
    null id is not held out. Whole texts are matched. An empty table gives no
    rows; other columns are ignored.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([model.score(t.as_py() or "") for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, model: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns; a null text counts as empty."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
