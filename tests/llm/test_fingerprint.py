import random

import hypothesis.strategies as st
import numpy as np
from hypothesis import given, settings

from recordloom.llm.fingerprint import BINS, fingerprint, fingerprints, likeness, parse, span_hashes
from recordloom.llm.kernel import OnePermutation, mix

from .helpers import documents, family_texts, sentence, sha, tie


def plain_parse(data):
    known, ends, at = set(), [], 0
    while at < len(data):
        end = at + 1
        while end < len(data) and data[at:end] in known:
            end += 1
        known.add(data[at:end])
        ends.append(end)
        at = end
    return ends


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=200).map(str.encode))
def test_parse_is_lz78(data):
    assert parse(data)[0] == plain_parse(data)


def plain_signature(data):
    """The distinct phrases of the plain parse, one-permutation minima with probes for empty bins, 16 bits of each."""
    ends = plain_parse(data)
    phrases = sorted({int(span_hashes(data, np.array(pair))[0]) for pair in zip([0, *ends], ends)})
    least = {}
    for h in phrases:
        least.setdefault((h >> 32) * BINS >> 32, h)
    hasher, out = OnePermutation(BINS), []
    for i in range(BINS if phrases else 0):
        at, attempt = i, 0
        while at not in least:
            attempt += 1
            at = int(hasher.probes(np.array([i]), attempt)[0])
        out.append(int(mix(np.array([least[at]], np.uint64))[0]) & 0xFFFF)
    return out or [0] * BINS


def plain_likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / BINS


def brute(texts, ids):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, tie(texts[i])))
    out = []
    for place, i in enumerate(order):
        text, follower = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        a, b, c = (plain_signature(t.encode()) for t in (text, edited, follower))
        out.append((ids[i], len(text), sha(edited), *("".join(f"{x:04x}" for x in s) for s in (a, b)), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(map(repr, out))


def test_matches_brute_force(spark):
    texts = [*family_texts(4, families=6), "é" * 9, "日本語の文", "a", None, "x"]
    ids = [(7 * i) % 1009 for i in range(len(texts))]
    rows = fingerprints(documents(spark, texts, ids)).collect()
    assert sorted(repr(tuple(r)) for r in rows) == brute(texts, ids)


def test_repeated_and_null_ids_very_long_texts_and_clashing_names(spark):
    rng = random.Random(2)
    texts = [*family_texts(6, families=2), " ".join(sentence(rng, 20_000, 5000))]
    ids = [rng.choice((None, None, 4, 4, 9, i)) for i in range(len(texts))]
    rows = fingerprints(documents(spark, texts, ids).withColumnRenamed("lang", "key").withColumnRenamed("source", "cell")).collect()
    assert sorted(repr(tuple(r)) for r in rows) == brute(texts, ids)


def test_edges(spark):
    assert fingerprints(documents(spark, [])).count() == 0
    (row,) = fingerprints(documents(spark, ["alone"])).collect()
    assert (row.near_next, row.edited_sha256) == (1.0, sha("aloal"))
    rows = fingerprints(documents(spark, ["a b", "a b", "c", None], [3, 3, None, 5])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == [(-1, 1), (3, 3), (3, 3), (5, 0)]
    assert likeness(fingerprint("some text of a kind " * 40), fingerprint("some text of a kind " * 40 + "and more")) > 0.7
