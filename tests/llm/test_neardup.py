import random

from recordloom.llm import state
from recordloom.llm.neardup import near_duplicates, without_near_duplicates

from .helpers import documents, family_texts, sentence


def brute(texts, k, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def test_matches_brute_force(spark):
    texts = family_texts(1)
    rows = near_duplicates(documents(spark, texts), k=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute(texts, 4)


def test_chain_of_edits_and_large_family(spark):
    """Ends of a chain are far apart, and most pairs of a large family are below the threshold."""
    rng = random.Random(5)
    words, texts = sentence(rng, 80), []
    for i in range(40):
        words = list(words)
        words[(7 * i) % 80] = f"y{i}"
        texts.append(" ".join(words))
    base = sentence(rng, 100)
    for _ in range(80):
        copy = list(base)
        for at in rng.sample(range(100), rng.choice((1, 2, 3, 4, 5))):
            copy[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = near_duplicates(documents(spark, texts), k=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute(texts, 4)


def test_edges(spark):
    empty = near_duplicates(documents(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    texts = ["a b c d e f", "a b c d e f", None, "a b c d e f"]
    rows = near_duplicates(documents(spark, texts, [4, 2, 2, None]).withColumnRenamed("lang", "bands")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (2, 2, True), (2, 2, True), (4, 2, False)]


def test_hot_keys_very_long_texts_and_clashing_names(spark, monkeypatch):
    """With small bounds every join for hot keys is taken."""
    monkeypatch.setattr(state, "FEW", 3)
    monkeypatch.setattr("recordloom.llm.neardup.PAIRS", 2)
    rng = random.Random(11)
    long = " ".join(sentence(rng, 40_000, 10**6))
    base = sentence(rng, 60)
    texts = [" ".join(base)] * 6 + [long, long + " end", None, ""]
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts).withColumnRenamed("lang", "comp").withColumnRenamed("source", "band")
    rows = near_duplicates(docs, k=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute(texts, 4)
    kept = without_near_duplicates(docs, k=4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, _, keep in brute(texts, 4) if keep})
