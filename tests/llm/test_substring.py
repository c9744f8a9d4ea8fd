import random

from recordloom.llm.substring import COVERS, remove_repeats

from .helpers import documents, family_texts, sentence, sha, tie


def brute(rows, window):
    """rows: (id, text) in order of id."""
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                gone[at : at + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((i, len(words), sum(gone), sha(kept), kept))
    return out


def test_matches_brute_force(spark):
    texts = family_texts(2)
    rng = random.Random(3)
    passage = sentence(rng, 25)
    for n in (0, 1, 2, 5, 11, 12, 13, 40):
        texts.append(" ".join(sentence(rng, n) + passage[: rng.choice((19, 20, 21, 25))] + sentence(rng, n)))
    texts.append(" ".join(["same"] * 70))
    for window in (20, 9, 5):
        rows = remove_repeats(documents(spark, texts), window).orderBy("doc_id").collect()
        assert [tuple(r) for r in rows] == brute(list(enumerate(texts)), window)


def test_repeated_and_null_ids_very_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    long = " ".join(sentence(rng, 30_000, 10**6))
    texts = [*family_texts(5, families=3), long, long]
    ids = [rng.choice((None, 1, 2, i)) for i in range(len(texts))]
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, tie(texts[i])))
    want = brute([(ids[i], texts[i]) for i in order], 20)
    rows = remove_repeats(documents(spark, texts, ids).withColumnRenamed("lang", "cell").withColumnRenamed("source", "tie")).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))


def test_covers():
    for modulus, cover in COVERS.items():
        assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def test_edges(spark):
    assert remove_repeats(documents(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = remove_repeats(documents(spark, [long, long, long, None], [7, 7, None, 1]), with_text=False).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == [(-1, 60_000, 0), (1, 0, 0), (7, 60_000, 60_000), (7, 60_000, 60_000)]
