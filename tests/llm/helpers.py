"""Small inputs and brute-force versions."""

import hashlib
import random

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tie(text):
    """Spark's xxhash64 of a string."""
    value = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def sentence(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def family_texts(seed, families=12, copies=6, length=60):
    """Originals, edited copies at varying distance, exact copies, and shared passages."""
    rng, out = random.Random(seed), []
    passage = sentence(rng, 30)
    for _ in range(families):
        base = sentence(rng, length)
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                at = rng.randrange(len(words))
                words[at:at] = passage
            out.append(" ".join(words))
    return out + [None, "", " \t\n", "One", "one", "one two", out[0], out[0].upper()]
