import random
import time

import numpy as np
import pyarrow as pa

from recordloom.llm import quality, toxicity
from recordloom.llm.labelled import held_out

from .helpers import documents, sentence


def test_folding_matches_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0})
    assert [e for _, e in lexicon.matches(toxicity.fold("An 1D10T, іdіоt; ＩＤＩＯＴ id​iot idiotic"))] == ["idiot"] * 5
    assert lexicon.matches(toxicity.fold("preidiot, empty the trash can")) == []
    assert lexicon.score("you idiot") > lexicon.score("you idiot" + " word" * 500) > lexicon.score("word")
    assert toxicity.Lexicon({}, exceptions=()).matches("idiot") == []


def naive_matches(lexicon, folded):
    """Entries at word starts, by trying all at each place, unless a phrase that starts no later ends no earlier."""
    phrases = [toxicity.fold(p) for p in lexicon.exceptions]
    starts = [i for i in range(len(folded)) if not i or not folded[i - 1].isalpha()]
    spared = [(i, i + len(p)) for i in starts for p in phrases if folded.startswith(p, i)]
    out = []
    for i in starts:
        for entry in lexicon.weights:
            word = entry.rstrip("$")
            end = i + len(word)
            if folded.startswith(word, i) and not (entry.endswith("$") and folded[end : end + 1].isalpha()) and not any(a <= i and end <= b for a, b in spared):
                out.append((i, end, entry))
    return [(i, e) for i, _, e in sorted(out)]


def test_matches_are_those_of_a_naive_search():
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"idiot": 2.0, "idio": 1.0, "trash": 1.0, "trashcan": 3.0, "bad$": 1.0, "ba$": 1.0, "can": 1.0}, exceptions=("trash can", "trashcan", "idiot proof", "proof"))
    parts = ["idiot", "idiotic", "trash", "can", "cans", "trashcan", "bad", "badly", "ba", "proof", "tr4sh", "1diot", " ", " ", "  ", ".", "é", "b a d"]
    for _ in range(500):
        folded = toxicity.fold("".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randrange(12))))
        assert lexicon.matches(folded) == naive_matches(lexicon, folded), folded


def test_matching_time_grows_with_the_text():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0})

    def seconds(n):
        text = "idiot trash can " * n
        began = time.perf_counter()
        assert len(lexicon.matches(text)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.02)


def labelled(spark, seed=1, n=600):
    rng = random.Random(seed)
    texts, toxic, good = [], [], []
    for _ in range(n):
        words = sentence(rng, rng.randrange(20, 80))
        bad, junk = rng.random() < 0.2, rng.random() < 0.3
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), "grolm" + rng.choice(("a", "en", "ix")))
        texts.append(" ".join(w.upper() + "&&&" for w in words) if junk else " ".join(words) + ".")
        toxic.append(int(bad))
        good.append(int(not junk))
    labels = spark.createDataFrame(list(zip(range(n), good, toxic, strict=True)), "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels, good, toxic


def plain_cover(texts, toxic):
    left, chosen, covered = {e for found, _ in texts for e in found}, set(), set()
    while left:
        gain = {e: sum(label for i, (found, label) in enumerate(texts) if e in found and i not in covered) - 3 * sum(1 - label for found, label in texts if e in found) for e in left}
        best = max(left, key=lambda e: (gain[e], len(e), e))
        if gain[best] < max(2, toxic // 500):
            break
        chosen.add(best)
        left.remove(best)
        covered |= {i for i, (found, label) in enumerate(texts) if best in found and label}
    return chosen


def test_cover_with_ties_is_that_of_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        texts = [({rng.choice(("aa", "ab", "ba", "aba", "bb", "abb")) for _ in range(rng.randrange(4))}, int(rng.random() < 0.8)) for _ in range(rng.randrange(30))]
        toxic = sum(label for _, label in texts)
        assert toxicity._cover(texts, toxic) == plain_cover(texts, toxic)


def test_held_out_accuracy(spark):
    docs, labels, good, toxic = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any(e.startswith("grol") for e in model.weights)
    for rows, truth, kind in ((toxicity.scores(docs, model), toxic, "toxic"), (quality.scores(docs, quality.fit(docs, labels)), good, "quality")):
        rows = rows.where("held_out").collect()
        assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.97, kind
        assert all(0 <= r.score <= 1 for r in rows) and 60 < len(rows) < 180


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, quality.FACTORS)), rng.normal(size=quality.STATS), rng.normal(size=(quality.STATS, quality.FACTORS)), np.zeros(quality.STATS), np.ones(quality.STATS))
    (_, slots, n, table), = quality.features(pa.array(["some words in a text, some"]))
    x = np.concatenate((np.full(n[0], machine.value(n)[0]), table[0]))
    w = np.concatenate((machine.slots[slots], machine.stats))
    v = np.concatenate((machine.factors[slots], machine.stat_factors))
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert np.isclose(machine.raw(slots, n, table)[0], 0.3 + w @ x + pairs)


def test_edges(spark):
    docs, labels, _, _ = labelled(spark, n=30)
    none = labels.limit(0)
    odd = documents(spark, [None, "", "x" * 300_000, "a b"], [1, 1, None, 3]).withColumnRenamed("lang", "score")
    for module in (toxicity, quality):
        model = module.fit(docs, none)
        rows = module.scores(odd, model).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and module.scores(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.selectExpr("doc_id", "cast(null as int) quality", "toxic")) is None
    assert [r[0] for r in odd.select(held_out()).collect()].count(False) >= 1
