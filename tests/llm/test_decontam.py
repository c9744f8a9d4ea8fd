import random
import re

from recordloom.llm.decontam import decontaminate, keep_clean

from .helpers import documents, sentence, sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=13):
    out = []
    for i, text in enumerate(texts):
        own, hit, found = words(text), set(), set()
        for name, item in items:
            w = words(item)
            n = min(window, len(w))
            for k in range(len(w) - n + 1) if w else ():
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(str(name))
        out.append((i, len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(own), sorted(found)))
    return out


def case():
    rng = random.Random(8)
    items = [(i, " ".join(sentence(rng, n, 60))) for i, n in enumerate((40, 20, 13, 12, 5, 1, 14))] + [(7, ""), (8, "The, Été!"), (9, "...")]
    items.append((12, items[0][1]))
    texts = []
    for _ in range(40):
        body = sentence(rng, rng.choice((0, 3, 30, 300)), 60)
        source = words(rng.choice(items)[1])
        at = rng.randrange(max(1, len(source)))
        body[len(body) // 2 : len(body) // 2] = source[at : at + rng.choice((12, 13, 14, 40))]
        texts.append(rng.choice((" ", ", ", "-")).join(body).upper())
    return texts + ["the été", "THE? \n ÉTÉ", None, "", "!!!"], items


def test_matches_brute_force_in_one_and_several_passes(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    for size in (1 << 20, 200):
        rows = decontaminate(docs, bench, block_bytes=size).orderBy("doc_id").collect()
        assert [tuple(r) for r in rows] == brute(texts, items)


def test_edges(spark):
    bench = spark.createDataFrame([(None, "a b"), (1, None)], "item_id long, text string")
    docs = documents(spark, ["a b", None], [None, 3])
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, bench).collect()) == [(0, 0, False), (2, 0, False)]
    assert decontaminate(documents(spark, []), bench).count() == 0


def test_repeated_rows_very_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    item = " ".join(sentence(rng, 20, 60))
    long = " ".join(sentence(rng, 60_000, 10**6)) + " " + item
    texts, ids = [item, item, f"x {item} y", long, "clean text", None], [4, 4, 4, 7, None, 7]
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    docs = documents(spark, texts, ids).withColumnRenamed("lang", "items").withColumnRenamed("source", "cover")
    want = [(i, *row[1:]) for i, row in zip(ids, brute(texts, [(1, item)]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in decontaminate(docs, bench).collect()))) == sorted(map(repr, want))
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 7]
    assert sorted(r.doc_id or -1 for r in keep_clean(docs, bench, percent=5).collect()) == [-1, 7, 7]  # a twentieth of the long text is more than the item
