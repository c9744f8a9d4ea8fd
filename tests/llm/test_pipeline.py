"""The pipeline against plain Python, stage by stage on the documents before it."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm import toxicity
from recordloom.llm.state import cut_lineage, table

from .test_decontam import words
from .test_neardup import brute as near_brute
from .test_pii import spans_of

SF = "/root/testdata/sf0.001"


def all_redacted(text):
    cuts = sorted((a, -b, k) for k, a, b, _ in spans_of(text))
    out, at = "", 0
    for start, stop, kind in cuts:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, -stop)
    return out + text[at:]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    model = toxicity.fit(docs, table(spark, SF, "labels"))
    docs = cut_lineage(stages["toxicity"](spark, docs, SF))
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == {i for i, r in before.items() if model.score(r.text or "") < 0.5}

    order = sorted(after)
    keep = {order[i] for i, _, root, kept in near_brute([after[i].text for i in order], 5) if kept}
    docs = cut_lineage(stages["near-duplicates"](spark, docs, SF))
    before, after = after, {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == keep

    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    lengths = {min(13, len(w)) for w in items if w}
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    clean = set()
    for i, r in after.items():
        own = words(r.text)
        hit = {p for n in lengths for at in range(len(own) - n + 1) if tuple(own[at : at + n]) in windows for p in range(at, at + n)}
        if not hit:
            clean.add(i)
    docs = cut_lineage(stages["decontamination"](spark, docs, SF))
    before, after = after, {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == clean and all(after[i] == before[i] for i in clean)

    docs = cut_lineage(stages["pii"](spark, docs, SF))
    before, after = after, {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and {i: r.text for i, r in after.items()} == {i: all_redacted(r.text) for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())

    packed = corpus_pipeline.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for i, r in after.items()}
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    ends = np.cumsum([p[2] for p in places])
    assert len(ends) and all(p[1] + p[2] <= 2048 for p in places)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns(spark):
    """Null texts, repeated ids and rows, and columns with names of the operators' own."""
    bench = table(spark, SF, "benchmark").where("text is not null").orderBy("item_id").first().text
    words_ = " ".join(f"w{i}" for i in range(40))
    rows = [(7, words_), (7, words_), (7, "another text under the same id"), (9, words_.upper()), (None, words_), (None, None), (3, ""), (4, f"x {bench} y"), (5, "mail a@b.cc")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "kept", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, pii string, shard int")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near-duplicates", "decontamination", "pii"):
        docs = cut_lineage(stages[name](spark, docs, SF))
        assert docs.columns[-2:] == ["pii", "shard"]
    got = sorted((r.doc_id or -1, r.text or "", r.pii) for r in docs.collect())
    assert got == sorted([(7, words_, "kept"), (7, "another text under the same id", "kept"), (-1, "", "kept"), (3, "", "kept"), (5, "mail [EMAIL]", "kept")])
