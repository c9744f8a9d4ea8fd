import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recordloom.llm.packing import pack_documents

from .helpers import documents, family_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's don't we'll, 'S 's!", "Été, ÉTÉ. naïve x", "é, é.", "<|endoftext|> a<|endoftext|>b", "x <|startoftext|>", "<|ENDOFTEXT|> <| endoftext|>", "<|endoftext|" + "<|endoftext|>" * 3 + " It's", "a b\x85c", "日本語 テスト。", "İstanbul ΣΑΣ ς", "...,,,!!! a.b,c;d", "12,345.67%", "\U0001f600!?", "ﬁne ﬂy", "a" * 3000, " ", "x,́ y", "é!é,"]


def check(spark, texts, ids=None, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    rows = pack_documents(documents(spark, texts, ids), PATH, capacity, with_ids=True).collect()
    want = {}
    for i, text in enumerate(texts):
        coded = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(coded), capacity)):
            part = coded[at : at + capacity]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()), part.tolist())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in rows} == want
    at, total = {}, sum(r.length for r in rows)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in at.values())
    return len(at), total


def test_ids_and_places(spark):
    check(spark, [*family_texts(9), *ODD])
    bins, total = check(spark, family_texts(9), capacity=50)
    assert bins <= -(-total // 50) * 1.05 + 1


def test_edges(spark):
    assert pack_documents(documents(spark, []), PATH).count() == 0
    assert check(spark, [None, "", "  "]) == (1, 3)
    rows = pack_documents(documents(spark, ["a b", "a b", "c"], [5, 5, None]).withColumnRenamed("lang", "offset"), PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 2), (5, 3), (5, 3)]
