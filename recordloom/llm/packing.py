"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit-decreasing with a segment tree over remaining capacities. Piece
lengths are whole numbers up to the capacity, so the corpus is packed from its
length histogram (at most ``capacity`` rows on the driver): the plan is exactly
that of placing all pieces one by one. Each piece then finds its place from its
length and its rank within that length, counted in two levels.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bestfit import plan_by_class
from .kernel import slices
from .state import bounded_batches, cut_lineage

CAPACITY = 2048
END_ID = 0
#: Distinct words whose ids a worker keeps, some 200 bytes each; at the bound it starts anew.
WORDS_KEPT = 1_000_000

_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


#: Lower-casing of A-Z, and punctuation right after a letter or digit, which gets a space before it.
#: The tokenizer lower-cases and cuts there anyway, so both leave the ids as they are and make fewer distinct words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = re.compile(rb"[.,!?;:&%#$*|](?<=(?:[ -~][a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]).)")


class Encoder:
    """Ids of texts, by their words: tokens never span white space, so a text's ids are those of its words in turn.

    Words new to a slice of texts are encoded together; up to WORDS_KEPT stay
    known. A text that may hold an added token, such as an end mark spelled out,
    goes to the tokenizer as a whole.
    """

    def __init__(self, path: str, keep: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.known = keep, {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes that every text with an added token holds; without such bytes every text may hold one.
        self.mark = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0].encode() if added else None

    def _odd(self, text: bytes) -> bool:
        return self.mark is not None and self.mark in text

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = words
        new = list(new)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            coded = self.tokenizer.encode([w.decode("utf-8", "replace") for w in some], is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(coded.ids, "<u4")
            first = np.searchsorted(np.asarray(coded.word_ids, np.int64), np.arange(len(some) + 1)) * 4
            raw = ids.tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(some, first[:-1].tolist(), first[1:].tolist(), strict=True))

    def encode(self, texts: list[bytes], end_id: int = END_ID) -> list[bytes]:
        """For each UTF-8 text its ids and the end id, as little-endian unsigned 32-bit numbers."""
        odd = [self._odd(t) for t in texts]
        split = [[] if o else _EDGE.sub(rb" \g<0>", t.translate(_LOWER)).split() for t, o in zip(texts, odd, strict=True)]
        self.learn(set().union(*split))
        end, known = end_id.to_bytes(4, "little"), self.known
        out = [b"".join(map(known.__getitem__, words)) + end for words in split]
        for i, text in enumerate(texts):
            if odd[i]:
                out[i] = np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes() + end
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, keep: int = WORDS_KEPT) -> Encoder:
    if (path, keep) not in _encoders:
        _encoders[path, keep] = Encoder(path, keep)
    return _encoders[path, keep]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS_KEPT) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: id, piece, start, length, ids_crc32 and, if asked, ids.

    A null text is empty: its only id is the end id. Rows with equal or null ids
    each give pieces of their own. The tokenizer file is read from ``tokenizer``
    on each executor.
    """
    source = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    fields = [source.schema["doc_id"], *_PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in slices(batch.column(1)):
                raw, owner, rows, ids = data.tobytes(), [], [], []
                texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for i, coded in enumerate(encoder(tokenizer, words_kept).encode(texts, end_id)):
                    for k, first in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[first : first + 4 * capacity]
                        owner.append(at + i)
                        rows.append((k, first // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
                columns += [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; a reserved name of an input column is replaced.

    Which of several equally long pieces gets which place follows ``order``
    within a cell of rows. An empty input gives no rows.
    """
    reserved = ("_cell", "_rank", "sequence_id", "offset")
    held = cut_lineage(pieces.drop(*reserved).withColumn("_cell", F.spark_partition_id()))
    histogram = {int(r[0]): int(r[1]) for r in held.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("a piece's length is outside 1 to the capacity")
    plan, _ = plan_by_class(histogram, capacity)
    table = np.array(plan, np.int64).reshape(-1, 5)
    keys = table[:, 0] << 44 | table[:, 1]
    sort = np.argsort(keys)
    # Bounded by the square of the capacity; the usual length is some thousands of rows.
    shared = held.sparkSession.sparkContext.broadcast((keys[sort], table[sort]))
    before = W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = held.groupBy("_cell", "length").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy("_cell", "length").orderBy(*[c for c in order if c in held.columns])
    ranked = held.withColumn("_local", F.row_number().over(within)).join(starts, ["_cell", "length"])
    names = [c for c in held.columns if c != "_cell"]
    ranked = ranked.select(*names, (F.col("_start") + F.col("_local") - 1).cast("long").alias("_rank"))
    schema = T.StructType([*(ranked.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, size << 44 | rank, side="right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            gone = rank - row[:, 1]
            each = np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(row[:, 2] + gone // each), pa.array(row[:, 4] + gone % each * size)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS_KEPT) -> DataFrame:
    """Documents to packed pieces; see token_pieces and pack."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col, words_kept), capacity)
