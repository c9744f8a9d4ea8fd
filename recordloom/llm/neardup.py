"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds its distinct k-word shingles (64-bit hashes). Documents
with equal sets form a class, which its least id represents. Bands of a
representative's signature put it into buckets. At 6 rows and 48 bands, two sets
of Jaccard similarity 0.8 share no bucket with a probability of 5e-7.

Within a bucket, candidates form stars around its least id, never all pairs.
They are confirmed on full sets, the likeliest edge of each member first, and
components of confirmed links are contracted. Where members of a bucket are then
still in several components, the buckets that share members form a block. In a
block every document outside its largest component is compared with all others
of the block, in tiles of bounded size: an inverted index over a tile's shingles
counts the intersections, and only links leave the task. So no link between
documents that share a bucket is lost, and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, OnePermutation, list_array, mix, shingle_sets, word_slices
from .state import HOT, bounded_batches, cut_lineage, discard, hot_keys, join_hot

BANDS, ROWS = 48, 6
#: Documents and bytes of shingle hashes in one side of a tile, about.
TILE_ROWS, TILE_BYTES = 256, 4 << 20
#: Pairs of one centre that are confirmed together, at least.
PAIRS = 2000


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set in two parts, and the hashes of its bands."""
    hasher = OnePermutation(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in word_slices(batch.column(1), SPACED, lower=True):
                n = len(words)
                counts, one, two, flat, lengths = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), [], np.zeros(n, np.int64)
                for i, hashes in enumerate(shingle_sets(words, k)):
                    if len(hashes):
                        counts[i], lengths[i] = len(hashes), bands
                        one[i], two[i] = hashes.sum(dtype=np.uint64), mix(hashes).sum(dtype=np.uint64)
                        flat.append(hasher.bands(hasher.signature(hashes), rows))
                values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(counts), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), list_array(values.view(np.int64), lengths, pa.int64())], names=["doc_id", "n_shingles", "one", "two", "bands"]
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, one long, two long, bands array<long>")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress((x.as_py() or "").encode()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["rep", "packed"])


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([expand.decompress(x.as_py()).decode() for x in batch.column(1)], pa.large_string())
            for at, words in word_slices(texts, SPACED, lower=True):
                sets = list(shingle_sets(words, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "n", "hashes"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * |intersection| >= percent * |union|, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    # A centre may have a third of all documents: such pairs are dealt over copies of its set.
    count = pairs.count()
    most = max(PAIRS, count // HOT)
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    hubs = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("a", F.ceil(F.col("m") / most).alias("lots"))) if count > PAIRS else None
    if hubs is None or hubs.isEmpty():
        dealt, left = pairs.select("a", "b", F.lit(0).alias("lot")), left.withColumn("lot", F.lit(0))
    else:  # fewer than HOT rows
        dealt = pairs.join(F.broadcast(hubs), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("lots", F.lit(1))).alias("lot"))
        left = left.join(F.broadcast(hubs), "a", "left").select("a", "na", "ha", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    joined = dealt.join(right, "b").join(left, ["a", "lot"]).where(100 * small >= percent * large)
    return cut_lineage(joined.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"))


def _links_of(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of a tile's documents to the components of its others: one for each document and component."""
    outer = np.array(table.column("outer").to_pylist(), bool)
    reps, comps = (table.column(c).to_numpy() for c in ("rep", "comp"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    own, others = np.flatnonzero(outer), np.flatnonzero(~outer)
    sizes = np.array([len(sets[i]) for i in others], np.int64)
    every = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in others)])
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    a, b = [], []
    for i in own:
        first, last = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        count = last - first
        place = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        common = np.bincount(owner[place], minlength=len(others))
        hit = np.flatnonzero((100 * common >= percent * (sizes + len(sets[i]) - common)) & (comps[others] != comps[i]))
        hit = hit[np.unique(comps[others[hit]], return_index=True)[1]]
        a += [int(reps[i])] * len(hit)
        b += reps[others[hit]].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _within_blocks(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among rows (low, rep, comp), low being the least component of a bucket of rep."""
    blocks = components(open_.where("low <> comp").select(F.col("low").alias("a"), F.col("comp").alias("b")).distinct()).toDF("comp", "block")
    held = open_.select("rep", "comp").distinct().join(blocks, "comp").join(sets.select("rep", "n"), "rep")
    held = cut_lineage(held)
    parts = held.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    whole = parts.groupBy("block").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.max(F.struct("m", "comp", "size")).alias("most"), F.sum("m").alias("m"), F.sum("size").alias("size"))

    def tiles(rows, size):
        return F.ceil(F.greatest(rows / TILE_ROWS, size * 8 / TILE_BYTES, F.lit(1.0))).cast("long")

    whole = whole.select("block", "major", tiles(F.col("m") - F.col("most.m"), F.col("size") - F.col("most.size")).alias("outers"), tiles(F.col("m"), F.col("size")).alias("inners"))
    held = held.join(whole, "block").withColumn("lot", F.abs(F.xxhash64("rep")))
    outer = held.where("comp <> major").select("block", "rep", "comp", F.lit(True).alias("outer"), (F.col("lot") % F.col("outers")).alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("inners") - 1)).alias("i"))
    inner = held.select("block", "rep", "comp", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("outers") - 1)).alias("o"), (F.col("lot") % F.col("inners")).alias("i"))
    laid = outer.union(inner).join(sets.select("rep", "hashes"), "rep")
    return cut_lineage(laid.groupBy("block", "o", "i").applyInArrow(lambda table: _links_of(table, percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over links (a, b), by label propagation and pointer jumping.

    Nodes with many links, and labels that many nodes have, are joined apart.
    """
    ways = cut_lineage(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).where("node <> to").distinct())
    hubs = hot_keys(ways.groupBy("to").agg(F.count(F.lit(1)).alias("m")), ["to"], ways.count())
    labels = cut_lineage(ways.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")))
    nodes = labels.count()
    while True:
        heard = join_hot(ways, labels.withColumnRenamed("node", "to"), ["to"], hubs).groupBy("node").agg(F.min("label").alias("heard"))
        near = cut_lineage(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near")))
        common = hot_keys(near.groupBy("near").agg(F.count(F.lit(1)).alias("m")), ["near"], nodes)
        above = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        before, labels = labels, cut_lineage(join_hot(near, above, ["near"], common).select("node", "old", F.least("near", "far").alias("label")))
        done = labels.where("label < old").isEmpty()
        discard(near, before)
        if done:
            discard(ways)
            return labels.select("node", "label")


def _relabel(known: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (rep, comp) after more links; None while there are none."""
    if links.isEmpty():
        return known
    if known is None:
        return components(links).toDF("rep", "comp")
    a, b = known.toDF("a", "ca"), known.toDF("b", "cb")
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(lifted).toDF("comp", "top")
    moved = known.join(merged, "comp", "left").select("rep", F.coalesce("top", "comp").alias("comp"))
    new = merged.toDF("rep", "comp").join(known.select("rep"), "rep", "left_anti")
    return cut_lineage(moved.unionByName(new))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if labels is None:
        return pairs
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A null,
    empty or blank text has an empty set and is linked with nothing. Rows that
    repeat an id are each judged by their own set, and links name them by the
    id. A row without an id is its own
    component (component_id null) and kept. component_id is the least id
    reachable over links; ``kept`` marks the row with that id. An empty table
    gives no rows; other columns are ignored.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(_signatures(source, k, bands, rows))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(usable.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count(F.lit(1)).alias("m")))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = cut_lineage(banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    crowded = hot_keys(shared, ["band"], bands * classes.count())
    members = cut_lineage(join_hot(banded, shared.drop("m"), ["band"], crowded))

    active = members.select("rep").distinct()
    sets = cut_lineage(source.where("doc_id is not null").mapInArrow(_packed, "rep long, packed binary").join(active, "rep", "left_semi").mapInArrow(_set_maker(k), "rep long, n long, hashes binary"))

    stars = cut_lineage(members.where("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("c")))
    # First each member's likeliest centre only, then the star edges that still lead to another component.
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    labels = _relabel(None, _confirmed(best, sets, percent))
    rest = _across(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), labels)
    labels = _relabel(labels, _confirmed(rest, sets, percent))

    # A centre has met all others of its bucket; what remains is between those.
    open_ = _labelled(members.where("rep <> centre").select("band", "rep"), labels)
    mixed = open_.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").drop("high")
    open_ = cut_lineage(join_hot(open_, mixed, ["band"], crowded).select("low", "rep", "comp").distinct())
    if not open_.isEmpty():
        labels = _relabel(labels, _within_blocks(open_, sets, percent))

    # A label is the least representative, and a representative the least id of its class.
    named = cut_lineage(_labelled(classes.select("one", "two", "rep", "m"), labels))
    copied = hot_keys(named, ["one", "two"], signed.count())
    linked = join_hot(usable.drop("bands"), named.select("one", "two", "comp"), ["one", "two"], copied)
    alone = signed.drop("bands").where("n_shingles = 0 or doc_id is null").withColumn("comp", F.col("doc_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each near-duplicate component; all their columns stay, ``_row`` is reserved.

    Rows are told apart by a number of their own, not by id: of rows with one id
    and different texts each is judged by its text, and repeated rows leave one.
    The row with the least id stays, a null id coming last, then the first read.
    Rows whose text is null, empty or blank all stay.
    """
    held = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = cut_lineage(near_duplicates(held, k, percent, id_col="_row", text_col=text_col).withColumnRenamed("doc_id", "_row"))
    several = found.where("_row <> component_id").select("component_id").distinct()
    crowds = hot_keys(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")), ["component_id"], found.count())
    in_groups = join_hot(found.select("component_id", "_row"), several.withColumn("_several", F.lit(True)), ["component_id"], crowds)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    chosen = in_groups.join(held.select("_row", id_col), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    gone = in_groups.join(chosen.select(F.col("first.row").alias("_row")), "_row", "left_anti").select("_row")
    return held.join(gone, "_row", "left_anti").select(*docs.columns)
