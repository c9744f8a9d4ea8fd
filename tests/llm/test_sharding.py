import random
import zlib
from collections import Counter, defaultdict

import hypothesis.strategies as st
from hypothesis import given, settings

from recordloom.llm.bestfit import BinTree, CapacityTree, best_fit_decreasing, fewest_capacity, plan_by_class
from recordloom.llm.sharding import shard_documents, write_shards

from .helpers import documents


def plain_best_fit(sizes, capacity):
    room, place = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            i = len(room)
            room.append(max(capacity, s))
        room[i] -= s
        place.append(i)
    return len(room), sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(10, 40))
def test_best_fit_forms_agree(sizes, capacity):
    bins, rooms = plain_best_fit(sizes, capacity)
    place, n = best_fit_decreasing(sizes, capacity)
    assert n == bins
    used = defaultdict(int)
    for s, p in zip(sizes, place, strict=True):
        used[p] += s
    assert all(u <= capacity or sizes.count(u) for u in used.values())
    small = [s for s in sizes if s <= capacity]
    counts = {s: small.count(s) for s in set(small)}
    plan, n = plan_by_class(counts, capacity)
    assert n == plain_best_fit(small, capacity)[0]
    where = defaultdict(list)
    for size, rank, first, each, offset in plan:
        rest = [p for p in plan if p[0] == size and p[1] > rank]
        for k in range((min((p[1] for p in rest), default=counts[size])) - rank):
            where[first + k // each].append((offset + k % each * size, size))
    assert sum(map(len, where.values())) == len(small)
    for spans in where.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= capacity


def test_trees():
    tree = BinTree()
    for key in ((5, 1), (3, 2), (9, 0)):
        tree.insert(key)
    assert [tree.pop_ceiling(4), tree.pop_ceiling(4), tree.pop_ceiling(4), tree.pop_ceiling(1)] == [(5, 1), (9, 0), None, (3, 2)]
    classes = CapacityTree(10)
    assert classes.tightest(0) is None
    classes.add(7, 2)
    assert (classes.tightest(3), classes.tightest(7), classes.tightest(8)) == (7, 7, None)
    assert fewest_capacity({5: 2, 4: 1, 3: 2}, 2)[1] == 10


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    texts = ["é" * rng.randrange(1, 300) + str(i) for i in range(400)]
    texts += [texts[0]] * 30 + [None, "", "", None]
    rows = shard_documents(documents(spark, texts), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert all(len(g) == 1 for g in groups.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 + sum(sizes.values()) // (8 * 256)
    write_shards(documents(spark, texts[:20]), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_shards_are_those_of_placing_groups_one_by_one(spark):
    rng = random.Random(3)
    texts = [None, "", "é" * 5000] + ["t" * rng.randrange(1, 60) + str(rng.randrange(400)) for _ in range(3000)]
    size = defaultdict(int)
    for t in texts:
        size[t or ""] += len((t or "").encode()) + 1
    for shards, capacity in ((16, None), (None, 4000)):
        rows = shard_documents(documents(spark, texts), shards or 16, capacity).collect()
        loads = defaultdict(int)
        for r in rows:
            loads[r.shard] += r.size
        if capacity is None:
            capacity = fewest_capacity(Counter(size.values()), shards)[1]
            assert plain_best_fit(size.values(), capacity)[0] <= shards < plain_best_fit(size.values(), capacity - max(1, capacity >> 15))[0] or capacity == max(size.values()) or sum(size.values()) > shards * (capacity - 1)
        bins, rooms = plain_best_fit(size.values(), capacity)
        assert len(loads) == bins and sorted(max(capacity, u) - u for u in loads.values()) == rooms


def test_written_shards_keep_rows_without_ids_and_long_texts(spark, tmp_path):
    docs = documents(spark, ["a", "a", None, "x" * 2_000_000, "c"], [None, None, None, 4, 4]).withColumnRenamed("lang", "size")
    write_shards(docs, str(tmp_path / "out"), 2)
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(-1, 0), (-1, 1), (-1, 1), (4, 1), (4, 2_000_000)]


def test_edges(spark):
    assert shard_documents(documents(spark, [])).count() == 0
    rows = shard_documents(documents(spark, ["a", "a", None], [1, 1, None]).withColumnRenamed("lang", "shard")).collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.size == 2}) == 1
    rows = shard_documents(documents(spark, ["big" * 1000] * 50 + ["x"] * 20), 4).collect()
    assert len({r.shard for r in rows if r.size > 9}) == 1
