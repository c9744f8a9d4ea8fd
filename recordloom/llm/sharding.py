"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that one shard holds. Groups sorted by
size enter the tightest bin through a balanced tree, either at the least
capacity that needs no more bins than shards, so shard sizes are near equal
(law ``bytes``), or at a fixed capacity, so there are few shards.

Groups of one size are interchangeable, so all of them are packed from their
exact size histogram: the plan is that of placing the groups one by one. Each
group finds its shard from its size and its rank within that size. Distinct
sizes that add up to T bytes number at most sqrt(2 T), and that bounds what the
driver holds; the number of groups does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bestfit import TreeStore, fewest_capacity, plan_by_class
from .state import cut_lineage, hot_keys, join_hot

#: Rows that one task numbers within a shard or a size, about.
CELL_ROWS = 50_000


def _numbered(rows: DataFrame, within: str, cell: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: gapless places from 0 within each value of a column, counted by cell and then inside the cell."""
    rows = rows.withColumn("_cell", cell)
    before = W.partitionBy(within).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(within, "_cell").agg(F.count(F.lit(1)).alias("_n")).select(within, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(within, "_cell").orderBy(*order)
    placed = rows.withColumn("_rank", F.row_number().over(inside)).join(starts, [within, "_cell"])
    return placed.withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_cell", "_rank", "_start")


def _cells(rows: int, parts: int) -> int:
    return max(8, -(-rows // (parts * CELL_ROWS)))


def _placed(rows: DataFrame, shards: int, capacity: int | None) -> DataFrame:
    """Adds ``shard`` to rows with ``size`` and ``_group``."""
    groups = cut_lineage(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")))
    histogram = {int(r["_bytes"]): int(r["count"]) for r in groups.groupBy("_bytes").count().collect()}  # a row per distinct size
    plan, _ = fewest_capacity(histogram, shards) if capacity is None else plan_by_class(histogram, capacity, TreeStore())
    ends: dict[int, int] = {}
    runs = []
    for size, rank, first, each, _ in reversed(plan):  # a run ends where the next of its size begins
        runs.append((size, rank, ends.get(size, histogram[size]), first, each))
        ends[size] = rank
    table = cut_lineage(rows.sparkSession.createDataFrame(runs, "_bytes long, _from long, _to long, _first long, _each long"))
    count = sum(histogram.values())
    ranked = _numbered(groups, "_bytes", F.pmod(F.hash("_group"), F.lit(_cells(count, 1))), ["_group"], "_place")
    found = ranked.join(table, (ranked["_bytes"] == table["_bytes"]) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to")))
    shard = F.col("_first") + F.expr("(_place - _from) div _each")
    found = cut_lineage(found.select("_group", "_rows", shard.cast("int").alias("shard")))
    # A group of copies may hold a third of all rows.
    hot = hot_keys(found, ["_group"], rows.count(), "_rows")
    return join_hot(rows, found.drop("_rows"), ["_group"], hot)


def shard_documents(docs: DataFrame, shards: int = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    With ``capacity`` shards hold at most so many bytes, their number is what
    best fit needs, and ``shards`` is not used. A null text counts as an empty
    one (size 1, CRC 0) and groups with empty texts. A null or repeated id is a
    row like others; slots order by id within a cell of rows. A group larger
    than a shard's fair share, or than the capacity, fills a shard alone and
    makes it larger: it is never split. An empty table gives no rows. Other
    columns are ignored.
    """
    return _sharded(docs, shards, capacity, id_col, text_col).drop("_row", "_group")


def _sharded(docs: DataFrame, shards: int, capacity: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("_row") if "_row" not in docs.columns else F.col("_row"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("_group"),
        )
    )
    placed = cut_lineage(_placed(rows, shards, capacity))  # two passes number it
    cells = _cells(rows.count(), shards)
    slotted = _numbered(placed, "shard", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(cells)), ["doc_id", "_row"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "_row", "_group")


def write_shards(docs: DataFrame, path: str, shards: int = 16, capacity: int | None = None) -> None:
    """Writes all documents as Parquet, one folder per shard, in slot order within a file; a column ``shard`` is replaced.

    Rows are told apart by a number of their own, so null and repeated ids stay.
    """
    held = cut_lineage(docs.drop("shard", "_row").withColumn("_row", F.monotonically_increasing_id()))
    places = _sharded(held, shards, capacity).select("_row", "shard", F.col("slot").alias("_slot"))
    held.join(places, "_row").sortWithinPartitions("shard", "_slot").drop("_row", "_slot").write.partitionBy("shard").mode("error").parquet(path)
