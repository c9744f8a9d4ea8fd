"""Trace trees: traces, spans, their lifecycle and parents, and every record as a leaf.

All evidence is gathered by aggregation on (trace, span). Cycles are found by
pointer jumping: after f is composed with itself often enough, what is still
reached lies on a cycle.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lanes import Lane, lane
from ..store import cut_lineage, discard

ROOT = "[]"
#: The order of siblings; a leaf comes before a node with the same first record.
_SIBLINGS = ("first", "is_node", "key")


def _id(x: Lane) -> Column:
    """A non-empty string, else null."""
    return F.when(x.string != "", x.string)


def _key(trace: Column, span: Column | None = None) -> Column:
    return F.to_json(F.array(trace) if span is None else F.array(trace, span))


@dataclass(frozen=True)
class TraceTree:
    """``nodes``: a row per trace, span and placeholder; ``leaves``: a row per record."""

    nodes: DataFrame
    leaves: DataFrame

    @functools.cached_property
    def held(self) -> DataFrame:
        """The nodes, written once: what navigates reads them often."""
        return cut_lineage(self.nodes)

    def rows(self) -> DataFrame:
        """Nodes and leaves under their parents: parent, key, is_record, first, label; children sort by (first, leaf before node)."""
        leaves = self.leaves.select("parent", F.col("_ord").cast("string").alias("key"), F.lit(True).alias("is_record"), F.col("_ord").alias("first"), F.col("evidence").alias("label"))
        return self.held.select("parent", "key", F.lit(False).alias("is_record"), "first", "label").union(leaves).withColumn("is_node", ~F.col("is_record"))

    def placed(self) -> DataFrame:
        """rows() with each one's place among its siblings, and the siblings beside it."""
        order = W.partitionBy("parent").orderBy("first", F.col("is_record").desc(), "key")
        return self.rows().withColumns({"place": F.row_number().over(order) - 1, "previous": F.lag("key").over(order), "next": F.lead("key").over(order)})

    def counted(self) -> DataFrame:
        """Nodes with child_count (nodes and leaves)."""
        children = self.rows().groupBy("parent").agg(F.count(F.lit(1)).alias("child_count"))
        return self.held.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))

    def filtered(self, admitted: DataFrame) -> DataFrame:
        """Nodes that hold an admitted record (``_ord``) or lie above one: match_count, context_only; other evidence stays that of all records."""
        matched = self.leaves.join(admitted.select("_ord"), "_ord", "left_semi").where(F.col("parent") != ROOT).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("match_count"))
        matched = cut_lineage(matched)
        seen = self._above(matched.select("key"))
        out = self.held.join(seen, "key", "left_semi").join(matched, "key", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
        return out.withColumn("context_only", F.col("match_count") == 0)

    def _above(self, keys: DataFrame) -> DataFrame:
        """The keys and those of all their ancestors.

        Round k adds the ancestors 2**k steps above what is known, so a chain
        takes as many rounds as its length has binary digits.
        """
        jump = self.held.select("key", "parent").where(F.col("parent") != ROOT)
        seen, known = cut_lineage(keys), -1
        while True:
            now = seen.count()
            if now in (0, known):
                return seen
            known, before = now, seen
            seen = cut_lineage(seen.union(seen.join(jump, "key").select(F.col("parent").alias("key"))).distinct())
            discard(before)
            jump = cut_lineage(jump.join(jump.toDF("parent", "far"), "parent").select("key", F.col("far").alias("parent")))

    # Navigation. A node's key is its identity: it depends on the records' identifiers only.

    def row(self, key: str) -> Row | None:
        """The node or leaf of a key (a leaf's is its ordinal as text)."""
        return self.rows().where(F.col("key") == key).first()

    def node_for_identity(self, identity: str, delivered_only: bool = True) -> Row | None:
        """The node with a key; a placeholder, which no record told of, only if asked."""
        found = self.held.where(F.col("key") == identity)
        return (found.where("kind <> 'placeholder'") if delivered_only else found).first()

    def children(self, key: str = ROOT, offset: int = 0, limit: int = 100) -> list[Row]:
        """A page of the children, leaves included, in order of their first records."""
        return self.rows().where(F.col("parent") == key).orderBy(*_SIBLINGS).offset(offset).limit(limit).collect()

    def edge_child(self, key: str = ROOT, last: bool = False) -> Row | None:
        pick = F.max_by if last else F.min_by
        found = self.rows().where(F.col("parent") == key)
        return found.agg(pick(F.struct(*found.columns), F.struct(*_SIBLINGS)).alias("row")).first()["row"]

    def sibling(self, key: str, previous: bool = False) -> Row | None:
        own = self.row(key)
        if own is None:
            return None
        place, mine = F.struct(*_SIBLINGS), F.struct(F.lit(own["first"]).cast("long").alias("first"), F.lit(own["is_node"]).alias("is_node"), F.lit(key).alias("key"))
        found = self.rows().where(F.col("parent") == own["parent"]).where(place < mine if previous else place > mine)
        pick = F.max_by if previous else F.min_by
        return found.agg(pick(F.struct(*found.columns), place).alias("row")).first()["row"]

    def node_for_record(self, ordinal: int) -> Row | None:
        """The node that a record is a leaf of; None for an untraced record."""
        return self.held.join(self.leaves.where(F.col("_ord") == ordinal).select(F.col("parent").alias("key")), "key", "left_semi").first()

    def ancestors(self, key: str) -> list[str]:
        """Keys from a node's parent up to its trace."""
        chain = self._above(self.held.where(F.col("key") == key).select("key"))
        ups = dict(self.held.join(chain, "key", "left_semi").select("key", "parent").collect())  # a row per ancestor
        out = [ups.get(key, ROOT)]
        while out[-1] != ROOT:
            out.append(ups[out[-1]])
        return out[:-1]

    def is_ancestor(self, key: str, ordinal: int) -> bool:
        """Whether a record lies below a node."""
        holder = self.node_for_record(ordinal)
        return holder is not None and key in (holder["key"], *self.ancestors(holder["key"]))

    def record_page(self, key: str, offset: int = 0, limit: int = 100) -> list[int]:
        """Ordinals of the records directly below a node, in their order."""
        found = self.leaves.where(F.col("parent") == key).orderBy("_ord").offset(offset).limit(limit)
        return [r["_ord"] for r in found.select("_ord").collect()]


def build_tree(records: DataFrame) -> TraceTree:
    v = F.col("v")
    x = {n: lane(v, (n,)) for n in ("trace_id", "span_id", "parent_span_id", "event", "status", "duration_ms", "span", "span_name")}
    trace, span, parent = _id(x["trace_id"]), _id(x["span_id"]), x["parent_span_id"]
    event = x["event"].string
    end_ok = x["status"].string.isin("ok", "error") & x["duration_ms"].finite & (x["duration_ms"].double >= 0)
    rank = F.when(x["span"].present, 0).when(x["span_name"].present, 1)
    label = F.when(x["span"].present, x["span"].x).otherwise(x["span_name"].x)
    kind = (
        F.when(~parent.present, F.when(F.coalesce(event == "span.start", F.lit(False)), "root").otherwise("unobserved"))
        .when(parent.is_null, "null").when(parent.string == "", "empty").when(parent.string.isNotNull(), "id").otherwise("invalid")
    )
    evidence = (
        F.when(~x["trace_id"].present, "untraced").when(trace.isNull(), "invalid trace identifier")
        .when(~x["span_id"].present, "span not identified").when(span.isNull(), "invalid span identifier")
    )
    seen = records.select(  # written once: what a record tells is small beside it
        "_ord", trace.alias("trace"), F.when(trace.isNotNull(), span).alias("span"), evidence.alias("evidence"), F.coalesce(event == "span.start", F.lit(False)).alias("is_start"), F.coalesce(event == "span.end", F.lit(False)).alias("is_end"),
        F.coalesce(end_ok, F.lit(False)).alias("end_ok"), x["status"].string.alias("status"), x["duration_ms"].double.alias("duration_ms"), rank.alias("rank"), F.to_json(label).alias("label_json"), Lane(label).string.alias("label"),
        kind.alias("parent_kind"), F.when(kind == "id", parent.string).when(kind == "invalid", F.to_json(parent.x)).alias("parent_value"),
    )
    seen = cut_lineage(seen)
    leaves = seen.select("_ord", F.when(F.col("span").isNotNull(), _key(F.col("trace"), F.col("span"))).when(F.col("trace").isNotNull(), _key(F.col("trace"))).otherwise(ROOT).alias("parent"), "evidence")
    traced = seen.where("trace is not null")
    traces = traced.groupBy("trace").agg(F.min("_ord").alias("first"), F.count_if(F.col("span").isNull()).alias("record_count"))

    told = F.when(F.col("parent_kind") != "unobserved", F.struct("parent_kind", "parent_value"))
    spans = traced.where("span is not null").groupBy("trace", "span").agg(
        F.min("_ord").alias("first"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if("is_start").alias("starts"),
        F.count_if("is_end").alias("ends"),
        F.count_if(F.col("is_end") & ~F.col("end_ok")).alias("bad_ends"),
        F.max_by(F.struct("status", "duration_ms"), F.when(F.col("is_end"), F.col("_ord"))).alias("last"),
        F.min_by("label", F.when(F.col("rank").isNotNull(), F.struct("rank", "_ord"))).alias("label"),
        F.min("rank").alias("best_rank"),
        *[(F.min(F.when(F.col("rank") == r, F.col("label_json"))) != F.max(F.when(F.col("rank") == r, F.col("label_json")))).alias(f"names{r}") for r in (0, 1)],
        F.min(told).alias("told"),
        F.max(told).alias("told_last"),
    )
    lifecycle = (
        F.when((F.col("starts") == 0) & (F.col("ends") == 0), "unavailable")
        .when((F.col("starts") > 1) | (F.col("ends") > 1) | (F.col("bad_ends") > 0), "conflicting")
        .when((F.col("starts") == 1) & (F.col("ends") == 1), "complete").otherwise("incomplete")
    )
    relation = (
        F.when(F.col("told").isNull(), "parent not observed").when(~F.col("told").eqNullSafe(F.col("told_last")), "conflicting parents")
        .when(F.col("told.parent_kind") == "root", "root").when(F.col("told.parent_kind") == "id", "parent observed").otherwise(F.concat(F.col("told.parent_kind"), F.lit(" parent")))
    )
    done = F.col("lifecycle") == "complete"
    spans = (
        spans.withColumn("lifecycle", lifecycle).withColumn("relationship", relation)
        .withColumn("status", F.when(done, F.col("last.status"))).withColumn("duration_ms", F.when(done, F.col("last.duration_ms")))
        .withColumn("label", F.coalesce("label", "span")).withColumn("name_conflict", F.when(F.col("best_rank") == 0, F.col("names0")).when(F.col("best_rank") == 1, F.col("names1")).otherwise(False))
        .withColumn("up", F.when(F.col("relationship") == "parent observed", F.col("told.parent_value")))
    )
    spans = cut_lineage(spans.select("trace", "span", "first", "record_count", "label", "name_conflict", "lifecycle", "status", "duration_ms", "relationship", "up"))
    wanted = spans.where("up is not null").groupBy("trace", F.col("up").alias("span")).agg(F.min("first").alias("first"))
    missing = wanted.join(spans.select("trace", "span"), ["trace", "span"], "left_anti")
    cycle = _on_cycle(spans.where("up is not null").select(_key(F.col("trace"), F.col("span")).alias("node"), _key(F.col("trace"), F.col("up")).alias("to")))
    key = _key(F.col("trace"), F.col("span"))
    spans = spans.withColumn("key", key).join(cycle.withColumn("cyclic", F.lit(True)), "key", "left")
    spans = spans.withColumn("relationship", F.when(F.col("cyclic"), "cycle").otherwise(F.col("relationship"))).withColumn("parent", F.when(F.col("up").isNotNull() & F.col("cyclic").isNull(), _key(F.col("trace"), F.col("up"))).otherwise(_key(F.col("trace"))))
    none = F.lit(None)
    columns = ["key", "parent", "kind", "trace", "span", "first", "label", "relationship", "lifecycle", "status", "duration_ms", "name_conflict", "record_count"]
    nodes = traces.select(
        _key(F.col("trace")).alias("key"), F.lit(ROOT).alias("parent"), F.lit("trace").alias("kind"), "trace", none.cast("string").alias("span"), "first", F.col("trace").alias("label"), none.cast("string").alias("relationship"),
        none.cast("string").alias("lifecycle"), none.cast("string").alias("status"), none.cast("double").alias("duration_ms"), F.lit(False).alias("name_conflict"), "record_count",
    ).union(spans.withColumn("kind", F.lit("span")).select(*columns)).union(
        missing.select(
            key.alias("key"), _key(F.col("trace")).alias("parent"), F.lit("placeholder").alias("kind"), "trace", "span", "first", F.lit("missing parent").alias("label"), F.lit("missing parent").alias("relationship"),
            F.lit("unavailable").alias("lifecycle"), none.cast("string").alias("status"), none.cast("double").alias("duration_ms"), F.lit(False).alias("name_conflict"), F.lit(0).cast("long").alias("record_count"),
        )
    )
    return TraceTree(nodes, leaves)


def _on_cycle(edges: DataFrame) -> DataFrame:
    """(key) of the nodes on cycles of a partial function node -> to.

    What f composed m times still reaches shrinks as m doubles. Once it does not
    shrink, f permutes it, so it is just the cycles; often after two rounds.
    """
    jump = cut_lineage(edges)
    reached = None
    while True:
        now = jump.select("to").distinct().count()
        if now in (0, reached):
            return jump.select(F.col("to").alias("key")).distinct()
        reached = now
        ahead = jump.toDF("to", "far")
        jump = cut_lineage(jump.join(ahead, "to").select("node", F.col("far").alias("to")))
