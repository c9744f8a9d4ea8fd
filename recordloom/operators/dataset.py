"""Investigations: a captured, verified snapshot of record sources and the jobs over it."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ToolError
from ..expressions import Expression, lower
from ..functions.lanes import lane
from ..plans.plan import METRICS, grouped, plain
from ..sources.records import concatenated, decode, expand, read_lines
from . import discovery, tracetree
from . import search as searching
from .jobs import Job


@dataclass(frozen=True)
class ResourceLimits:
    max_record_bytes: int = 8 << 20
    max_page_records: int = 1000
    max_page_bytes: int = 16 << 20


@dataclass(frozen=True)
class RecordIdentity:
    dataset_id: str
    ordinal: int
    occurrence: int


@dataclass(frozen=True)
class GroupBinding:
    """A group path and its output name."""

    path: tuple[str, ...]
    name: str


@dataclass
class RecordView:
    """Ordinals of a dataset's records, as a lazy DataFrame (``_ord``)."""

    dataset_id: str
    ordinals: DataFrame
    closed: bool = False

    def _open(self) -> DataFrame:
        if self.closed:
            raise ToolError("view_closed", "the view is closed")
        return self.ordinals

    def page(self, offset: int, limit: int) -> list[int]:
        rows = self._open().orderBy("_ord").offset(offset).limit(limit).collect()
        return [r["_ord"] for r in rows]

    def position_of(self, ordinal: int) -> int | None:
        row = self._open().agg(F.count_if(F.col("_ord") < ordinal).alias("before"), F.count_if(F.col("_ord") == ordinal).alias("own")).first()
        return row["before"] if row["own"] else None

    def count(self) -> int:
        return self._open().count()

    def close(self) -> None:
        self.closed = True


class Files:
    """The few operations on files that a store needs, by Hadoop's file systems: local or shared, as the path says."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str):
        whole = name.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", name)
        return self._jvm.org.apache.hadoop.fs.Path(name if whole else f"{self.root}/{name}")

    def at(self, name: str):
        return self.path(name).getFileSystem(self._conf)

    def read(self, name: str) -> str | None:
        files = self.at(name)
        if not files.exists(self.path(name)):
            return None
        stream = files.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.at(name).create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, draft: str, name: str) -> None:
        """Renames over an existing file, in one step where the file system can."""
        fs = self._jvm.org.apache.hadoop.fs
        how = self._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE
        source = self.at(draft).makeQualified(self.path(draft))
        fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, self.at(name).makeQualified(self.path(name)), how)

    def delete(self, name: str) -> None:
        self.at(name).delete(self.path(name), True)

    def touch(self, name: str) -> None:
        self.at(name).setTimes(self.path(name), int(time.time() * 1000), -1)

    def modified(self, pattern: str) -> dict[str, float]:
        """Paths that match a pattern below the root, with the times of their last change in seconds."""
        found = self.at(self.root).globStatus(self.path(pattern))
        return {f.getPath().toString(): f.getModificationTime() / 1000 for f in found or ()}

    def size(self, path: str) -> int | None:
        """Of a regular file, else None."""
        files = self.at(path)
        if not files.exists(self.path(path)) or not files.getFileStatus(self.path(path)).isFile():
            return None
        return files.getFileStatus(self.path(path)).getLen()


def cache_key(paths: list[str]) -> str:
    return hashlib.sha256(json.dumps(paths).encode()).hexdigest()


def source_digests(spark: SparkSession, paths: list[str]) -> list[list]:
    """[bytes, lines, digest] of each file. Executors hash every line with its number, 128 bits each, and add the hashes up."""
    files = Files(spark, "/")
    sizes = [files.size(p) for p in paths]
    lines, _ = read_lines(spark, paths)
    total = [F.sum(F.xxhash64(F.lit(seed), "position", "value").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    told = lines.groupBy("source_idx").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *total).alias("digest")).collect()  # a row per file
    by_file = {r["source_idx"]: [r["n"], r["digest"]] for r in told}
    return [[size, *by_file.get(i, [0, ""])] for i, size in enumerate(sizes)]


@dataclass
class CacheStore:
    """Snapshots in a folder that executors share, by the hash of their paths; a manifest tells the sources' sizes and digests.

    Of more than ``keep`` entries the least recently used go, and expired ones
    when asked; an entry that an open investigation leases stays.
    """

    root: str
    expiry_s: float = 7 * 86400
    keep: int = 16

    def _files(self, spark: SparkSession) -> Files:
        return Files(spark, self.root)

    def manifest(self, spark: SparkSession, paths: list[str]) -> dict | None:
        try:
            text = self._files(spark).read(f"{cache_key(paths)}/manifest.json")
            return None if text is None else json.loads(text)
        except Exception as error:
            raise ToolError("cache_corrupt", f"the manifest of {paths} cannot be read") from error

    def verified(self, spark: SparkSession, paths: list[str]) -> dict | None:
        """The manifest if every source still has the size and digest that it tells."""
        known = self.manifest(spark, paths)
        if known is None or source_digests(spark, paths) != known["sources"]:
            return None
        self._files(spark).touch(f"{cache_key(paths)}/manifest.json")  # used now
        return known

    def publish(self, spark: SparkSession, paths: list[str], manifest: dict) -> None:
        files, entry = self._files(spark), cache_key(paths)
        draft = f"{entry}/.manifest-{uuid.uuid4().hex}"
        try:
            files.write(draft, json.dumps(manifest))
            files.replace(draft, f"{entry}/manifest.json")
        except Exception as error:
            raise ToolError("storage_failed", f"the manifest of {paths} cannot be written") from error
        known = sorted(self._entries(files).items(), key=lambda e: e[1])
        above = len(known) - self.keep
        for old, _ in known[:-1]:  # the last is this one
            if above > 0 and self._drop(files, old):
                above -= 1

    def lease(self, spark: SparkSession, paths: list[str]) -> str:
        name = f"{cache_key(paths)}/lease-{uuid.uuid4().hex}"
        self._files(spark).write(name, "")
        return name

    def release(self, spark: SparkSession, lease: str) -> None:
        self._files(spark).delete(lease)

    def _entries(self, files: Files) -> dict[str, float]:
        return {m.rpartition("/")[0]: at for m, at in files.modified("*/manifest.json").items()}

    def _drop(self, files: Files, entry: str) -> bool:
        """Deletes an entry unless it is leased; a lease older than the expiry is one whose holder is gone."""
        held = [at for at in files.modified(f"{entry}/lease-*").values() if time.time() - at <= self.expiry_s]
        if not held:
            files.delete(entry)
        return not held

    def clear(self, spark: SparkSession, expired_only: bool = False) -> int:
        """The number of entries that went."""
        files = self._files(spark)
        old = [e for e, at in self._entries(files).items() if not expired_only or time.time() - at > self.expiry_s]
        return sum(self._drop(files, e) for e in old)


@dataclass
class Investigation:
    """A captured dataset. Its snapshot (Parquet: _ord, source, occurrence, line, raw) does not change."""

    spark: SparkSession
    paths: list[str]
    store: CacheStore
    dataset_id: str
    snapshot: str
    sources: list[list]
    reused: bool = False
    limits: ResourceLimits = field(default_factory=ResourceLimits)
    closed: bool = False
    lease: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, paths, store: CacheStore | str, limits: ResourceLimits | None = None) -> Investigation:
        """Captures regular files, or takes a verified earlier capture of the same files."""
        store = store if isinstance(store, CacheStore) else CacheStore(str(store))
        listed = [p for source in (paths if isinstance(paths, (list, tuple)) else [paths]) for p in expand(source)]
        files = Files(spark, "/")
        for p in listed:
            if files.size(p) is None:
                raise ToolError("source_invalid", f"{p} is not a regular file", source=p)
        known = store.verified(spark, listed)
        if known is None:
            return cls._capture(spark, listed, store, limits or ResourceLimits())
        return cls(spark, listed, store, known["dataset_id"], known["snapshot"], known["sources"], True, limits or ResourceLimits(), lease=store.lease(spark, listed))

    @classmethod
    def open_job(cls, spark: SparkSession, paths, store: CacheStore | str, limits: ResourceLimits | None = None) -> Job:
        """The same in the background; a canceled capture leaves nothing."""
        return Job(spark, "capture", lambda: cls.open(spark, paths, store, limits), lambda made: made.close())

    @classmethod
    def _capture(cls, spark, listed: list[str], store: CacheStore, limits: ResourceLimits, publish: bool = True) -> Investigation:
        before, dataset_id = source_digests(spark, listed), uuid.uuid4().hex
        snapshot = f"{store.root.rstrip('/')}/{cache_key(listed)}/{dataset_id}"
        lines, _ = read_lines(spark, listed)
        big = F.octet_length("value") > limits.max_record_bytes
        # A line that is too long is not decoded.
        decoded = decode(lines.withColumn("value", F.when(~big, F.col("value")))).withColumn("reason", F.when(F.col("value").isNull(), "record_too_large").otherwise(F.col("reason")))
        made = cls(spark, listed, store, dataset_id, snapshot, before, False, limits)
        try:
            good = concatenated(decoded.where("reason is null"))
            good.select("_ord", "source", F.col("source_idx").alias("occurrence"), F.col("position").alias("line"), F.col("value").alias("raw")).write.parquet(f"{snapshot}/records")
            decoded.where("reason <> 'blank'").select("source", F.col("source_idx").alias("occurrence"), F.col("position").alias("line"), "reason").write.parquet(f"{snapshot}/diagnostics")
            if source_digests(spark, listed) != before:
                raise ToolError("source_changed", "a source changed while it was captured")
        except BaseException:
            made.discard()
            raise
        if publish:
            made.commit()
        made.lease = store.lease(spark, listed)
        return made

    # Reading.

    def _ready(self) -> None:
        if self.closed:
            raise ToolError("session_closed", "the investigation is closed")

    def stored(self) -> DataFrame:
        self._ready()
        return self.spark.read.schema("_ord long, source string, occurrence int, line long, raw string").parquet(f"{self.snapshot}/records")

    def records(self, view: RecordView | None = None) -> DataFrame:
        """_ord, _origin, raw, v of the dataset or of a view."""
        origin = F.struct("source", F.col("line").alias("position"), F.lit("file").alias("kind"))
        df = self.stored().select("_ord", origin.alias("_origin"), "raw", F.try_parse_json("raw").alias("v"))
        return df if view is None else df.join(self._own(view), "_ord", "left_semi")

    def _own(self, view: RecordView) -> DataFrame:
        if view.dataset_id != self.dataset_id:
            raise ToolError("scope_mismatch", "the view belongs to another dataset")
        return view._open()

    def page(self, offset: int, limit: int, view: RecordView | None = None) -> list[tuple[RecordIdentity, dict, dict]]:
        """(identity, origin, record) from a place on."""
        if limit > self.limits.max_page_records:
            raise ToolError("resource_limit", "the page is larger than allowed")
        rows = self.stored()
        if view is not None:
            rows = rows.join(self._own(view), "_ord", "left_semi").orderBy("_ord").offset(offset)
        else:
            rows = rows.where(F.col("_ord") >= offset).orderBy("_ord")
        found = rows.limit(limit)
        total = found.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("size")).first()["size"]
        if total > self.limits.max_page_bytes:
            raise ToolError("resource_limit", "the page's records are larger than allowed", size=total)
        return [(RecordIdentity(self.dataset_id, r._ord, r.occurrence), {"source": r.source, "position": r.line, "kind": "file"}, json.loads(r.raw)) for r in found.collect()]

    def diagnostics(self) -> DataFrame:
        self._ready()
        return self.spark.read.schema("source string, occurrence int, line long, reason string").parquet(f"{self.snapshot}/diagnostics")

    def diagnostic_page(self, offset: int, limit: int) -> list[dict]:
        """Skipped lines in the order of the sources, as dictionaries."""
        if limit > self.limits.max_page_records:
            raise ToolError("resource_limit", "the page is larger than allowed")
        return [r.asDict() for r in self.diagnostics().orderBy("occurrence", "line").offset(offset).limit(limit).collect()]

    # Jobs.

    def start(self, kind: str, work: Callable[[Investigation], object]) -> Job:
        """Runs work on this investigation in the background: ``start("tree", lambda s: s.build_tree())``."""
        self._ready()
        return Job(self.spark, kind, lambda: work(self), lambda value: value.close() if hasattr(value, "close") else None)

    def filter(self, expression: Expression, view: RecordView | None = None) -> RecordView:
        df = self.records(view)
        return RecordView(self.dataset_id, df.where(lower(expression, lambda p: lane(F.col("v"), p))).select("_ord"))

    def search(self, options: searching.SearchOptions, view: RecordView | None = None) -> RecordView:
        return RecordView(self.dataset_id, searching.search(self.records(view), options).select("_ord"))

    def count_values(self, path: tuple[str, ...], grouping: tuple[GroupBinding, ...] = (), view: RecordView | None = None) -> DataFrame:
        """Counts of each typed value of a path among records that have it; a value or group that is no scalar raises data_incompatible."""
        records = self.records(view)
        out = value_counts(records, path, grouping)
        _refused(left_out(records, path, grouping), path)
        return out

    def summarize_values(self, path: tuple[str, ...], metrics: tuple[str, ...] = METRICS, grouping: tuple[GroupBinding, ...] = (), view: RecordView | None = None) -> DataFrame:
        """The metrics of a path; a group that is no scalar, a value that is no finite number, or a result beyond the range raises data_incompatible."""
        records = self.records(view)
        out = numeric_summary(records, path, metrics, grouping)
        numeric = set(metrics) != {"count"}
        _refused(left_out(records, path, grouping, numeric), path)
        if {"sum", "mean"} & set(metrics) and not out.where("bad > 0").isEmpty():
            raise ToolError("data_incompatible", f"a result for {path!r} is not finite", field=path)
        return out

    def discover(self, view: RecordView | None = None) -> DataFrame:
        return discovery.entries(self.records(view))

    def build_tree(self) -> tracetree.TraceTree:
        return tracetree.build_tree(self.records())

    # Renewal.

    def refresh(self) -> Investigation:
        """A new capture of the same files, not yet published; ``commit`` makes it the one that ``open`` finds, ``discard`` deletes it."""
        self._ready()
        return self._capture(self.spark, self.paths, self.store, self.limits, publish=False)

    def refresh_job(self) -> Job:
        """A refresh in the background; canceling it discards the capture."""
        self._ready()
        return Job(self.spark, "refresh", self.refresh, lambda made: made.discard())

    def replan(self, newer: Investigation, views: dict[str, Callable[[Investigation], object]]) -> dict[str, object]:
        """Rebuilds named scopes on a newer capture, all of them or none; only then may it be committed."""
        made: dict[str, object] = {}
        try:
            for name, build in views.items():
                made[name] = build(newer)
        except BaseException:
            newer.discard()
            raise
        return made

    def commit(self) -> None:
        self._ready()
        self.store.publish(self.spark, self.paths, {"dataset_id": self.dataset_id, "snapshot": self.snapshot, "sources": self.sources})

    def discard(self) -> None:
        self.close()
        Files(self.spark, self.store.root).delete(self.snapshot)

    def restore_record(self, previous: Investigation, identity: RecordIdentity) -> RecordIdentity:
        """The place of an earlier capture's record in this one."""
        if identity.dataset_id != previous.dataset_id:
            raise ToolError("scope_mismatch", "the identity belongs to another dataset")
        row = restored(previous.stored().where(F.col("_ord") == identity.ordinal), self.stored()).first()
        if row is None or row["outcome"] != "restored":
            code = row["outcome"] if row else "record_disappeared"
            raise ToolError(code, "the record cannot be restored")
        return replace(identity, dataset_id=self.dataset_id, ordinal=row["new_ord"])

    def close(self) -> None:
        if self.lease is not None:
            self.store.release(self.spark, self.lease)
        self.closed, self.lease = True, None


def restored(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_ord, new_ord, outcome (restored, record_changed, record_disappeared, record_ambiguous), by source, occurrence and line."""
    keys = ["source", "occurrence", "line"]
    ahead = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.min("_ord").alias("new_ord"), F.min("raw").alias("new_raw"))
    outcome = F.when(F.col("found").isNull(), "record_disappeared").when(F.col("found") > 1, "record_ambiguous").when(F.col("raw") != F.col("new_raw"), "record_changed").otherwise("restored")
    return old.join(ahead, keys, "left").select(F.col("_ord").alias("old_ord"), F.when(outcome == "restored", F.col("new_ord")).alias("new_ord"), outcome.alias("outcome"))


def _refused(counts: DataFrame, path: tuple[str, ...]) -> None:
    found = counts.first()
    for name, count in (("a group", found["keys"]), (repr(path), found["vals"])):
        if count:
            raise ToolError("data_incompatible", f"{count} records have a value of {name} that the operation cannot take", field=path)


def _checked(grouping: tuple[GroupBinding, ...], taken: set[str]) -> None:
    names, paths = [g.name for g in grouping], [g.path for g in grouping]
    if len(set(names)) < len(names) or len(set(paths)) < len(paths) or taken & set(names):
        raise ValueError("group names and paths must be unique and differ from result names")


def value_counts(records: DataFrame, path: tuple[str, ...], grouping: tuple[GroupBinding, ...] = ()) -> DataFrame:
    """first, the groups, value (VARIANT) and count; a record without the path does not count, a null value does.

    Records whose value or group is an array or object are left out; ``left_out`` counts them.
    """
    _checked(grouping, {"value", "count"})
    v = F.col("v")
    chosen = lane(v, path)
    keys = {g.name: lane(v, g.path) for g in grouping} | {"value": chosen}
    out = grouped(records, keys, {"count": ("count", None)}, present=chosen).where("_bad_key = 0")
    return out.drop("_bad_key").withColumnRenamed("_first", "first")


def numeric_summary(records: DataFrame, path: tuple[str, ...], metrics: tuple[str, ...] = METRICS, grouping: tuple[GroupBinding, ...] = ()) -> DataFrame:
    """first, the groups and the metrics over records that have the path. Without grouping there is always one row.

    ``bad`` counts values that the metrics cannot take and results beyond the
    range of doubles (0 for a count alone). Groups named by an array or object
    are left out; ``left_out`` counts their records.
    """
    if not metrics or len(set(metrics)) < len(metrics) or not set(metrics) <= set(METRICS):
        raise ValueError("metrics must be distinct and known")
    _checked(grouping, set(metrics))
    v = F.col("v")
    chosen = lane(v, path)
    keys = {g.name: lane(v, g.path) for g in grouping}
    out = grouped(records, keys, {m: (m, None if m == "count" else chosen) for m in metrics}, present=chosen).where("_bad_key = 0")
    bads = [F.col(f"`{c}`") for c in out.columns if c.startswith("_bad:")]
    return out.select(F.col("_first").alias("first"), *[F.col(f"`{g.name}`") for g in grouping], *metrics, (F.greatest(*bads, F.lit(0)) if bads else F.lit(0)).alias("bad"))


def left_out(records: DataFrame, path: tuple[str, ...], grouping: tuple[GroupBinding, ...] = (), numeric: bool = False) -> DataFrame:
    """One row: the numbers of records that have the path but a group (``keys``) or a value (``vals``) that the aggregates cannot take."""
    v = F.col("v")
    chosen = lane(v, path)
    odd = [lane(v, g.path).kind.isin("array", "object", "other") for g in grouping]
    bad_value = ~chosen.is_null & ~(chosen.number & chosen.finite) if numeric else chosen.kind.isin("array", "object", "other")
    return records.where(chosen.present).agg(F.count_if(reduce(lambda a, b: a | b, odd, F.lit(False))).alias("keys"), F.count_if(bad_value).alias("vals"))


def inferred_metrics(records: DataFrame, path: tuple[str, ...]) -> tuple[str, ...]:
    """All metrics where the first value is a number, else none (value counts suit it)."""
    x = lane(F.col("v"), path)
    row = records.where(x.present & ~x.is_null).agg(F.min_by(x.number, "_ord").alias("number")).first()
    return METRICS if row["number"] else ()


def page_of(result: DataFrame, offset: int, limit: int, limits: ResourceLimits | None = None) -> list[dict]:
    """Rows of an aggregate result in order of first appearance."""
    limits = limits or ResourceLimits()
    if limit > limits.max_page_records:
        raise ToolError("resource_limit", "the page is larger than allowed")
    rows = result.orderBy("first").offset(offset).limit(limit).collect()
    out = [{k: plain(x.toPython()) if hasattr(x, "toPython") else x for k, x in r.asDict().items() if x is not None} for r in rows]
    if len(json.dumps(out)) > limits.max_page_bytes:
        raise ToolError("resource_limit", "the page's rows are larger than allowed")
    return out
