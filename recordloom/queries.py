"""Queries over the driver's tables, and the DuckDB SQL that returns the same rows.

Events become JSON records with a field ``x`` that is missing, null, boolean,
integer, float or string in turn; orders and line items become trace records.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import Field, all_of, any_of, logger_prefix, lower, not_
from .functions.lanes import lane
from .language import complete_filter, parse_filter
from .operators import contract, dataset, discovery, tracetree
from .operators import search as searching
from .plans.plan import QueryPlan, count_rows, max_of, mean_of, min_of, scan, sum_of
from .sources.records import ORIGIN, merge_keys, numbered_by, read_records, timestamp
from .store import cut_lineage, forget_at_exit, shared_folder

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The records as DuckDB sees them: o is the ordinal, m the variety of x, d its digit.
RECORDS = """WITH r AS (SELECT event_id o, user_id u, event_type t, value v, CAST(json_extract(props, '$.k') AS BIGINT) k, event_id % 6 m, (event_id // 6) % 10 d,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END l FROM events) """


def query(name: str, sql: str | None = None):
    def add(function):
        Q[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    digit = F.floor(F.col("event_id") / 6) % 10
    m = F.col("event_id") % 6
    boolean = F.when(digit % 2 == 0, "true").otherwise("false")
    x = F.when(m == 0, "").otherwise(F.concat(F.lit(',"x":'), F.when(m == 1, F.lit("null")).when(m == 2, boolean).when(m == 3, digit.cast("string")).when(m == 4, F.concat(digit.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit('"'), digit.cast("string"), F.lit('"')))))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    parts = ['{"event_id":', F.col("event_id"), ',"user_id":', F.col("user_id"), ',"event_type":"', F.col("event_type"), '","value":', F.col("value"), ',"level":"', level, '","logger":"app.', F.col("event_type"), '","k":', F.get_json_object("props", "$.k"), ',"props":', F.col("props"), x, ',"tags":["', F.col("event_type"), '",', digit, "]}"]
    line = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return events.select(F.col("event_id").alias("_ord"), F.struct(F.lit("events"), F.col("event_id"), F.lit("iterable")).cast(ORIGIN).alias("_origin"), line.alias("raw"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_lines(spark, sf_dir).withColumn("v", F.try_parse_json("raw"))


def plan(spark: SparkSession, sf_dir: str) -> QueryPlan:
    return scan(records(spark, sf_dir))


def ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("_ord").alias("o"))


def _filter(name: str, expression, where: str) -> None:
    """A filter query that returns the ordinals of its records."""

    @query(name, f"{RECORDS} SELECT o FROM r WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ids(plan(spark, sf_dir).filter(expression).dataframe(spark))


_x = Field("x")
_filter("filter_eq", Field("event_type").eq("click"), "t = 'click'")
_filter("filter_ne", Field("event_type").ne("click"), "t <> 'click'")
_filter("filter_gt", Field("value").gt(50), "v > 50")
_filter("filter_ge", Field("k").ge(5), "k >= 5")
_filter("filter_lt", Field("event_type").lt("login"), "t < 'login'")
_filter("filter_le", Field("value").le(10.5), "v <= 10.5")
_filter("filter_nested", Field("props", "k").eq(3), "k = 3")
_filter("filter_in", Field("event_type").in_(["error", "view"]), "t IN ('error', 'view')")
_filter("filter_not_in", Field("event_type").not_in(["error", "view"]), "t NOT IN ('error', 'view')")
_filter("filter_exists", _x.exists(), "m <> 0")
_filter("filter_missing", _x.missing(), "m = 0")
_filter("filter_starts_with", Field("logger").starts_with("app.p"), "starts_with(t, 'p')")
_filter("filter_regex", Field("logger").regex(r"^app\.(click|view)"), "t IN ('click', 'view')")
_filter("filter_regex_python", Field("logger").regex(r"(?P<kind>sign|pur)[a-z]+"), "t IN ('signup', 'purchase')")
_filter("filter_logger_prefix", logger_prefix("app.error"), "t = 'error'")
_filter("filter_and_or_not", all_of(any_of(Field("level").eq("ERROR"), Field("k").lt(3)), not_(Field("value").gt(90))), "(l = 'ERROR' OR k < 3) AND NOT v > 90")
_filter("filter_empty_all_of", all_of(), "true")
_filter("filter_empty_any_of", any_of(), "false")
_filter("filter_not_matches_missing", not_(_x.eq(3)), "NOT (m IN (3, 4) AND d = 3)")
_filter("filter_mixed_eq_number", _x.eq(3), "m IN (3, 4) AND d = 3")
_filter("filter_mixed_eq_bool", _x.eq(True), "m = 2 AND d % 2 = 0")
_filter("filter_mixed_eq_null", _x.eq(None), "m = 1")
_filter("filter_mixed_eq_string", _x.eq("3"), "m = 5 AND d = 3")
_filter("filter_mixed_ne_compat", _x.ne(3), "m IN (3, 4) AND d <> 3")
_filter("filter_mixed_ne_null", _x.ne(None), "false")
_filter("filter_mixed_in", _x.in_([True, 2, "4", None]), "m = 1 OR (m = 2 AND d % 2 = 0) OR (m IN (3, 4) AND d = 2) OR (m = 5 AND d = 4)")
_filter("filter_mixed_not_in_compat", _x.not_in([1, "2"]), "(m IN (3, 4) AND d <> 1) OR (m = 5 AND d <> 2)")
_filter("filter_mixed_not_in_empty", _x.not_in([]), "m <> 0")
_filter("filter_mixed_gt_number", _x.gt(4.5), "m IN (3, 4) AND d > 4.5")
_filter("filter_structural_eq", Field("props").eq({"k": 4}), "k = 4")
_filter("filter_structural_ne", Field("tags").ne(["click", 1]), "NOT (t = 'click' AND d = 1)")
_filter("array_contains_any", Field("tags").contains_any(["view", 7]), "t = 'view' OR d = 7")
_filter("array_contains_all", Field("tags").contains_all(["view", 7.0]), "t = 'view' AND d = 7")
_filter("array_contains_all_empty", Field("tags").contains_all([]), "true")
_filter("infix_filter", parse_filter('(event_type = "error" OR props.k >= 8) AND NOT x exists'), "(t = 'error' OR k >= 8) AND m = 0")
_filter("infix_contains", parse_filter('logger contains "p.s" or ["level"] starts_with "WA"'), "t = 'signup' OR l = 'WARNING'")
_filter("infix_not_in", parse_filter("x NOT IN [1, null] and k in [1, 2, 3]"), "((m IN (3, 4) AND d <> 1) ) AND k IN (1, 2, 3)")
_filter("infix_functions", parse_filter('in(event_type, ["click"]) and missing(x) or logger_prefix("app.view") and value > 95'), "(t = 'click' AND m = 0) OR (t = 'view' AND v > 95)")


@query("search_case_sensitive", f"{RECORDS} SELECT o FROM r WHERE t = 'click'")
def _search_case(spark, sf_dir):
    return ids(searching.search(records(spark, sf_dir), searching.SearchOptions("app.click", case_sensitive=True)))


@query("scan_count", "SELECT count(*) AS n FROM events")
def _scan_count(spark, sf_dir):
    out = plan(spark, sf_dir).aggregate(n=count_rows()).dataframe(spark)
    return out.select(lane(F.col("v"), ("n",)).integer.cast("long").alias("n"))


@query("skip_accounting", "SELECT reason, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'non_object' WHEN 3 THEN 'blank' ELSE 'record' END AS reason FROM events) GROUP BY reason")
def _skips(spark, sf_dir):
    from .sources.records import decode

    kind = F.col("_ord") % 5
    lines = _event_lines(spark, sf_dir).select(F.when(kind == 1, F.concat("raw", F.lit("}"))).when(kind == 2, F.concat(F.lit("["), "raw", F.lit("]"))).when(kind == 3, " ").otherwise(F.col("raw")).alias("value"))
    return decode(lines).groupBy(F.coalesce("reason", F.lit("record")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select_present", f"{RECORDS} SELECT o, CASE m WHEN 0 THEN 'k' ELSE 'k,x' END AS names FROM r")
def _select(spark, sf_dir):
    df = plan(spark, sf_dir).select("k", "x").dataframe(spark)
    names = F.concat_ws(",", *[F.when(lane(F.col("v"), (n,)).present, n) for n in ("k", "x")])
    return df.select(F.col("_ord").alias("o"), names.alias("names"))


@query("limit_first_n", f"{RECORDS} SELECT o FROM r ORDER BY o LIMIT 25")
def _limit(spark, sf_dir):
    return ids(plan(spark, sf_dir).limit(25).dataframe(spark))


@query("filter_before_limit", f"{RECORDS} SELECT o FROM r WHERE t = 'view' ORDER BY o LIMIT 25")
def _filter_limit(spark, sf_dir):
    return ids(plan(spark, sf_dir).filter(Field("event_type").eq("view")).limit(25).dataframe(spark))


@query("limit_before_filter", f"{RECORDS} SELECT o FROM (SELECT * FROM r ORDER BY o LIMIT 200) WHERE t = 'view'")
def _limit_filter(spark, sf_dir):
    return ids(plan(spark, sf_dir).limit(200).filter(Field("event_type").eq("view")).dataframe(spark))


def _sorted(name: str, order: str, top: int | None = None, **options) -> None:
    limit = f" LIMIT {top}" if top else ""
    field = options.pop("field", "value")

    @query(name, f"{RECORDS} SELECT o, row_number() OVER (ORDER BY {order}) - 1 AS place FROM (SELECT * FROM r WHERE m NOT IN (2, 5) ORDER BY {order}{limit})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chain = plan(spark, sf_dir).filter(any_of(_x.missing(), _x.eq(None), _x.ge(0))).sort_by(field, **options)
        state = (chain.limit(top) if top else chain)._lowered(spark)
        rows = state.df.withColumn("o", F.col("_ord"))
        return numbered_by(rows, list(state.ordering)).select("o", F.col("_ord").alias("place"))


_number = "CASE WHEN m IN (3, 4) THEN d END"
_sorted("sort_asc", "v, o")
_sorted("sort_desc", "v DESC, o", descending=True)
_sorted("sort_top50", "v DESC, o", 50, descending=True)
_sorted("sort_missing_first", f"CASE m WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END, {_number}, o", field="x", missing="first")
_sorted("sort_nulls_first", f"CASE m WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END, {_number} DESC, o", field="x", nulls="first", descending=True)


@query("sort_after_sort", f"{RECORDS} SELECT o, row_number() OVER (ORDER BY t, o) - 1 AS place FROM r")
def _sort_twice(spark, sf_dir):
    state = plan(spark, sf_dir).sort_by("value", descending=True).sort_by("event_type")._lowered(spark)
    return numbered_by(state.df.withColumn("o", F.col("_ord")), list(state.ordering)).select("o", F.col("_ord").alias("place"))


def _columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Lanes of result records as typed columns, with ``first`` (the group's first ordinal)."""
    v, out = F.col("v"), []
    for name, kind in kinds.items():
        x = lane(v, (name,))
        out.append({"s": x.string, "i": x.integer.cast("long"), "d": F.round(x.double, 6)}[kind].alias(name))
    return df.select(*out)


@query("group_numeric_by_type", f"{RECORDS} SELECT t AS event_type, count(*) AS n, round(fsum(v), 6) AS s, round(fsum(v) / count(*), 6) AS m, min(v) AS lo, max(v) AS hi FROM r WHERE v >= 50 AND t IN ('error', 'purchase') GROUP BY t")
def group_numeric_by_type(spark, sf_dir):
    chain = plan(spark, sf_dir).filter(all_of(Field("value").ge(50), Field("event_type").in_(["error", "purchase"])))
    out = chain.group_by("event_type").aggregate(n=count_rows(), s=sum_of("value"), m=mean_of("value"), lo=min_of("value"), hi=max_of("value")).dataframe(spark)
    return _columns(out, event_type="s", n="i", s="d", m="d", lo="d", hi="d")


@query("group_count", f"{RECORDS} SELECT u AS user_id, count(*) AS n FROM r GROUP BY u")
def _group_count(spark, sf_dir):
    return _columns(plan(spark, sf_dir).group_by("user_id").aggregate(n=count_rows()).dataframe(spark), user_id="i", n="i")


@query("group_multi_key", f"{RECORDS} SELECT t AS event_type, l AS level, k, count(*) AS n FROM r GROUP BY ALL")
def _group_multi(spark, sf_dir):
    return _columns(plan(spark, sf_dir).group_by("event_type", "level", "k").aggregate(n=count_rows()).dataframe(spark), event_type="s", level="s", k="i", n="i")


_TYPED = "CASE WHEN m = 0 THEN 'missing' WHEN m = 1 THEN 'null' WHEN m = 2 THEN CASE WHEN d % 2 = 0 THEN 'true' ELSE 'false' END WHEN m = 5 THEN 's' || d ELSE CAST(d AS VARCHAR) END"


def _identity(x) -> Column:
    return F.when(x.string.isNotNull(), F.concat(F.lit("s"), x.string)).when(x.number, x.double.cast("long").cast("string")).otherwise(F.coalesce(x.boolean.cast("string"), x.kind))


@query("group_typed_key", f"{RECORDS} SELECT {_TYPED} AS identity, count(*) AS n, min(o) AS first FROM r GROUP BY 1")
def _group_typed(spark, sf_dir):
    df = plan(spark, sf_dir).group_by("x").aggregate(n=count_rows()).dataframe(spark)
    return df.select(_identity(lane(F.col("v"), ("x",))).alias("identity"), lane(F.col("v"), ("n",)).integer.cast("long").alias("n"), F.col("_ord").alias("first"))


@query("group_first_representative", f"{RECORDS} SELECT d, arg_min(CASE m WHEN 3 THEN 'int' ELSE 'float' END, o) AS form FROM r WHERE m IN (3, 4) GROUP BY d")
def _representative(spark, sf_dir):
    df = plan(spark, sf_dir).filter(_x.ge(0)).group_by("x").aggregate(n=count_rows()).dataframe(spark)
    x = lane(F.col("v"), ("x",))
    return df.select(x.double.cast("long").alias("d"), x.kind.alias("form"))


@query("group_having", f"{RECORDS} SELECT u AS user_id, count(*) AS n FROM r GROUP BY u HAVING count(*) > 60")
def _having(spark, sf_dir):
    return _columns(plan(spark, sf_dir).group_by("user_id").aggregate(n=count_rows()).filter(Field("n").gt(60)).dataframe(spark), user_id="i", n="i")


def _global(name: str, sql: str, expression=None, zero: bool = False) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chain = plan(spark, sf_dir)
        chain = chain.filter(expression) if expression is not None else chain
        chain = chain.limit(0) if zero else chain
        out = chain.aggregate(n=count_rows(), s=sum_of("k"), m=mean_of("k"), lo=min_of("k"), hi=max_of("k")).dataframe(spark)
        return _columns(out, n="i", s="i", m="d", lo="i", hi="i")


_global("global_agg", f"{RECORDS} SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s, round(avg(k), 6) AS m, min(k) AS lo, max(k) AS hi FROM r")
_nothing = "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi"
_global("global_agg_empty", _nothing, Field("k").lt(-1))
_global("limit_zero_global_agg", _nothing, zero=True)


@query("agg_sum_int", f"{RECORDS} SELECT u AS user_id, CAST(sum(k) AS BIGINT) AS s FROM r GROUP BY u")
def _sum_int(spark, sf_dir):
    return _columns(plan(spark, sf_dir).group_by("user_id").aggregate(s=sum_of("k")).dataframe(spark), user_id="i", s="i")


@query("agg_sum_float_exact", f"{RECORDS} SELECT t AS event_type, round(fsum(v), 6) AS s FROM r GROUP BY t")
def _sum_float(spark, sf_dir):
    return _columns(plan(spark, sf_dir).group_by("event_type").aggregate(s=sum_of("value")).dataframe(spark), event_type="s", s="d")


@query("agg_min_max_mixed", f"{RECORDS} SELECT u AS user_id, CAST(min(d) AS DOUBLE) AS lo, CAST(max(d) AS DOUBLE) AS hi FROM r WHERE m IN (3, 4) GROUP BY u")
def _min_max(spark, sf_dir):
    return _columns(plan(spark, sf_dir).filter(_x.ge(0)).group_by("user_id").aggregate(lo=min_of("x"), hi=max_of("x")).dataframe(spark), user_id="i", lo="d", hi="d")


for _name, _spec, _sql in (("mean", mean_of, "round(fsum(v) / count(*), 6)"), ("min", min_of, "min(v)"), ("max", max_of, "max(v)")):

    @query(f"agg_{_name}", f"{RECORDS} SELECT t AS event_type, {_sql} AS result FROM r GROUP BY t")
    def _one_metric(spark, sf_dir, spec=_spec):
        return _columns(plan(spark, sf_dir).group_by("event_type").aggregate(result=spec("value")).dataframe(spark), event_type="s", result="d")


@query("limit_beyond_one_task", f"{RECORDS} SELECT o FROM r ORDER BY v DESC, o LIMIT 12000")
def _large_limit(spark, sf_dir):
    return ids(plan(spark, sf_dir).sort_by("value", descending=True).limit(12_000).dataframe(spark))


@query("agg_nested_field", f"{RECORDS} SELECT l AS level, CAST(sum(k) AS BIGINT) AS s, round(avg(k), 6) AS m FROM r GROUP BY l")
def _nested(spark, sf_dir):
    nested = Field("props", "k")
    return _columns(plan(spark, sf_dir).group_by("level").aggregate(s=sum_of(nested), m=mean_of(nested)).dataframe(spark), level="s", s="i", m="d")


# Sources in time order: events dealt to three sources by user, each in order of event.

_MERGED = """WITH s AS (SELECT event_id, user_id % 3 AS src, CASE WHEN event_id % 10 = 9 THEN NULL ELSE ts END AS ts FROM events),
 p AS (SELECT *, max(ts) OVER (PARTITION BY src ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS key,
 last_value(ts IGNORE NULLS) OVER (PARTITION BY src ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s) """


def _time_sources(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.when(F.col("event_id") % 10 != 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows = events.select("event_id", (F.col("user_id") % 3).alias("source_idx"), F.floor(F.col("event_id") / 1000).alias("_block"), F.col("event_id").alias("position"), timestamp(stamp).alias("_ts"))
    return merge_keys(rows)


@query("time_merge", f"{_MERGED} SELECT event_id, row_number() OVER (ORDER BY key NULLS FIRST, src, event_id) - 1 AS place FROM p")
def _time_merge(spark, sf_dir):
    return numbered_by(_time_sources(spark, sf_dir), [F.col("_key").asc_nulls_first(), "source_idx", "event_id"]).select("event_id", F.col("_ord").alias("place"))


@query("time_merge_warnings", f"{_MERGED} SELECT src, count_if(ts < prior) AS out_of_order, count_if(ts IS NULL) AS untimestamped FROM p GROUP BY src")
def _time_warnings(spark, sf_dir):
    return _time_sources(spark, sf_dir).groupBy(F.col("source_idx").alias("src")).agg(F.count_if(F.col("_ts") < F.col("_last")).alias("out_of_order"), F.count_if(F.col("_ts").isNull()).alias("untimestamped"))


# Sources that are read: the events, written as JSON lines into the shared folder.


def _written(spark, sf_dir, parts: Column, names: Callable[[str], str]) -> list[str]:
    """One file per part, named by it, with its events in order."""
    lines = _event_lines(spark, sf_dir).select("_ord", parts.alias("part"), "raw")
    folder = f"{shared_folder(spark)}/recordloom-lines-{uuid.uuid4().hex}"
    out = lines.repartition("part").sortWithinPartitions("part", "_ord").select("part", F.col("raw").alias("value"))
    out.write.partitionBy("part").option("maxRecordsPerFile", 0).text(folder)
    forget_at_exit(spark, folder)
    files = dataset.Files(spark, folder)
    moved = []
    for path in files.modified("part=*/part-*"):
        name = names(path.rpartition("/")[0].rpartition("part=")[2])
        files.replace(path, f"{folder}/{name}")
        moved.append(f"{folder}/{name}")
    return sorted(moved)


def _places(found: DataFrame) -> DataFrame:
    return found.select(lane(F.col("v"), ("event_id",)).integer.cast("long").alias("event_id"), F.col("_ord").alias("place"), F.col("_origin.position").alias("line"))


@query("scan_path", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, row_number() OVER (ORDER BY event_id) AS line FROM events")
def _scan_path(spark, sf_dir):
    return _places(read_records(spark, _written(spark, sf_dir, F.lit("all"), lambda part: f"{part}.log")).df)


@query("concat_sources", "SELECT event_id, row_number() OVER (ORDER BY user_id % 3, event_id) - 1 AS place, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS line FROM events")
def _concat(spark, sf_dir):
    user = F.get_json_object("raw", "$.user_id").cast("long")
    return _places(read_records(spark, _written(spark, sf_dir, user % 3, lambda part: f"source-{part}.log")).df)


@query("rotation_order", "SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 4 WHEN 3 THEN 9 ELSE event_id % 4 END, event_id) - 1 AS place, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events")
def _rotation(spark, sf_dir):
    """Three dated files and the live one, which a glob finds and puts last."""
    paths = _written(spark, sf_dir, F.col("_ord") % 4, lambda part: "app.log" if part == "3" else f"app.log.2026-01-0{int(part) + 1}")
    return _places(read_records(spark, paths[0].rpartition("/")[0].removeprefix("file:") + "/app.log*").df)


# Investigations.


@query("view_of_view", f"{RECORDS} SELECT o FROM r WHERE t = 'error' AND v > 50")
def _views(spark, sf_dir):
    paths = _written(spark, sf_dir, F.lit("all"), lambda part: f"{part}.log")
    session = dataset.Investigation.open(spark, paths, f"{shared_folder(spark)}/recordloom-cache-{uuid.uuid4().hex}")
    forget_at_exit(spark, session.store.root)
    view = session.filter(Field("value").gt(50), session.filter(Field("event_type").eq("error")))
    return ids(view.ordinals.join(session.records(), "_ord").select(lane(F.col("v"), ("event_id",)).integer.cast("long").alias("_ord")))


@query("value_counts", f"{RECORDS} SELECT {_TYPED} AS identity, count(*) AS n, min(o) AS first FROM r WHERE m <> 0 GROUP BY 1")
def _value_counts(spark, sf_dir):
    out = dataset.value_counts(records(spark, sf_dir), ("x",))
    from .functions.lanes import Lane

    return out.select(_identity(Lane(F.col("value"))).alias("identity"), F.try_variant_get("count", "$", "long").alias("n"), "first")


@query("value_counts_bad", f"{RECORDS} SELECT t || ':' || d AS identity, CAST(NULL AS BIGINT) AS n, (SELECT count(*) FROM r) AS bad FROM r WHERE false UNION ALL SELECT 'tags', 0, count(*) FROM r UNION ALL SELECT 'x', count(DISTINCT {_TYPED}), 0 FROM r WHERE m <> 0")
def _value_counts_bad(spark, sf_dir):
    """Values that are arrays are left out and told; of scalars nothing is."""
    base, out = records(spark, sf_dir), []
    for name in ("tags", "x"):
        kept = dataset.value_counts(base, (name,)).agg(F.count(F.lit(1)).alias("n"))
        out.append(kept.crossJoin(F.broadcast(dataset.left_out(base, (name,)))).select(F.lit(name).alias("identity"), "n", F.col("vals").alias("bad")))  # one row each
    return out[0].union(out[1])


@query("group_bad_key", f"{RECORDS} SELECT {_TYPED} AS identity, count(*) AS n FROM r WHERE m <> 4 GROUP BY 1")
def _group_bad_key(spark, sf_dir):
    """Records whose key is an array belong to no group; here every float is made one."""
    array = F.regexp_replace("raw", r'"x":(\d\.0)', r'"x":[$1]')
    df = scan(_event_lines(spark, sf_dir).withColumn("raw", array).withColumn("v", F.try_parse_json("raw"))).group_by("x").aggregate(n=count_rows()).dataframe(spark)
    return df.select(_identity(lane(F.col("v"), ("x",))).alias("identity"), lane(F.col("v"), ("n",)).integer.cast("long").alias("n"))


@query("agg_nonfinite", f"{RECORDS} SELECT d, CAST(CASE WHEN d >= 8 THEN NULL ELSE d END AS DOUBLE) AS mean, CASE WHEN d >= 8 THEN 'null' ELSE 'number' END AS told FROM r WHERE m = 4 GROUP BY d")
def _nonfinite(spark, sf_dir):
    """Sums beyond the range of doubles are told as null; groups of 8 and 9 hold values near its end."""
    digit = F.get_json_object("raw", "$.x").cast("double").cast("long")
    lines = _event_lines(spark, sf_dir).where("_ord % 6 = 4").withColumn("raw", F.concat(F.lit('{"d":'), digit.cast("string"), F.lit(',"x":'), F.when(digit >= 8, "1.7e308").otherwise(F.concat(digit.cast("string"), F.lit(".0"))), F.lit("}")))
    df = scan(lines.withColumn("v", F.try_parse_json("raw"))).group_by("d").aggregate(s=sum_of("x"), m=mean_of("x")).dataframe(spark)
    total = lane(F.col("v"), ("s",))
    return df.select(lane(F.col("v"), ("d",)).integer.cast("long").alias("d"), lane(F.col("v"), ("m",)).double.alias("mean"), F.when(total.is_null, "null").when(total.number & total.finite, "number").alias("told"))


@query("value_counts_grouped", f"{RECORDS} SELECT l AS level, k AS value, count(*) AS n, min(o) AS first FROM r GROUP BY l, k")
def _value_counts_grouped(spark, sf_dir):
    out = dataset.value_counts(records(spark, sf_dir), ("props", "k"), (dataset.GroupBinding(("level",), "level"),))
    return out.select(F.try_variant_get("level", "$", "string").alias("level"), *[F.try_variant_get(a, "$", "long").alias(b) for a, b in (("value", "value"), ("count", "n"))], "first")


def _summary(df: DataFrame, *names: Column) -> DataFrame:
    number = [F.round(F.try_variant_get(c, "$", "double"), 6).alias(c) for c in ("sum", "mean", "min", "max")]
    return df.select(*names, F.try_variant_get("count", "$", "long").alias("count"), *number)


@query("numeric_summary", f"{RECORDS} SELECT count(*) AS count, round(fsum(v), 6) AS sum, round(fsum(v) / count(*), 6) AS mean, min(v) AS min, max(v) AS max FROM r")
def _numeric(spark, sf_dir):
    return _summary(dataset.numeric_summary(records(spark, sf_dir), ("value",)))


@query("numeric_summary_grouped", f"{RECORDS} SELECT u AS user, count(*) AS count, round(fsum(v), 6) AS sum, round(fsum(v) / count(*), 6) AS mean, min(v) AS min, max(v) AS max FROM r GROUP BY u")
def _numeric_grouped(spark, sf_dir):
    out = dataset.numeric_summary(records(spark, sf_dir), ("value",), grouping=(dataset.GroupBinding(("user_id",), "user"),))
    return _summary(out, F.try_variant_get("user", "$", "long").alias("user"))


def _documents(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.to_json(F.struct("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("_ord"), raw.alias("raw"))


@query("search_literal_ci", "SELECT doc_id AS o FROM documents WHERE contains(lower(text), 'thindor')")
def _search_ci(spark, sf_dir):
    return ids(searching.search(_documents(spark, sf_dir), searching.SearchOptions("ThindOR")))


@query("search_whole_word", r"SELECT doc_id AS o FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])pathetic([^\p{L}\p{M}\p{N}_]|$)')")
def _search_word(spark, sf_dir):
    return ids(searching.search(_documents(spark, sf_dir), searching.SearchOptions("pathetic", case_sensitive=True, whole_word=True)))


@query("search_neighbour", f"{RECORDS} SELECT coalesce((SELECT min(o) FROM r WHERE t = 'error' AND o > 500), (SELECT min(o) FROM r WHERE t = 'error')) AS ordinal")
def _neighbour(spark, sf_dir):
    return searching.neighbour(searching.search(records(spark, sf_dir), searching.SearchOptions("app.error")), 500)


_FIELDS = ", ".join(f"('{n}', (SELECT count(*) FROM events), CAST({c} AS BIGINT))" for n, c in (("event_id", 0), ("user_id", 0), ("event_type", 0), ("value", 0), ("level", 0), ("logger", 0), ("k", 0), ("props", "(SELECT count(*) FROM events)"), ("props.k", 0), ("tags", "(SELECT count(*) FROM events)")))


@query("discover_fields", f"SELECT * FROM (VALUES {_FIELDS}, ('x', (SELECT count(*) FROM events WHERE event_id % 6 <> 0), CAST(0 AS BIGINT))) AS f(spelling, occurrences, collections)")
def _discover_fields(spark, sf_dir):
    return discovery.fields(discovery.entries(records(spark, sf_dir))).select("spelling", "occurrences", "collections")


@query("discover_values", f"{RECORDS} SELECT CASE m WHEN 1 THEN 'null' WHEN 2 THEN 'boolean' WHEN 5 THEN 'string' ELSE 'number' END AS kind, CASE m WHEN 1 THEN 'null' WHEN 2 THEN CASE WHEN d % 2 = 0 THEN 'true' ELSE 'false' END WHEN 3 THEN CAST(d AS VARCHAR) WHEN 4 THEN d || '.0' ELSE '\"' || d || '\"' END AS spelling, count(*) AS n FROM r WHERE m <> 0 GROUP BY ALL")
def _discover_values(spark, sf_dir):
    return discovery.values(discovery.entries(records(spark, sf_dir)), ("x",)).select("kind", "spelling", "n")


@query("discover_array_elements", f"{RECORDS} SELECT spelling, count(*) AS n FROM (SELECT '\"' || t || '\"' AS spelling FROM r UNION ALL SELECT CAST(d AS VARCHAR) FROM r) GROUP BY spelling")
def _discover_elements(spark, sf_dir):
    return discovery.values(discovery.entries(records(spark, sf_dir)), ("tags",), source="array_element").select("spelling", "n")


# Traces: a customer is a trace, an order a span, a line item a span below it. Orders divisible by 7 left no record,
# those by 11 name their first line item as parent (a cycle), those by 13 name two parents.

_SPANS = """WITH o AS (SELECT *, o_orderkey % 7 <> 0 AS seen FROM orders), l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, o_custkey, seen FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL),
 one AS (SELECT DISTINCT l_orderkey FROM l WHERE l_linenumber = 1),
 s AS (SELECT 'c' || o_custkey AS trace, 'o' || o_orderkey AS span, CASE WHEN o_orderkey % 13 = 0 THEN 'conflicting parents' WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey IN (FROM one) THEN 'cycle' ELSE 'parent observed' END ELSE 'root' END AS relationship,
 CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'complete' ELSE 'conflicting' END AS lifecycle, 2 AS record_count, o_orderkey * 100 AS first, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey NOT IN (FROM one) THEN 'l' || o_orderkey || '-1' END AS up FROM o WHERE seen
 UNION ALL SELECT 'c' || o_custkey, 'l' || l_orderkey || '-' || l_linenumber, CASE WHEN seen AND l_orderkey % 11 = 0 AND l_orderkey % 13 <> 0 AND l_linenumber = 1 THEN 'cycle' ELSE 'parent observed' END, 'incomplete', 1, l_orderkey * 100 + l_linenumber,
 CASE WHEN NOT (seen AND l_orderkey % 11 = 0 AND l_orderkey % 13 <> 0 AND l_linenumber = 1) THEN 'o' || l_orderkey END FROM l),
 p AS (SELECT trace, up AS span, min(first) AS first FROM s WHERE up IS NOT NULL AND (trace, up) NOT IN (SELECT (trace, span) FROM s) GROUP BY ALL) """


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    o, trace = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey"))
    span = F.concat(F.lit("o"), o)
    seen = orders.where(o % 7 != 0)

    def line(event: str, span_id, parent, *more) -> Column:
        return F.to_json(F.struct(trace.alias("trace_id"), span_id.alias("span_id"), F.lit(event).alias("event"), parent.alias("parent_span_id"), *more))

    nothing = F.lit(None).cast("string")
    start = seen.select((o * 100).alias("_ord"), line("span.start", span, F.when(o % 11 == 0, F.concat(F.lit("l"), o, F.lit("-1"))), F.lit("order").alias("span")).alias("raw"))
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("other")
    end = seen.select((o * 100 + 99).alias("_ord"), line("span.end", span, F.when(o % 13 == 0, "zz"), status.alias("status"), (o % 1000).alias("duration_ms")).alias("raw"))
    joined = items.join(orders, F.col("l_orderkey") == o)
    child = F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    item = joined.select((o * 100 + F.col("l_linenumber")).alias("_ord"), line("span.end", child, span, F.lit("ok").alias("status"), F.col("l_quantity").alias("duration_ms"), nothing.alias("span")).alias("raw"))
    return start.union(end).union(item).withColumn("v", F.try_parse_json("raw"))


@query("trace_nodes", f"{_SPANS} SELECT kind, count(*) AS n, CAST(sum(first) AS BIGINT) AS firsts FROM (SELECT 'span' AS kind, first FROM s UNION ALL SELECT 'placeholder', first FROM p UNION ALL SELECT 'trace', min(first) FROM s GROUP BY trace) GROUP BY kind")
def _trace_nodes(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("firsts"))


@query("trace_lifecycle", f"{_SPANS} SELECT trace, span, lifecycle, CAST(record_count AS BIGINT) AS record_count FROM s")
def _trace_lifecycle(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).nodes.where("kind = 'span'").select("trace", "span", "lifecycle", "record_count")


@query("trace_relationship", f"{_SPANS} SELECT trace, span, relationship FROM s UNION ALL SELECT trace, span, 'missing parent' FROM p")
def _trace_relationship(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).nodes.where("kind <> 'trace'").select("trace", "span", "relationship")


@query("trace_placeholder", f"{_SPANS} SELECT trace, span, first FROM p")
def _trace_placeholder(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).nodes.where("kind = 'placeholder'").select("trace", "span", "first")


@query("trace_cycle", f"{_SPANS} SELECT trace, span FROM s WHERE relationship = 'cycle'")
def _trace_cycle(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).nodes.where("relationship = 'cycle'").select("trace", "span")


@query("trace_child_counts", f"{_SPANS} SELECT trace, count(*) AS child_count FROM (SELECT trace FROM s WHERE up IS NULL UNION ALL SELECT trace FROM p) GROUP BY trace")
def _trace_children(spark, sf_dir):
    return tracetree.build_tree(trace_records(spark, sf_dir)).counted().where("kind = 'trace'").select("trace", "child_count")


@query("trace_filtered_context", f"{_SPANS}, a AS (SELECT trace, span, up FROM s WHERE span LIKE '%-3' AND first % 10 = 3), c AS (SELECT trace, span, true AS own FROM a UNION SELECT trace, up, false FROM a UNION SELECT trace, NULL, false FROM a), cy AS (SELECT s.trace, 'l' || substr(s.span, 2) || '-1' AS span FROM s JOIN a ON a.trace = s.trace AND a.up = s.span WHERE s.up IS NOT NULL) SELECT trace, span, CAST(own AS BIGINT) AS match_count, NOT own AS context_only FROM c UNION SELECT trace, span, 0, true FROM cy")
def _trace_filtered(spark, sf_dir):
    base = trace_records(spark, sf_dir)
    admitted = base.where(lower(Field("span_id").regex("-3$"), lambda p: lane(F.col("v"), p)))
    out = tracetree.build_tree(base).filtered(admitted)
    return out.select("trace", "span", "match_count", "context_only")


@query("tree_navigation", f"{_SPANS} SELECT trace, count(*) AS above, min(first) AS first_child FROM (SELECT trace, first FROM s WHERE up IS NULL UNION ALL SELECT trace, first FROM p) GROUP BY trace")
def _navigation(spark, sf_dir):
    """The children of each trace by place, and the first of them."""
    tree = tracetree.build_tree(trace_records(spark, sf_dir))
    placed = tree.placed().where("not is_record").join(tree.held.where("kind = 'trace'").select(F.col("key").alias("parent"), "trace"), "parent")
    return placed.groupBy("trace").agg((F.max("place") + 1).cast("long").alias("above"), F.min_by("first", "place").alias("first_child"))


@query("completion_choices", f"{RECORDS} SELECT '\"' || t || '\"' AS insertion, count(*) AS n FROM r WHERE t LIKE 'p%' OR t LIKE 's%' GROUP BY t")
def _completion(spark, sf_dir):
    """Values that discovery adds to a draft; each choice's count comes from the index."""
    found = discovery.entries(records(spark, sf_dir))
    chosen = [c for start in "ps" for c in discovery.complete(found, complete_filter(f'event_type == "{start}')).choices if c.description]
    told = spark.createDataFrame([(c.insertion,) for c in chosen], "insertion string")
    return discovery.values(found, ("event_type",)).join(F.broadcast(told), F.col("spelling") == F.col("insertion")).select("insertion", "n")


@query("restore_records", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'record_disappeared' WHEN event_id % 10 = 1 THEN 'record_changed' ELSE 'restored' END AS outcome FROM events) GROUP BY outcome")
def _restore(spark, sf_dir):
    old = _event_lines(spark, sf_dir).select("_ord", F.lit("events").alias("source"), F.lit(0).alias("occurrence"), F.col("_ord").alias("line"), "raw")
    new = old.where("_ord % 10 <> 0").withColumn("raw", F.when(F.col("_ord") % 10 == 1, F.concat("raw", F.lit(" "))).otherwise(F.col("raw")))
    return dataset.restored(old, new).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("validate_records", "SELECT event_id AS o, CASE event_id % 4 WHEN 1 THEN 'missing required field: line' WHEN 2 THEN 'invalid type for field: line' WHEN 3 THEN 'invalid value for field: event' END AS reason FROM events")
def _validate(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    kind = F.col("_ord") % 4
    head = F.lit('{"timestamp":"2026-01-01T00:00:00Z","level":"INFO","logger":"a","message":"m","file":"f","func":"g"')
    tail = F.when(kind == 1, "}").when(kind == 2, ',"line":true}').when(kind == 3, ',"line":1,"event":"span.stop"}').otherwise(',"line":1,"event":"span.end","duration_ms":1.5}')
    return contract.validated(lines.select("_ord", F.try_parse_json(F.concat(head, tail)).alias("v"))).select(F.col("_ord").alias("o"), "reason")


@query("flatten_ctx_collision", "SELECT event_id AS o, CASE event_id % 3 WHEN 0 THEN 'ctx_level,user' WHEN 1 THEN 'ctx_ctx_level,ctx_level' ELSE 'user' END AS names FROM events")
def _flatten(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    kind = F.col("_ord") % 3
    context = F.when(kind == 0, F.create_map(F.lit("level"), F.lit("a"), F.lit("user"), F.lit("b"))).when(kind == 1, F.create_map(F.lit("level"), F.lit("a"), F.lit("ctx_level"), F.lit("b"))).otherwise(F.create_map(F.lit("user"), F.lit("b")))
    return lines.select(F.col("_ord").alias("o"), F.concat_ws(",", F.array_sort(F.map_keys(contract.flatten_keys(context)))).alias("names"))
