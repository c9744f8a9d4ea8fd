"""Immutable query plans over records, lowered to one lazy DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from decimal import Decimal, localcontext
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ToolError
from ..expressions import And, Expression, Field, Not, Or, lower
from ..functions.exact import exact_sums, exponent, rounded, units
from ..functions.lanes import Lane, lane
from ..sources.records import Records, numbered_by, read_records

METRICS = ("count", "sum", "mean", "min", "max")
#: Rows that a limit takes through one task, at most.
TOP = 10_000


@dataclass(frozen=True)
class AggregateSpec:
    op: str
    path: tuple[str, ...] | None = None


def count_rows() -> AggregateSpec:
    return AggregateSpec("count")


def _path(field: str | Field) -> tuple[str, ...]:
    return field.path if isinstance(field, Field) else Field(field).path


def sum_of(field) -> AggregateSpec:
    return AggregateSpec("sum", _path(field))


def mean_of(field) -> AggregateSpec:
    return AggregateSpec("mean", _path(field))


def min_of(field) -> AggregateSpec:
    return AggregateSpec("min", _path(field))


def max_of(field) -> AggregateSpec:
    return AggregateSpec("max", _path(field))


@dataclass(frozen=True)
class Filter:
    expression: Expression


@dataclass(frozen=True)
class Project:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Limit:
    count: int


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool
    missing: str
    nulls: str


@dataclass(frozen=True)
class Aggregate:
    keys: tuple[str, ...]
    specs: tuple[tuple[str, AggregateSpec], ...]


@dataclass
class PlanResult:
    records: list[dict]
    schema: list[str]
    origins: list[dict | None]
    warnings: list[str]
    metadata: dict


def _names(names: tuple, what: str) -> tuple[str, ...]:
    if not names or not all(isinstance(n, str) and n for n in names) or len(set(names)) != len(names):
        raise ValueError(f"{what} needs distinct non-empty names")
    return tuple(names)


@dataclass(frozen=True)
class QueryPlan:
    """A chain of operations; the order of calls is the order of meaning."""

    source: Any
    order: str = "concat"
    operations: tuple = ()

    def _then(self, operation) -> QueryPlan:
        return replace(self, operations=(*self.operations, operation))

    def filter(self, expression: Expression) -> QueryPlan:
        if not isinstance(expression, Expression):
            raise TypeError("filter needs an expression")
        return self._then(Filter(expression))

    def select(self, *fields: str) -> QueryPlan:
        return self._then(Project(_names(fields, "select")))

    def limit(self, count: int) -> QueryPlan:
        if isinstance(count, bool) or not isinstance(count, int) or count < 0:
            raise ValueError("limit needs a whole number that is not negative")
        return self._then(Limit(count))

    def sort_by(self, field: str, *, descending: bool = False, missing: str = "last", nulls: str = "last") -> QueryPlan:
        if missing not in ("first", "last") or nulls not in ("first", "last"):
            raise ValueError("placement is 'first' or 'last'")
        return self._then(Sort(_names((field,), "sort_by")[0], bool(descending), missing, nulls))

    def group_by(self, *keys: str) -> GroupedPlan:
        return GroupedPlan(self, _names(keys, "group_by"))

    def aggregate(self, **specs: AggregateSpec) -> QueryPlan:
        return self._aggregate((), specs)

    def _aggregate(self, keys: tuple[str, ...], specs: dict[str, AggregateSpec]) -> QueryPlan:
        if not specs or not all(isinstance(s, AggregateSpec) and s.op in METRICS for s in specs.values()):
            raise ValueError("aggregate needs named aggregate specifications")
        if set(keys) & set(specs):
            raise ValueError("an alias must not be a group key")
        return self._then(Aggregate(keys, tuple(specs.items())))

    # Static analysis: none of it touches a source.

    def validate(self) -> list[str] | None:
        """The closed schema, or None while it is open."""
        schema: list[str] | None = None

        def check(i: int, path: tuple[str, ...]) -> None:
            if schema is not None and path[0] not in schema:
                raise ToolError("plan_invalid", f"field {path[0]!r} is not in the schema", operation=i, field=path[0])

        for i, op in enumerate(self.operations):
            if isinstance(op, Filter):
                for path in sorted(op.expression.required_fields()):
                    check(i, path)
            elif isinstance(op, Project):
                for name in op.names:
                    check(i, (name,))
                schema = list(op.names)
            elif isinstance(op, Sort):
                check(i, (op.field,))
            elif isinstance(op, Aggregate):
                for key in op.keys:
                    check(i, (key,))
                for _, spec in op.specs:
                    if spec.path:
                        check(i, spec.path)
                schema = [*op.keys, *(n for n, _ in op.specs)]
        return schema

    def normalized(self) -> tuple[tuple, list[str]]:
        """Operations after static rewrites, and the rewrites' names. Catalyst repeats them; this is for explain."""
        out: list = []
        done: list[str] = []
        for op in self.operations:
            if isinstance(op, Filter):
                plain = simplified(op.expression)
                if plain != op.expression:
                    done.append("simplify_boolean")
                op = Filter(plain)
            last = out[-1] if out else None
            if isinstance(op, Limit) and isinstance(last, Limit):
                out[-1] = Limit(min(op.count, last.count))
                done.append("combine_limits")
            elif isinstance(op, Project) and isinstance(last, Project):
                out[-1] = op
                done.append("collapse_projections")
            elif isinstance(op, Filter) and isinstance(last, Filter):
                out[-1] = Filter(simplified(And((last.expression, op.expression))))
                done.append("combine_filters")
            else:
                out.append(op)
        if any(isinstance(op, Limit) and op.count == 0 for op in self.operations):
            done.append("empty_source")
        return tuple(out), done

    def explain(self) -> dict:
        schema = self.validate()
        operations, rewrites = self.normalized()
        fields: set[tuple[str, ...]] = set()
        bound: int | None = None
        ordering = self.order
        for op in self.operations:
            if isinstance(op, Filter):
                fields |= op.expression.required_fields()
            elif isinstance(op, Sort):
                fields.add((op.field,))
                ordering = f"{op.field} {'descending' if op.descending else 'ascending'}, source order"
            elif isinstance(op, Aggregate):
                fields |= {(k,) for k in op.keys} | {s.path for _, s in op.specs if s.path}
                ordering = "first appearance"
                bound = None if op.keys else 1
            elif isinstance(op, Limit):
                bound = op.count if bound is None else min(bound, op.count)
        checks = [f"{type(op).__name__.lower()}:{i}" for i, op in enumerate(self.operations) if isinstance(op, (Sort, Aggregate))]
        return {
            "operations": [_described(op) for op in operations], "rewrites": rewrites, "required_fields": sorted(map(list, fields)),
            "schema": schema, "ordering": ordering, "output_bound": bound, "pending_checks": checks,
        }

    # Lowering.

    def dataframe(self, spark: SparkSession) -> DataFrame:
        """The lazy result: _ord, _origin, raw, v, in no particular physical order; ``ordered`` sorts it."""
        return self._lowered(spark).df

    def ordered(self, spark: SparkSession) -> DataFrame:
        state = self._lowered(spark)
        return state.df.orderBy(*state.ordering)

    def _lowered(self, spark: SparkSession, checks: list | None = None, records: Records | None = None) -> _State:
        self.validate()
        source = self.source if isinstance(self.source, DataFrame) else (records or read_records(spark, self.source, self.order)).df
        state = _State(source.select("_ord", "_origin", "raw", "v"), (F.col("_ord"),), None)
        if any(isinstance(op, Limit) and op.count == 0 for op in self.operations):
            state = replace(state, df=state.df.limit(0))
            checks = None
        for i, op in enumerate(self.operations):
            state = _step(state, i, op, checks)
        return state

    def execute(self, spark: SparkSession) -> PlanResult:
        """Runs the plan and brings the result to the driver; data that an operation cannot take raises data_incompatible."""
        schema = self.validate()
        empty = any(isinstance(op, Limit) and op.count == 0 for op in self.operations)
        records = None if isinstance(self.source, DataFrame) or empty else read_records(spark, self.source, self.order)
        checks: list = []
        plan = replace(self, source=spark.createDataFrame([], "_ord long, _origin struct<source:string,position:bigint,kind:string>, raw string, v variant")) if empty else self
        state = plan._lowered(spark, checks, records)
        for check in checks:
            check()
        rows = state.df.orderBy(*state.ordering).select("_origin", "raw", "v").collect()
        out = [_record(r, state.fields) for r in rows]
        if schema is None:
            schema = list(dict.fromkeys(k for r in out for k in r))
        metadata = {"output_rows": len(out)}
        if records is not None:
            metadata |= {"input_rows": records.df.count(), "skipped_lines": records.skipped.count()}
        return PlanResult(out, schema, [r["_origin"].asDict() if r["_origin"] else None for r in rows], records.warnings() if records else [], metadata)


@dataclass(frozen=True)
class GroupedPlan:
    plan: QueryPlan
    keys: tuple[str, ...]

    def aggregate(self, **specs: AggregateSpec) -> QueryPlan:
        return self.plan._aggregate(self.keys, specs)


def scan(sources, *, order: str = "concat") -> QueryPlan:
    """A plan over paths, globs, ``"-"`` or mappings, or over a record DataFrame. Reads nothing."""
    if order not in ("concat", "time"):
        raise ToolError("plan_invalid", f"unknown order {order!r}")
    return QueryPlan(sources, order)


def simplified(e: Expression) -> Expression:
    """Nested conjunctions and disjunctions flattened, single ones unwrapped, double negations removed."""
    if isinstance(e, Not):
        inner = simplified(e.part)
        return inner.part if isinstance(inner, Not) else Not(inner)
    if isinstance(e, (And, Or)):
        parts = []
        for p in map(simplified, e.parts):
            parts += p.parts if type(p) is type(e) else (p,)
        return parts[0] if len(parts) == 1 else type(e)(tuple(parts))
    return e


def _described(op) -> dict:
    out = {"op": type(op).__name__.lower()}
    for name, value in vars(op).items():
        out[name] = value.explain() if isinstance(value, Expression) else value
    return out


@dataclass(frozen=True)
class _State:
    df: DataFrame
    ordering: tuple[Column, ...]
    fields: tuple[str, ...] | None


def _step(state: _State, i: int, op, checks: list | None) -> _State:
    df, v = state.df, F.col("v")
    if isinstance(op, Filter):
        return replace(state, df=df.where(lower(op.expression, lambda path: lane(v, path))))
    if isinstance(op, Project):
        return replace(state, fields=op.names)
    if isinstance(op, Limit):
        if op.count <= TOP:
            return replace(state, df=df.orderBy(*state.ordering).limit(op.count))
        # More rows than one task should hold are numbered in their order and cut off by number.
        placed = numbered_by(df, list(state.ordering), f"_limit{i}")
        return replace(state, df=placed.where(F.col(f"_limit{i}") < op.count).drop(f"_limit{i}"))
    if isinstance(op, Sort):
        return _sorted(state, i, op, checks)
    return _aggregated(state, i, op, checks)


def _sorted(state: _State, i: int, op: Sort, checks: list | None) -> _State:
    x = lane(F.col("v"), (op.field,))
    place = F.when(~x.present, 0 if op.missing == "first" else 4).when(x.is_null, 1 if op.nulls == "first" else 3).otherwise(2)
    names = [f"_sort{i}_{n}" for n in ("place", "number", "exact", "text")]
    df = state.df.withColumns(dict(zip(names, (place, x.double, x.residual, x.string), strict=True)))
    way = (lambda c: F.col(c).desc()) if op.descending else (lambda c: F.col(c).asc())
    if checks is not None:
        kind = F.when(x.number & x.finite, "number").when(x.string.isNotNull(), "str").when(x.present & ~x.is_null, "other")
        kinds = state.df.agg(F.collect_set(kind).alias("kinds"))

        def check():
            found = set(kinds.first()["kinds"])
            if "other" in found or len(found) > 1:
                raise ToolError("data_incompatible", f"{op.field!r} cannot be sorted: {sorted(found)}", field=op.field, operation=i)

        checks.append(check)
    return replace(state, df=df, ordering=(F.col(names[0]).asc(), *(way(n) for n in names[1:]), F.col("_ord").asc()))


def grouped(df: DataFrame, keys: dict[str, Lane], specs: dict[str, tuple[str, Lane | None]], present: Lane | None = None) -> DataFrame:
    """Groups by typed identity: ``first`` (least _ord), a VARIANT per key (the first record's), one per spec, and ``bad`` counts.

    An op is one of METRICS. Values that are no finite numbers count in ``bad``
    and are left out; records whose key is no scalar count in ``_bad_key``, in
    groups that callers leave out or refuse. A result beyond the range of doubles
    is null and counts in ``_bad``. ``present`` restricts the rows to those that
    have it.
    """
    if present is not None:
        df = df.where(present.present)
    ids: dict[str, Column] = {}
    for n, k in enumerate(keys.values()):
        ids |= {f"_k{n}": k.group, f"_c{n}": F.coalesce(k.canonical, F.lit("")), f"_x{n}": k.x}
    names = [f"_{c}{n}" for n in range(len(keys)) for c in "kc"]
    values = {}
    for n, (_, (_, x)) in enumerate(specs.items()):
        if x is not None:
            ok = x.number & x.finite
            values |= {f"_d{n}": F.when(ok, x.double), f"_i{n}": F.when(ok, x.integer), f"_r{n}": F.when(ok, x.residual), f"_v{n}": F.when(ok, x.x), f"_b{n}": x.present & ~x.is_null & ~ok}
    base = df.select("_ord", *[c.alias(n) for n, c in (ids | values).items()])
    bad_key = reduce(lambda a, b: a | b, (F.col(f"_k{n}").isin("array", "object", "other") for n in range(len(keys))), F.lit(False))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    # Each result as (column, aggregate over rows, aggregate over those).
    steps = [("_first", F.min("_ord"), F.min("_first").alias("_first")), ("_bad_key", F.count_if(bad_key), total("_bad_key"))]
    steps += [(f"_x{n}", F.min_by(f"_x{n}", "_ord"), F.min_by(f"_x{n}", "_first").alias(f"_x{n}")) for n in range(len(keys))]
    sums: dict[int, int] = {}  # a spec that needs an exact sum, and the first spec over the same lane
    for n, (_, (op, x)) in enumerate(specs.items()):
        if x is not None:
            steps.append((f"_bad{n}", F.count_if(f"_b{n}"), total(f"_bad{n}")))
        if op == "count":
            steps.append((f"_out{n}", F.count(F.lit(1)), total(f"_out{n}")))
        elif op in ("sum", "mean"):
            sums[n] = next((m for m in sums if list(specs.values())[m][1] is x), n)
            steps += [(c, f(v), total(c)) for c, f, v in ((f"_n{n}", F.count, f"_d{n}"), (f"_ni{n}", F.count, f"_i{n}"), (f"_si{n}", F.sum, f"_i{n}"))]
        else:
            pick, best, tie = (F.min_by, F.min, F.col("_ord")) if op == "min" else (F.max_by, F.max, -F.col("_ord"))
            rank = F.when(F.col(f"_d{n}").isNotNull(), F.struct(F.col(f"_d{n}").alias("d"), F.col(f"_r{n}").alias("r"), tie.alias("o")))
            steps += [(f"_at{n}", best(rank), best(f"_at{n}").alias(f"_at{n}")), (f"_out{n}", pick(f"_v{n}", rank), pick(f"_out{n}", f"_at{n}").alias(f"_out{n}"))]
    lead = next(iter(sums), None)
    if lead is None:
        out = base.groupBy(*names).agg(*[one.alias(c) for c, one, _ in steps])
    else:
        # The first exact sum rides along: its units add up by exponent, and groups gather their few exponents.
        d = F.col(f"_d{lead}")
        first = base.groupBy(*names, exponent(d).alias("_e")).agg(*[one.alias(c) for c, one, _ in steps], F.sum(units(d)).alias("_units"))
        parts = F.collect_list(F.when(F.col("_units").isNotNull(), F.struct(F.col("_e").alias("exponent"), F.col("_units").cast("string").alias("units"))))
        out = first.groupBy(*names).agg(*[two for _, _, two in steps], parts.alias("_parts"))
        out = out.withColumn(f"_sd{lead}", rounded("_parts"))
    for n in sorted(set(sums.values()) - {lead}):
        more = exact_sums(base, names, f"_d{n}", f"_sd{n}")
        out = out.join(more, names, "left") if names else out.crossJoin(F.broadcast(more))  # one row
    for n, m in sums.items():
        whole = F.col(f"_n{n}") == F.col(f"_ni{n}")
        small = F.abs(F.col(f"_si{n}")) < F.lit(Decimal(2**63))
        as_int = F.when(small, F.col(f"_si{n}").cast("bigint").cast("variant")).otherwise(F.col(f"_si{n}").cast("variant"))
        if list(specs.values())[n][0] == "sum":
            value = F.when(F.col(f"_n{n}") == 0, F.lit(0).cast("bigint").cast("variant")).when(whole, as_int).otherwise(F.col(f"_sd{m}").cast("variant"))
        else:
            mean = F.when(whole, F.col(f"_si{n}").cast("double")).otherwise(F.col(f"_sd{m}"))
            value = F.when(F.col(f"_n{n}") > 0, (mean / F.col(f"_n{n}")).cast("variant"))
        beyond = F.coalesce(~whole & (F.abs(F.col(f"_sd{m}")) == float("inf")), F.lit(False))
        out = out.withColumn(f"_out{n}", F.when(~beyond, value)).withColumn(f"_bad{n}", F.col(f"_bad{n}") + beyond.cast("long"))
    shown = [F.col(f"_x{n}").alias(k) for n, k in enumerate(keys)]
    shown += [(F.col(f"_out{n}") if (op != "count") else F.col(f"_out{n}").cast("variant")).alias(name) for n, (name, (op, _)) in enumerate(specs.items())]
    bad = [F.col("_bad_key"), *(F.col(f"_bad{n}").alias(f"_bad:{name}") for n, (name, (_, x)) in enumerate(specs.items()) if x is not None)]
    return out.select(F.col("_first"), *shown, *bad)


def _aggregated(state: _State, i: int, op: Aggregate, checks: list | None) -> _State:
    v = F.col("v")
    keys = {k: lane(v, (k,)) for k in op.keys}
    lanes = {s.path: lane(v, s.path) for _, s in op.specs if s.path}
    specs = {n: (s.op, lanes.get(s.path)) for n, s in op.specs}
    out = grouped(state.df, keys, specs)
    bads = [c for c in out.columns if c.startswith("_bad")]
    whole, out = out, out.where("_bad_key = 0")
    if checks is not None:

        def check():
            found = whole.agg(*[F.sum(f"`{c}`").alias(c) for c in bads]).first()
            for c in bads:
                if found[c]:
                    name = c.partition(":")[2]
                    raise ToolError("data_incompatible", f"{'a group key' if not name else name!r} has values that it cannot take", field=name or None, operation=i)

        checks.append(check)
    null = F.parse_json(F.lit("null"))
    metric = {n: F.coalesce(F.col(f"`{n}`"), null) for n, _ in op.specs}
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in (*op.keys, *metric)]), F.array(*[F.col(f"`{k}`") for k in op.keys], *metric.values()))
    df = out.select(F.col("_first").alias("_ord"), F.lit(None).cast("struct<source:string,position:bigint,kind:string>").alias("_origin"), F.lit(None).cast("string").alias("raw"), F.to_variant_object(F.map_filter(pairs, lambda _, x: x.isNotNull())).alias("v"))
    if not op.keys:
        df = df.withColumn("_ord", F.coalesce("_ord", F.lit(0)))
    return _State(df, (F.col("_ord"),), (*op.keys, *(n for n, _ in op.specs)))


def plain(value: Any) -> Any:
    """A VARIANT's Python value with decimals as numbers."""
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() and abs(value) >= 2**63 else float(value)
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return [plain(x) for x in value] if isinstance(value, list) else value


def _record(row, fields: tuple[str, ...] | None) -> dict:
    with localcontext() as context:
        context.prec = 80  # decoding a VARIANT's decimal rounds to the context
        record = json.loads(row["raw"]) if row["raw"] is not None else plain(row["v"].toPython())
    return record if fields is None else {f: record[f] for f in fields if f in record}
