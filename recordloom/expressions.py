"""Typed predicates over records, and their lowering to Spark columns.

Every predicate is two-valued: a missing or incompatible value makes a test
false, and ``not_`` turns that into true.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.lanes import EXACT, Lane

#: Patterns of these parts mean the same in Python and Java on any text.
_PORTABLE = re.compile(r"(?:[A-Za-z0-9 _\-/:,=@#%&~<>!;'\"]|\\[.\[\](){}*+?^|\\/-]|\^|(?:\[\^?[A-Za-z0-9_. \-]+\]|[A-Za-z0-9 ]|\\\.)[*+?]?|[|()])*")


def _snapshot(value: Any, seen: tuple = ()) -> Any:
    """A frozen copy of a finite JSON value."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a literal must be finite")
        return value
    if id(value) in seen:
        raise ValueError("a literal must not contain itself")
    if isinstance(value, (list, tuple)):
        return tuple(_snapshot(v, (*seen, id(value))) for v in value)
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys of a literal must be strings")
        return _Frozen({k: _snapshot(v, (*seen, id(value))) for k, v in value.items()})
    raise TypeError(f"not a JSON value: {value!r}")


class _Frozen(dict):
    def __hash__(self):
        return hash(tuple(sorted((k, repr(v)) for k, v in self.items())))


def _scalar(value: Any) -> bool:
    return not isinstance(value, (tuple, dict))


class Expression:
    def __bool__(self):
        raise TypeError("combine expressions with & | ~ or all_of, any_of, not_")

    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)

    def children(self) -> tuple[Expression, ...]:
        return ()

    def required_fields(self) -> frozenset[tuple[str, ...]]:
        own = {self.field.path} if hasattr(self, "field") else set()
        return frozenset(own.union(*(c.required_fields() for c in self.children())))

    def explain(self) -> dict:
        return {"version": 1, "expression": self._tree()}

    def _tree(self) -> dict:
        out: dict[str, Any] = {"node": type(self).__name__}
        for name, value in vars(self).items():
            if isinstance(value, Expression):
                out[name] = value._tree()
            elif isinstance(value, FieldRef):
                out[name] = list(value.path)
            elif isinstance(value, tuple) and value and isinstance(value[0], Expression):
                out[name] = [v._tree() for v in value]
            else:
                out[name] = value.value if isinstance(value, Literal) else value
        return out


@dataclass(frozen=True)
class FieldRef:
    path: tuple[str, ...]

    def __post_init__(self):
        if not self.path or not all(isinstance(p, str) and p for p in self.path):
            raise ValueError("a field path needs non-empty strings")


@dataclass(frozen=True)
class Literal:
    value: Any

    def __post_init__(self):
        object.__setattr__(self, "value", _snapshot(self.value))


@dataclass(frozen=True)
class Compare(Expression):
    op: str
    field: FieldRef
    literal: Literal

    def __post_init__(self):
        if self.op not in ("eq", "ne", "gt", "ge", "lt", "le"):
            raise ValueError(f"unknown comparison {self.op}")
        value = self.literal.value
        if self.op not in ("eq", "ne") and (isinstance(value, bool) or not isinstance(value, (int, float, str))):
            raise TypeError("ordering needs a number or a string")


@dataclass(frozen=True)
class In(Expression):
    field: FieldRef
    values: tuple[Any, ...]
    negated: bool = False

    def __post_init__(self):
        values = tuple(_snapshot(v) for v in self.values)
        if not all(map(_scalar, values)):
            raise TypeError("candidates must be scalars")
        object.__setattr__(self, "values", values)


@dataclass(frozen=True)
class Exists(Expression):
    field: FieldRef


@dataclass(frozen=True)
class StringMatch(Expression):
    kind: str
    field: FieldRef
    pattern: str

    def __post_init__(self):
        if self.kind not in ("regex", "starts_with", "contains"):
            raise ValueError(f"unknown string test {self.kind}")
        if not isinstance(self.pattern, str):
            raise TypeError("a string test needs a string")
        if self.kind == "regex":
            try:
                re.compile(self.pattern)
            except re.error as error:
                raise ValueError(f"invalid pattern: {error}") from error


@dataclass(frozen=True)
class ArrayContains(Expression):
    field: FieldRef
    values: tuple[Any, ...]
    every: bool

    def __post_init__(self):
        values = tuple(_snapshot(v) for v in self.values)
        if not all(map(_scalar, values)):
            raise TypeError("candidates must be scalars")
        object.__setattr__(self, "values", values)


@dataclass(frozen=True)
class _Many(Expression):
    parts: tuple[Expression, ...]

    def __post_init__(self):
        if not all(isinstance(p, Expression) for p in self.parts):
            raise TypeError("parts must be expressions")

    def children(self):
        return self.parts


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True)
class Not(Expression):
    part: Expression

    def __post_init__(self):
        if not isinstance(self.part, Expression):
            raise TypeError("the part must be an expression")

    def children(self):
        return (self.part,)


class Field:
    """Builds predicates on one path: ``Field("a.b")`` is a literal key, ``Field("a", "b")`` is nested."""

    def __init__(self, *path: str):
        self.ref = FieldRef(tuple(path))

    @property
    def path(self) -> tuple[str, ...]:
        return self.ref.path

    def eq(self, value):
        return Compare("eq", self.ref, Literal(value))

    def ne(self, value):
        return Compare("ne", self.ref, Literal(value))

    def gt(self, value):
        return Compare("gt", self.ref, Literal(value))

    def ge(self, value):
        return Compare("ge", self.ref, Literal(value))

    def lt(self, value):
        return Compare("lt", self.ref, Literal(value))

    def le(self, value):
        return Compare("le", self.ref, Literal(value))

    def in_(self, values):
        return In(self.ref, tuple(values))

    def not_in(self, values):
        return In(self.ref, tuple(values), True)

    def contains_any(self, values):
        return ArrayContains(self.ref, tuple(values), False)

    def contains_all(self, values):
        return ArrayContains(self.ref, tuple(values), True)

    def exists(self):
        return Exists(self.ref)

    def missing(self):
        return Not(Exists(self.ref))

    def regex(self, pattern):
        return StringMatch("regex", self.ref, pattern)

    def starts_with(self, prefix):
        return StringMatch("starts_with", self.ref, prefix)

    def contains(self, text):
        return StringMatch("contains", self.ref, text)


def all_of(*parts: Expression) -> Expression:
    return And(tuple(parts))


def any_of(*parts: Expression) -> Expression:
    return Or(tuple(parts))


def not_(part: Expression) -> Expression:
    return Not(part)


def logger_prefix(name: str, field: str = "logger") -> Expression:
    """The logger itself or one below it."""
    return Or((Field(field).eq(name), Field(field).starts_with(name + ".")))


# Lowering.


def _no() -> Column:
    return F.lit(False)


def _sure(test: Column) -> Column:
    return F.coalesce(test, _no())


def _number_test(lane: Lane, value: int | float, op: str) -> Column:
    tests: dict[str, Callable[[Column, Column], Column]] = {
        "eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    }
    test = tests[op]
    whole = int(value) if isinstance(value, int) or value.is_integer() else None
    if whole is not None and abs(whole) >= 10**38:
        # Beyond every integer lane; floats compare by magnitude.
        return _sure(F.when(lane.number, test(lane.double, F.lit(float(value) if abs(value) < 1.7e308 else math.copysign(math.inf, value)))))
    by_double = test(lane.double, F.lit(float(value)))
    if whole is not None and abs(whole) < EXACT:
        return _sure(by_double)  # exact for doubles, and no integer rounds across such a bound
    if whole is not None:
        exact = F.expr(f"cast('{whole}' as decimal(38,0))")
        inside = (lane.double == F.floor(lane.double)) & (F.abs(lane.double) < 2.0**63)
        return _sure(F.when(lane.kind == "int", test(lane.integer, exact)).when(inside, test(lane.double.cast("bigint").cast("decimal(38,0)"), exact)).otherwise(by_double))
    return _sure(by_double)


def typed_eq(lane: Lane, value: Any) -> Column:
    if value is None:
        return lane.is_null
    if isinstance(value, bool):
        return _sure(lane.boolean == value)
    if isinstance(value, (int, float)):
        return _number_test(lane, value, "eq")
    if isinstance(value, str):
        return _sure(lane.string == F.lit(value))
    if isinstance(value, dict):
        members = lane.object
        tests = [typed_eq(Lane(F.element_at(members, F.lit(k))), v) for k, v in value.items()]
        return _sure(reduce(lambda a, b: a & b, tests, F.size(members) == len(value)))
    items = lane.array
    tests = [typed_eq(Lane(F.try_element_at(items, F.lit(i + 1))), v) for i, v in enumerate(value)]
    return _sure(reduce(lambda a, b: a & b, tests, F.size(items) == len(value)))


def compatible(lane: Lane, value: Any) -> Column:
    """Whether a present value has the literal's type; arrays and objects compare part by part."""
    if value is None:
        return lane.is_null
    if isinstance(value, bool):
        return lane.boolean.isNotNull()
    if isinstance(value, (int, float)):
        return lane.number
    if isinstance(value, str):
        return lane.string.isNotNull()
    return _sure(lane.object.isNotNull() if isinstance(value, dict) else lane.array.isNotNull())


def _regex(pattern: str):
    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        find = re.compile(pattern).search
        return texts.map(lambda t: t is not None and find(t) is not None).astype(bool)

    return search


def lower(expression: Expression, lane_of: Callable[[tuple[str, ...]], Lane]) -> Column:
    """A boolean column that is never null."""
    if isinstance(expression, And):
        return reduce(lambda a, b: a & b, (lower(p, lane_of) for p in expression.parts), F.lit(True))
    if isinstance(expression, Or):
        return reduce(lambda a, b: a | b, (lower(p, lane_of) for p in expression.parts), _no())
    if isinstance(expression, Not):
        return ~lower(expression.part, lane_of)
    lane = lane_of(expression.field.path)
    if isinstance(expression, Exists):
        return lane.present
    if isinstance(expression, Compare):
        value = expression.literal.value
        if expression.op == "eq":
            return typed_eq(lane, value)
        if expression.op == "ne":
            return compatible(lane, value) & ~typed_eq(lane, value)
        if isinstance(value, str):
            text, literal = lane.string, F.lit(value)
            return _sure({"gt": text > literal, "ge": text >= literal, "lt": text < literal, "le": text <= literal}[expression.op])
        return _number_test(lane, value, expression.op)
    if isinstance(expression, In):
        found = reduce(lambda a, b: a | b, (typed_eq(lane, v) for v in expression.values), _no())
        if not expression.negated:
            return found
        if not expression.values:
            return _sure(lane.present & ~lane.kind.isin("array", "object"))
        return reduce(lambda a, b: a | b, (compatible(lane, v) for v in expression.values)) & ~found
    if isinstance(expression, ArrayContains):
        items = lane.array
        tests = [_sure(F.exists(items, _equals(v))) for v in expression.values]
        if expression.every:
            return reduce(lambda a, b: a & b, tests, _sure(items.isNotNull()))
        return reduce(lambda a, b: a | b, tests, _no())
    if isinstance(expression, StringMatch):
        text = lane.string
        if expression.kind == "starts_with":
            return _sure(text.startswith(F.lit(expression.pattern)))
        if expression.kind == "contains":
            return _sure(F.contains(text, F.lit(expression.pattern)))
        if _PORTABLE.fullmatch(expression.pattern):
            return _sure(text.rlike(expression.pattern))
        return _sure(_regex(expression.pattern)(text))
    raise TypeError(f"not an expression: {expression!r}")


def _equals(value: Any):
    return lambda item: typed_eq(Lane(item), value)


def json_text(value: Any) -> str:
    """The JSON spelling of a literal."""
    return json.dumps(value, ensure_ascii=False)
