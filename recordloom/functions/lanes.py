"""Typed lanes of a JSON value.

A VARIANT neither groups nor sorts, and its casts blur types. A lane holds the
value's kind (missing, null, bool, int, float, str, array, object) next to one
column per type, so that missing, null, booleans, numbers and strings stay apart
while integers and floats compare as numbers. All of it stays on the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest integer magnitude up to which doubles are exact.
EXACT = 2**53


@dataclass(frozen=True)
class Lane:
    """A value; ``x`` is its VARIANT, null where the value is missing."""

    x: Column

    @property
    def present(self) -> Column:
        return self.x.isNotNull()

    @property
    def kind(self) -> Column:
        tag = F.schema_of_variant(self.x)
        digits = F.regexp_extract(tag, r"^DECIMAL\((\d+),0\)$", 1)
        return (
            F.when(self.x.isNull(), "missing")
            .when(tag == "VOID", "null")
            .when(tag == "BOOLEAN", "bool")
            .when((tag == "BIGINT") | ((F.length(digits) > 0) & (F.try_to_number(F.nullif(digits, F.lit("")), F.lit("99")) > 18)), "int")
            .when(tag.startswith("DECIMAL") | tag.isin("DOUBLE", "FLOAT"), "float")
            .when(tag == "STRING", "str")
            .when(tag.startswith("ARRAY"), "array")
            .when(tag.startswith("OBJECT"), "object")
            .otherwise("other")
        )

    @property
    def is_null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.x), F.lit(False))

    @property
    def number(self) -> Column:
        """Whether it is an integer or a float, and not a boolean."""
        tag = F.schema_of_variant(self.x)
        return F.coalesce((tag == "BIGINT") | tag.startswith("DECIMAL") | tag.isin("DOUBLE", "FLOAT"), F.lit(False))

    @property
    def boolean(self) -> Column:
        return F.when(F.schema_of_variant(self.x) == "BOOLEAN", F.try_variant_get(self.x, "$", "boolean"))

    @property
    def string(self) -> Column:
        return F.when(F.schema_of_variant(self.x) == "STRING", F.try_variant_get(self.x, "$", "string"))

    @property
    def double(self) -> Column:
        return F.when(self.number, F.try_variant_get(self.x, "$", "double"))

    @property
    def integer(self) -> Column:
        return F.when(self.kind == "int", F.try_variant_get(self.x, "$", "decimal(38,0)"))

    @property
    def residual(self) -> Column:
        """What the double lane lacks of a large integer, 0 otherwise: (double, residual) orders numbers exactly."""
        large = (self.kind == "int") & (F.abs(self.double) >= EXACT) & (F.abs(self.double) < 2.0**63)
        return F.when(large, self.integer - self.double.cast("bigint").cast("decimal(38,0)")).when(self.number, F.lit(0))

    @property
    def array(self) -> Column:
        return F.when(F.schema_of_variant(self.x).startswith("ARRAY"), F.try_variant_get(self.x, "$", "array<variant>"))

    @property
    def object(self) -> Column:
        return F.when(F.schema_of_variant(self.x).startswith("OBJECT"), F.try_variant_get(self.x, "$", "map<string,variant>"))

    @property
    def finite(self) -> Column:
        d = self.double
        return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))

    @property
    def canonical(self) -> Column:
        """The text of a scalar that is equal for equal values of its kind: 1 and 1.0 agree, -0.0 is 0."""
        d = self.double
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**63)
        number = F.when(self.kind == "int", self.integer.cast("string")).when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
        return F.when(self.number, number).when(self.boolean.isNotNull(), self.boolean.cast("string")).otherwise(self.string)

    @property
    def group(self) -> Column:
        """Kind of identity: numbers of either form share one."""
        return F.when(self.number, "number").otherwise(self.kind)

    def child(self, key: str) -> Lane:
        return Lane(child(self.x, key))


def child(x: Column, key: str) -> Column:
    """A key of an object, whatever characters it has; missing for anything but an object."""
    if "'" not in key and '"' not in key and "\\" not in key and "]" not in key:
        return F.try_variant_get(x, f"$['{key}']", "variant")
    return F.element_at(F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "map<string,variant>")), F.lit(key))


def lane(v: Column, path: tuple[str, ...]) -> Lane:
    """The lane at a path of mapping keys; a missing or non-mapping step makes it missing."""
    if all("'" not in k and '"' not in k and "\\" not in k and "]" not in k for k in path):
        return Lane(F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "variant"))
    for key in path:
        v = child(v, key)
    return Lane(v)
