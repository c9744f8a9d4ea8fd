"""Plan semantics on small in-memory records."""

import dataclasses
import math

import pytest

from recordloom.errors import FilterSyntaxError, ToolError
from recordloom.expressions import Field, all_of, any_of, logger_prefix, not_
from recordloom.language import FilterChoice, complete_filter, format_field_path, parse_field_path, parse_filter, parse_grouping
from recordloom.plans import plan as plan_module
from recordloom.plans.plan import count_rows, max_of, mean_of, min_of, scan, sum_of

VALUES = [True, False, 0, 1, 1.0, 2, 1.5, "1", "a", "", None, [1, "a"], [], {"k": 1}, {}, 2**60, 2**60 + 1]
ROWS = [{"i": i, "x": v} for i, v in enumerate(VALUES)] + [{"i": len(VALUES)}]


def kept(spark, expression):
    return [r["i"] for r in scan(ROWS).filter(expression).execute(spark).records]


def plain_eq(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(plain_eq, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(plain_eq(a[k], b[k]) for k in a)
    return a == b


@pytest.mark.parametrize("literal", [True, 1, 1.5, "1", None, [1.0, "a"], {"k": 1.0}, 2**60 + 1, []])
def test_typed_equality(spark, literal):
    assert kept(spark, Field("x").eq(literal)) == [i for i, v in enumerate(VALUES) if plain_eq(v, literal)]
    assert kept(spark, not_(Field("x").eq(literal))) == [i for i, v in enumerate(VALUES) if not plain_eq(v, literal)] + [len(VALUES)]


def test_incompatible_and_membership(spark):
    assert kept(spark, Field("x").ne(1)) == [2, 5, 6, 15, 16]
    assert kept(spark, Field("x").ne(None)) == []
    assert kept(spark, Field("x").not_in([])) == [i for i, v in enumerate(VALUES) if not isinstance(v, (list, dict))]
    assert kept(spark, Field("x").contains_all([])) == [11, 12]
    assert kept(spark, Field("x").contains_any(["a", 7])) == [11]
    assert kept(spark, Field("x").gt("")) == [7, 8]
    assert kept(spark, Field("x").ge(2**60 + 1)) == [16]
    assert kept(spark, Field("x").missing()) == [len(VALUES)]
    assert kept(spark, Field("x").regex(r"^(?:a|1)\Z")) == [7, 8]
    with pytest.raises(TypeError):
        Field("x").gt(None)
    with pytest.raises(ValueError):
        Field("x").regex("(")
    with pytest.raises(TypeError):
        bool(Field("x").eq(1))


def test_paths(spark):
    rows = [{"request.method": "literal", "request": {"method": "nested"}}, {"request": 3}, {'odd"key\'s]': 1}]
    plan = scan(rows)
    assert len(plan.filter(Field("request.method").eq("literal")).execute(spark).records) == 1
    assert len(plan.filter(Field("request", "method").eq("nested")).execute(spark).records) == 1
    assert plan.filter(Field("request", "method").exists()).execute(spark).records == rows[:1]
    assert plan.filter(Field("odd\"key's]").eq(1)).execute(spark).records == rows[2:]


def test_groups_and_exact_reductions(spark):
    rows = [{"k": True, "v": None}, {"k": 1, "v": 1e16}, {"v": 2**100}, {"k": None}, {"k": 1.0, "v": 1.0}, {"k": 2**60, "v": 2}, {"k": 2**60 + 1, "v": 2.0}, {"k": 1, "v": 1.0}]
    result = scan(rows[:2] + rows[3:]).group_by("k").aggregate(n=count_rows(), s=sum_of("v"), lo=min_of("v"), hi=max_of("v")).execute(spark)
    assert result.records == [
        {"k": True, "n": 1, "s": 0, "lo": None, "hi": None},
        {"k": 1, "n": 3, "s": math.fsum([1e16, 1, 1]), "lo": 1.0, "hi": 1e16},
        {"k": None, "n": 1, "s": 0, "lo": None, "hi": None},
        {"k": 2**60, "n": 1, "s": 2, "lo": 2, "hi": 2},
        {"k": 2**60 + 1, "n": 1, "s": 2.0, "lo": 2.0, "hi": 2.0},
    ]
    assert scan([rows[2], {"v": 1}]).aggregate(s=sum_of("v"), m=mean_of("v")).execute(spark).records[0]["s"] == 2**100 + 1
    assert scan([]).group_by("k").aggregate(n=count_rows()).execute(spark).records == []
    assert scan([]).aggregate(n=count_rows(), s=sum_of("v"), m=mean_of("v")).execute(spark).records == [{"n": 0, "s": 0, "m": None}]
    for bad in ("x", True, [1]):
        with pytest.raises(ToolError) as error:
            scan([{"v": bad}]).aggregate(s=sum_of("v")).execute(spark)
        assert error.value.code == "data_incompatible"


def test_sorting(spark):
    rows = [{"n": "a", "x": 2}, {"n": "b"}, {"n": "c", "x": None}, {"n": "d", "x": 1.0}, {"n": "e", "x": 1}, {"n": "f", "x": 2}]

    def order(**options):
        return "".join(r["n"] for r in scan(rows).sort_by("x", **options).execute(spark).records)

    assert order() == "deafcb" and order(descending=True) == "afdecb"
    assert order(missing="first") == "bdeafc" and order(nulls="first", descending=True) == "cafdeb"
    assert [r["n"] for r in scan(rows).sort_by("n", descending=True).sort_by("x").limit(2).execute(spark).records] == ["d", "e"]
    with pytest.raises(ToolError):
        scan([{"x": 1}, {"x": "a"}]).sort_by("x").execute(spark)
    assert scan([{"x": 1}, {"x": "a"}]).sort_by("x").limit(0).execute(spark).records == []


def test_schema_and_explain(spark):
    plan = scan("nowhere.log").filter(not_(not_(all_of(Field("a").eq(1))))).select("a", "b").select("a").limit(5).limit(3)
    told = plan.explain()
    assert told["schema"] == ["a"] and told["output_bound"] == 3 and told["required_fields"] == [["a"]]
    assert {"collapse_projections", "combine_limits", "simplify_boolean"} <= set(told["rewrites"])
    with pytest.raises(ToolError) as error:
        plan.filter(Field("b").exists()).validate()
    assert (error.value.code, error.value.operation) == ("plan_invalid", 5)
    result = scan([{"a": None, "b": 1}, {"b": 2}]).select("a").execute(spark)
    assert result.records == [{"a": None}, {}] and result.schema == ["a"] and result.origins[1] == {"source": "mem", "position": 1, "kind": "iterable"}


def test_language():
    assert parse_filter("") == all_of()
    assert parse_filter('a.b = 1 or not c exists and x in [1, "b"]') == any_of(Field("a", "b").eq(1), all_of(not_(Field("c").exists()), Field("x").in_([1, "b"])))
    assert parse_filter('logger_prefix("a")') == logger_prefix("a")
    for text, code in (("a ==", "filter_syntax"), ("a > null", "filter_type"), ("(a exists", "filter_syntax"), ("a in 3", "filter_type"), ('a matches "("', "filter_type"), ("a exists b", "filter_syntax")):
        with pytest.raises(FilterSyntaxError) as error:
            parse_filter(text)
        assert error.value.code == code
    for path in (("a",), ("a", "b.c"), ("and", "x"), ('q"', "é")):
        assert parse_field_path(format_field_path(path)) == path
    for text in ("gt(a, 1)", "not_in", "a not_in [1]", "logger_prefix(a)", "exists(a, 1)", "in(a)", "a in 3", "a contains 3", 'a = "x', "a[3] = 1", "a. = 1", "not", "a = 1 b", "a matches \"(\""):
        with pytest.raises(FilterSyntaxError):
            parse_filter(text)
    assert parse_grouping('a.b as name, ["x"]') == ((("a", "b"), "name"), (("x",), "x"))


def spot(text, cursor=None):
    found = complete_filter(text, cursor, generation=4)
    return found.kind, found.prefix, found.field_path, found.value_kind, [c.insertion for c in found.choices]


def test_completion():
    assert spot("")[0] == spot("not ")[0] == spot("(a exists) and ")[0] == "expression" and "NOT" in spot("")[4]
    assert spot("ex") == ("expression", "ex", None, None, ["exists("])
    assert spot("a.b")[:3] == ("field", "b", ("a",)) and spot('a["b')[:3] == ("field", '"b', ("a",)) and spot("exists(")[:1] == ("field",)
    assert spot("a st")[4] == ["starts_with"] and spot("a.b ")[0] == "operator" and spot("a not ")[4] == ["IN"]
    assert spot("a = ")[:4] == ("value", "", ("a",), "any") and spot("a in ")[4] == ["[]"] and spot("a contains ")[4] == ['""']
    assert spot("a contains_any [1, ")[:4] == ("value", "", ("a",), "any") and complete_filter("a contains_any [").value_source == "array_element"
    assert spot("a = 1 ")[4] == ["AND", "OR"] and spot("(a = 1 ")[4] == ["AND", "OR", ")"]
    assert spot("exists(a ")[4] == [")"] and spot("in(a ")[4] == [","] and spot("in(a, ")[4] == ["[]"] and spot("in(a, [1]")[4] == [")"]
    assert spot("a = = ")[0] == "none" and spot(") ")[0] == "none"
    with pytest.raises(ValueError):
        complete_filter("a", 2)


def test_applying_a_choice():
    found = complete_filter("le = 1", 2, generation=1)
    made = FilterChoice("level", "level")
    found = dataclasses.replace(found, choices=(made,))
    assert found.apply(made, text="le = 1", cursor=2, generation=1) == ("level = 1", 5)
    assert found.apply(made, text="le = 2", cursor=2, generation=1) is None and found.apply(made, text="le = 1", cursor=2, generation=2) is None
    assert found.apply(FilterChoice("x", "x"), text="le = 1", cursor=2, generation=1) is None
    found = complete_filter("a in ")
    assert found.apply(found.choices[0], text="a in ", cursor=5, generation=0) == ("a in []", 6)
    found = complete_filter("exists(a )", 9)
    assert found.apply(found.choices[0], text="exists(a )", cursor=9, generation=0) == ("exists(a ) ", 11)


def test_what_aggregates_refuse(spark):
    huge = scan([{"v": 1e308}, {"v": 1e308}]).aggregate(s=sum_of("v"))
    with pytest.raises(ToolError) as error:
        huge.execute(spark)
    assert error.value.code == "data_incompatible"
    by_array = scan([{"k": [1]}, {"k": [2]}, {"k": 3}]).group_by("k").aggregate(n=count_rows())
    with pytest.raises(ToolError):
        by_array.execute(spark)
    assert by_array.dataframe(spark).count() == 1
    assert scan([{"a": i} for i in range(5)]).limit(2**31 + 5).execute(spark).metadata["output_rows"] == 5
    rows = scan([{"a": i} for i in range(30)]).sort_by("a", descending=True)
    before, plan_module.TOP = plan_module.TOP, 3
    try:
        assert [r["a"] for r in rows.limit(7).execute(spark).records] == [29, 28, 27, 26, 25, 24, 23]
    finally:
        plan_module.TOP = before
