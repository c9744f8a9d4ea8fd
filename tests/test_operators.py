"""Sources, investigations, search, discovery, traces and the record contract."""

import io
import json
import threading

import pytest
from pyspark.sql import functions as F

from recordloom.errors import ToolError
from recordloom.expressions import Field
from recordloom.language import complete_filter
from recordloom.operators import contract, discovery, tracetree
from recordloom.operators.dataset import CacheStore, GroupBinding, Investigation, ResourceLimits, cache_key, left_out, page_of, value_counts
from recordloom.operators.search import SearchOptions, SearchProjection, matches, ranges, search
from recordloom.plans.plan import scan
from recordloom.sources.records import read_records, rotation_order
from recordloom.sources.sinks import write_jsonl, write_rotated
from recordloom.streaming import follow


def lines(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_decoding_and_rotation(spark, tmp_path):
    path = lines(tmp_path / "a.log", {"a": 1}, "", "{bad", "[1]", {"a": 2}, '{"a":1}}', '{"a":1,"a":3}')
    result = scan(path).execute(spark)
    assert result.records == [{"a": 1}, {"a": 2}, {"a": 3}] and [o["position"] for o in result.origins] == [1, 5, 7]
    assert result.metadata["skipped_lines"] == 3
    assert rotation_order(["x.log", "x.log.2026-01-02", "x.log.2026-01-01", "y"]) == ["x.log.2026-01-01", "x.log.2026-01-02", "x.log", "y"]
    with pytest.raises(FileNotFoundError):
        scan(str(tmp_path / "*.none")).execute(spark)


def test_time_merge(spark):
    def at(name, s):
        return {"n": name} | ({} if s is None else {"timestamp": f"2026-01-01T00:00:{s:02}Z"})

    a, b = [at("a1", 1), at("a2", 5), at("a3", 3)], [at("b1", 2), at("b2", None), at("b3", 4), at("b4", 9)]
    result = scan([a, b], order="time").execute(spark)
    assert [r["n"] for r in result.records] == ["a1", "b1", "b2", "b3", "a2", "a3", "b4"]
    assert result.warnings == ["out_of_order:mem:1", "untimestamped:mem1:1"]


def test_investigation(spark, tmp_path):
    path = lines(tmp_path / "a.log", {"k": "x", "v": 1, "d": {"e": [1, "q"]}}, {"k": "y", "v": 2.5}, "bad", {"k": "x", "v": None}, {"v": 4})
    store = CacheStore(str(tmp_path / "cache"))
    session = Investigation.open(spark, path, store)
    assert not session.reused and session.diagnostics().count() == 1
    again = Investigation.open(spark, path, store)
    assert again.reused
    again.close()
    view = session.filter(Field("k").eq("x"))
    assert view.page(0, 9) == [0, 2] and view.position_of(2) == 1 and session.filter(Field("v").exists(), view).count() == 2
    assert [r for _, _, r in session.page(0, 10, view)] == [{"k": "x", "v": 1, "d": {"e": [1, "q"]}}, {"k": "x", "v": None}]
    assert page_of(session.count_values(("k",)), 0, 9)[0]["value"] == "x"
    assert page_of(session.summarize_values(("v",)), 0, 9)[0] | {"first": 0} == {"first": 0, "count": 4, "sum": 7.5, "mean": 2.5, "min": 1, "max": 4, "bad": 0}
    by = page_of(session.summarize_values(("v",), ("count", "sum"), (GroupBinding(("k",), "key"),)), 0, 9)
    assert [(r.get("key"), r["count"], r["sum"]) for r in by] == [("x", 2, 1), ("y", 1, 2.5), (None, 1, 4)]
    found = session.discover()
    assert {r.spelling: r.occurrences for r in discovery.fields(found).collect()} == {"k": 3, "v": 4, "d": 1, "d.e": 1}
    assert [r.spelling for r in discovery.fields(found, "e", ("d",)).collect()] == ["d.e"]
    assert {(r.kind, r.spelling) for r in discovery.values(found, ("d", "e"), source="array_element").collect()} == {("number", "1"), ("string", '"q"')}
    first = session.page(0, 1)[0][0]
    lines(tmp_path / "a.log", {"k": "x", "v": 1, "d": {"e": [1, "q"]}}, {"k": "z"})
    newer = session.refresh()
    assert newer.restore_record(session, first).ordinal == 0
    for ordinal, code in ((1, "record_changed"), (3, "record_disappeared")):
        with pytest.raises(ToolError) as error:
            newer.restore_record(session, session.page(ordinal, 1)[0][0])
        assert error.value.code == code
    with pytest.raises(ToolError):
        newer.filter(Field("k").exists(), view)
    newer.commit()
    latest = Investigation.open(spark, path, store)
    assert latest.dataset_id == newer.dataset_id
    latest.close()
    session.close()
    with pytest.raises(ToolError):
        session.stored()
    assert store.clear(spark) == 0  # the newer one is leased
    newer.close()
    assert store.clear(spark) == 1


def test_refused_values_pages_and_jobs(spark, tmp_path):
    path = lines(tmp_path / "a.log", {"k": [1], "v": 1}, {"k": "a", "v": True}, "bad", {"k": "a", "v": 1e308, "w": 1e308}, {"w": 1e308, "z": "long" * 50})
    session = Investigation.open(spark, path, str(tmp_path / "cache"), ResourceLimits(max_page_records=5, max_page_bytes=150))
    by_k = (GroupBinding(("k",), "key"),)
    for work in (lambda: session.count_values(("k",)), lambda: session.count_values(("v",), by_k), lambda: session.summarize_values(("v",)), lambda: session.summarize_values(("w",), ("sum",))):
        with pytest.raises(ToolError) as error:
            work()
        assert error.value.code == "data_incompatible"
    assert session.summarize_values(("w",), ("min", "max", "count")).count() == 1
    assert value_counts(session.records(), ("k",)).count() == 1 and left_out(session.records(), ("k",)).first().vals == 1
    assert session.diagnostic_page(0, 5) == [{"source": path, "occurrence": 0, "line": 3, "reason": "malformed_json"}]
    for page in (lambda: session.page(0, 6), lambda: session.page(3, 1), lambda: session.diagnostic_page(0, 6), lambda: page_of(session.count_values(("w",)), 0, 6, session.limits)):
        with pytest.raises(ToolError) as error:
            page()
        assert error.value.code == "resource_limit"
    view = session.filter(Field("k").exists())
    view.close()
    with pytest.raises(ToolError) as error:
        session.records(view)
    assert error.value.code == "view_closed"

    job = session.start("tree", lambda s: s.build_tree())
    assert job.wait() == "complete" and job.result().leaves.count() == 4
    job.close()
    with pytest.raises(ToolError) as error:
        job.result()
    assert error.value.code == "result_closed"
    gate = threading.Event()
    slow = session.start("discovery", lambda s: (gate.wait(20), s.discover().count()))
    with pytest.raises(ToolError) as error:
        slow.result()
    assert error.value.code == "discovery_not_ready" and slow.status == "running"
    slow.cancel()
    gate.set()
    assert slow.wait() == "canceled"
    failed = session.start("filter", lambda s: 1 / 0)
    failed.wait()
    for ended, code in ((slow, "operation_canceled"), (failed, "execution_failed")):
        with pytest.raises(ToolError) as error:
            ended.result()
        assert error.value.code == code
    newer = session.refresh_job()
    newer.wait()
    assert session.replan(newer.result(), {"errors": lambda s: s.filter(Field("k").eq("a")).page(0, 5)}) == {"errors": [1, 2]}
    with pytest.raises(ZeroDivisionError):
        session.replan(newer.result(), {"bad": lambda s: 1 / 0})
    assert newer.result().closed and Investigation.open(spark, path, str(tmp_path / "cache")).dataset_id == session.dataset_id
    again = Investigation.open_job(spark, path, str(tmp_path / "cache"))
    assert again.wait() == "complete" and again.result().reused


def test_capture_limits_and_cache_order(spark, tmp_path):
    store = CacheStore(str(tmp_path / "cache"), keep=2)
    paths = [lines(tmp_path / f"{n}.log", {"n": n, "text": "x" * 100 if n == "b" else ""}) for n in "abc"]
    first = Investigation.open(spark, paths[0], store)
    second = Investigation.open(spark, paths[1], store, ResourceLimits(max_record_bytes=60))
    assert second.diagnostic_page(0, 9)[0]["reason"] == "record_too_large" and second.stored().count() == 0
    second.close()
    third = Investigation.open(spark, paths[2], store)
    assert not Investigation.open(spark, paths[1], store).reused  # the oldest that nobody leases went
    assert Investigation.open(spark, paths[0], store).reused
    with pytest.raises(ToolError) as error:
        Investigation.open(spark, str(tmp_path), store)
    assert error.value.code == "source_invalid"
    assert first.stored().count() == third.stored().count() == 1
    (tmp_path / "cache" / cache_key([paths[0]]) / "manifest.json").write_text("{")
    with pytest.raises(ToolError) as error:
        Investigation.open(spark, paths[0], store)
    assert error.value.code == "cache_corrupt"


def test_many_files_in_one_scan(spark, tmp_path):
    names = [f"f{i:04} ü+%.log" for i in range(2000)]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f'{{"i":{i}}}\n{{"i":{i},"b":1}}\n' if i % 3 else "")
    found = read_records(spark, [str(tmp_path / n) for n in [*reversed(names), names[1]]]).df
    rows = found.orderBy("_ord").select("_ord", "_origin", "raw").collect()
    kept = [i for i in reversed(range(2000)) if i % 3] + [1]
    assert [r._ord for r in rows] == list(range(2 * len(kept))) and [json.loads(r.raw)["i"] for r in rows[::2]] == kept
    assert [r._origin.position for r in rows] == [1, 2] * len(kept) and rows[0]._origin.source == str(tmp_path / names[1999])


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO('{"a":1}\nbad\n{"a":2}\n'))
    result = scan("-").execute(spark)
    assert result.records == [{"a": 1}, {"a": 2}] and [o["position"] for o in result.origins] == [1, 3] and result.origins[0]["kind"] == "stdin"


def test_search_ranges():
    def found(text, needle, **options):
        return ranges(text, SearchOptions(needle, **options))

    assert found("Gefäß GEFÄSS", "gefäss") == [(0, 5), (6, 12)]
    assert found("ﬂug", "l") == [] and found("ﬂug", "fl") == [(0, 1)] and found("ooooo", "oo") == [(0, 2), (2, 4)]
    assert found("re_use use use2 (use)", "use", whole_word=True) == [(7, 10), (17, 20)]
    assert found("piñata", "pinata", whole_word=True) == [] and found("x", "") == []
    assert found("Abc abc", "abc", case_sensitive=True) == [(4, 7)]
    assert matches({"outer": {"InnerKey": [False, None]}}, SearchOptions("innerkey")) and matches({"outer": [False]}, SearchOptions("false"))


def test_search_scopes():
    console = {"scope": "console"}
    assert not matches({"message": "m", "func": "needle"}, SearchOptions("needle", **console))
    assert matches({"func": "needle"}, SearchOptions("needle", **console))  # no primary field: everything is visible
    assert matches({"message": "m", "span_name": "needle"}, SearchOptions("needle", **console))  # stands in for the absent span
    assert not matches({"message": "m", "span": "s", "span_name": "needle"}, SearchOptions("needle", **console))
    assert matches({"message": "m", "func": "needle"}, SearchOptions("needle", projection=SearchProjection(included=("func",)), **console))
    assert not matches({"func": "needle"}, SearchOptions("needle", projection=SearchProjection(generic=False), **console))
    for bad in ({"text": 3}, {"text": "x", "scope": "all"}):
        with pytest.raises((TypeError, ValueError)):
            SearchOptions(**bad)


def test_search_on_the_jvm_first(spark):
    rows = [{"t": "a Kilo"}, {"t": "a \u212ailo"}, {"t": "kil"}, {"t": "ſtraight"}, {"t": "STRAIGHT"}, {"ki": {"lo": "x"}}, {"t": "Großes"}, {"t": "a\nb"}]
    df = read_records(spark, rows).df
    for needle in ("kilo", "straight", "STRA", "ss", "lo", "a b", "Großes", "\n", "zzz"):
        for sensitive in (False, True):
            options = SearchOptions(needle, case_sensitive=sensitive)
            assert sorted(r["_ord"] for r in search(df, options).select("_ord").collect()) == [i for i, r in enumerate(rows) if matches(r, options)], needle
    plan = search(df, SearchOptions("kilo"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Contains(lower(")  # the test on the JVM is below
    assert search(df, SearchOptions("")).count() == 0


def test_trace_tree(spark):
    rows = [
        {"trace_id": "job", "span_id": "top", "event": "span.start", "span": "import"},
        {"trace_id": "job", "span_id": "read", "parent_span_id": "top", "event": "span.end", "status": "error", "duration_ms": 7},
        {"trace_id": "job", "span_id": "top", "event": "span.end", "status": "ok", "duration_ms": 9.25, "span": "export"},
        {"trace_id": "job", "span_id": "read", "event": "span.start"},
        {"trace_id": "job", "span_id": "orphan", "parent_span_id": "lost"}, {"trace_id": "job", "span_id": "self", "parent_span_id": "self"},
        {"trace_id": "job", "span_id": "ping", "parent_span_id": "pong"}, {"trace_id": "job", "span_id": "pong", "parent_span_id": "ping"}, {"trace_id": "job", "span_id": "tail", "parent_span_id": "pong"},
        {"trace_id": "job", "span_id": "nil", "parent_span_id": None}, {"trace_id": "job", "span_id": "blank", "parent_span_id": ""}, {"trace_id": "job", "span_id": "odd", "parent_span_id": [1]},
        {"trace_id": "job"}, {"trace_id": "job", "span_id": True}, {"trace_id": {}}, {"other": 0},
    ]
    tree = tracetree.build_tree(read_records(spark, rows).df)
    spans = {r.span: r for r in tree.nodes.collect() if r.kind != "trace"}
    assert {k: r.relationship for k, r in spans.items()} == {
        "top": "root", "read": "conflicting parents", "orphan": "parent observed", "lost": "missing parent", "self": "cycle", "ping": "cycle", "pong": "cycle", "tail": "parent observed", "nil": "null parent", "blank": "empty parent", "odd": "invalid parent",
    }
    top = spans["top"]
    assert (top.lifecycle, top.status, top.duration_ms, top.label, top.name_conflict) == ("complete", "ok", 9.25, "import", True)
    assert spans["tail"].parent == spans["pong"].key and spans["lost"].first == 4
    assert [r.evidence for r in tree.leaves.orderBy("_ord").collect()][12:] == ["span not identified", "invalid span identifier", "invalid trace identifier", "untraced"]
    assert tree.ancestors(spans["tail"].key) == [spans["pong"].key, '["job"]'] and tree.ancestors('["job"]') == []
    admitted = tree.leaves.where("_ord = 8").select("_ord")
    assert {(r.span, r.match_count, r.context_only) for r in tree.filtered(admitted).collect()} == {("tail", 1, False), ("pong", 0, True), (None, 0, True)}
    # Under the trace: two records without a span, the spans that have no parent in the tree, and the placeholder.
    assert {r.child_count for r in tree.counted().where("kind = 'trace'").collect()} == {11}
    assert tree.placed().where("parent = '[]'").count() == 3

    job = tree.children('["job"]')
    assert [(r["first"], r["is_record"]) for r in job] == sorted(((r["first"], r["is_record"]) for r in job), key=lambda p: (p[0], not p[1]))
    assert tree.edge_child('["job"]')["key"] == top.key and tree.edge_child('["job"]', last=True)["key"] == "13" and tree.edge_child("none") is None
    for before, after in zip(job, job[1:], strict=False):
        assert tree.sibling(before["key"])["key"] == after["key"] and tree.sibling(after["key"], previous=True)["key"] == before["key"]
    assert tree.sibling(job[-1]["key"]) is None and tree.sibling("none") is None and tree.row("13")["label"] == "invalid span identifier"
    assert tree.node_for_record(8)["span"] == "tail" and tree.node_for_record(15) is None and tree.is_ancestor('["job"]', 8) and not tree.is_ancestor(top.key, 8)
    assert tree.record_page(top.key) == [0, 2] and tree.record_page(top.key, 1, 5) == [2]
    assert tree.node_for_identity(spans["lost"].key) is None and tree.node_for_identity(spans["lost"].key, delivered_only=False)["span"] == "lost"


def test_long_chain_of_spans(spark):
    rows = [{"trace_id": "t", "span_id": "0", "event": "span.start"}] + [{"trace_id": "t", "span_id": str(i), "parent_span_id": str(i - 1)} for i in range(1, 200)]
    tree = tracetree.build_tree(read_records(spark, rows).df)
    assert tree.filtered(tree.leaves.where("_ord = 199").select("_ord")).count() == 201
    assert len(tree.ancestors('["t","150"]')) == 151


def test_completion_from_records(spark):
    found = discovery.entries(read_records(spark, [{"level": "INFO", "n": 1, "odd name": {"in ner": "x"}, "tags": ["a", "b"]}, {"level": "INFO", "line": 2}, {"level": "WARN"}]).df)

    def offered(text, **page):
        return [c.insertion for c in discovery.complete(found, complete_filter(text), **page).choices if c.description.endswith(("records", "times"))]

    assert offered("le") == ["level"] and offered("l", limit=1) == ["level"] and offered("l", limit=1, offset=1) == ["line"]
    assert offered("level = ") == ['"INFO"', '"WARN"'] and offered('level = "W') == ['"WARN"'] and offered("n = ") == ["1"]
    assert offered('["odd name"].["in') == ['"in ner"'] and offered("tags contains_any [") == ['"a"', '"b"'] and offered("level in ") == ['["INFO"]', '["WARN"]']
    assert "none" in discovery.complete(found, complete_filter("missing_field = ")).guidance


def test_contract_and_sinks(spark, tmp_path):
    good = {"timestamp": "2026-01-02T00:00:00Z", "level": "INFO", "logger": "l", "message": "m", "file": "f", "func": "g", "line": 1, "user": "u"}
    rows = [good, good | {"line": True}, {k: v for k, v in good.items() if k != "level"}, good | {"event": "x"}, good | {"timestamp": "2026-01-03T00:00:00+01:00"}]
    df = read_records(spark, rows).df
    assert [r.reason for r in contract.validated(df).orderBy("_ord").collect()] == [None, "invalid type for field: line", "missing required field: level", "invalid value for field: event", None]
    assert contract.typed(df).count() == 2 and contract.json_schema()["required"][0] == "timestamp"
    assert contract.flatten({"level": "x"}, {"level": 1, "ctx_level": 2}) == {"level": "x", "ctx_level": 1, "ctx_ctx_level": 2}
    assert df.limit(1).select(contract.console_line(F.col("v"))).first()[0] == "2026-01-02T00:00:00Z INFO    l  m  user=u"
    write_jsonl(df, str(tmp_path / "out"))
    assert scan(str(tmp_path / "out" / "part*")).execute(spark).records == rows
    write_rotated(df, str(tmp_path / "days"))
    assert sorted(p.name for p in (tmp_path / "days").glob("day=*")) == ["day=2026-01-02"]
    moments = read_records(spark, [good | {"timestamp": f"2026-02-{d:02}T00:00:00Z"} for d in range(1, 21)] + [{"x": 1}]).df
    write_rotated(moments, str(tmp_path / "all"))
    assert len(list((tmp_path / "all").glob("day=*"))) == 21
    write_rotated(moments, str(tmp_path / "seven"), keep=7)
    assert sorted(p.name for p in (tmp_path / "seven").glob("day=*"))[0] == "day=2026-02-13" and (tmp_path / "seven" / "day=undated").exists()
    names = F.create_map(*[F.lit(x) for pair in ((("ctx_" * i) + "level", str(i)) for i in range(12)) for x in pair])
    assert sorted(spark.range(1).select(contract.flatten_keys(names).alias("m")).first().m) == sorted("ctx_" * i + "level" for i in range(1, 13))


def test_stream(spark, tmp_path):
    lines(tmp_path / "a.log", {"level": "ERROR"}, {"level": "INFO"}, "bad")
    stream = follow(spark, str(tmp_path), Field("level").eq("ERROR")).select("raw").writeStream.format("memory").queryName("followed").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("followed").count() == 1
