"""URL rules by a sort-merge range join.

A host with its labels reversed ("org.example.www.") starts with the key of
every rule that covers it, so a rule is an interval of keys. Pages are sorted by
key within their partitions and merged with the sorted rules in one sweep, which
keeps a stack of the nested rules whose intervals hold the present key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import cut_lineage

#: Rules in one sweep; more take more sweeps, and the longest rule so far is carried along.
BLOCK_RULES = 50_000


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(_after_scheme(url), "/", 1))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    slash = F.locate("/", rest)
    return F.coalesce(F.when(F.contains(url, F.lit("://")) & (slash > 0), F.substr(rest, slash)), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substr(url, F.locate("://", url) + F.lit(3))


def _key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


class Sweep:
    """Merges ascending page keys with sorted rules (key, path, rule, verdict).

    An entry of the stack holds the rules of one host: by path length, then path.
    A url is looked up once for each length in use, however many rules there are.
    """

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.hosts: list[tuple[str, dict[int, dict[str, tuple[str, str]]]]] = []
        for key, path, rule, verdict in sorted(rules):
            if not self.hosts or self.hosts[-1][0] != key:
                self.hosts.append((key, {}))
            paths = self.hosts[-1][1].setdefault(len(path), {})
            paths[path] = min(paths.get(path, (verdict, rule)), (verdict, rule))  # allow before block
        self.next, self.stack = 0, []

    def move(self, key: str) -> None:
        """Brings the stack to the hosts that cover the key; keys ascend."""
        while self.next < len(self.hosts) and self.hosts[self.next][0] <= key:
            self._leave(self.hosts[self.next][0])
            self.stack.append(self.hosts[self.next])
            self.next += 1
        self._leave(key)

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rules(self, path: str):
        """(rule, length of its host, verdict) of the rules of the present hosts that fit the path."""
        for key, by_length in self.stack:
            for length, paths in by_length.items():
                found = paths.get(path[:length]) if length <= len(path) else None
                if found:
                    yield found[1], len(key) - 1, found[0]


def _rank(rule: str, host: int, verdict: str) -> tuple:
    return len(rule), host, verdict == "allow", rule, verdict


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A rule covers its host and all subdomains where the path starts with the
    rule's; of several the longest text (host and path) wins, then the longer
    host, then ``allow``. Without a rule the verdict is ``default``. A null url,
    or one without ``://``, has an empty host and path, which no rule covers. A
    rule with an empty or null host is ignored, a null path is empty. No pages
    give no rows, no rules leave all to the default; other columns are ignored.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", _key(F.col("host")))
    rows = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    named = rules.where("host <> ''").select(_key(F.col("host")).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict").distinct()
    blocks = max(1, -(-named.count() // BLOCK_RULES))
    for block in range(blocks):
        part = [tuple(r) for r in named.where(F.pmod(F.xxhash64("key", "path"), F.lit(blocks)) == block).collect()]  # about BLOCK_RULES
        shared = pages.sparkSession.sparkContext.broadcast(part)

        def sweep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state, seen = Sweep(shared.value), None
            for batch in batches:
                paths, keys, rules_, verdicts = (batch.column(i).to_pylist() for i in range(2, 6))
                for i, (key, path) in enumerate(zip(keys, paths, strict=True)):
                    if key != seen:
                        state.move(key)
                        seen = key
                    best = None if rules_[i] is None else _rank(rules_[i], rules_[i].find("/") % (len(rules_[i]) + 1), verdicts[i])
                    for found in state.rules(path):
                        best = _rank(*found) if best is None else max(best, _rank(*found))
                    if best:
                        rules_[i], verdicts[i] = best[3:]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names)

        rows = rows.sortWithinPartitions("key").mapInArrow(sweep, rows.schema)
        if block < blocks - 1:
            rows = cut_lineage(rows)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
