import random
import re

from recordloom.llm.urlfilter import judge_urls, rule_table


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    hosts = ["org", "a.org", "b.a.org", "ab.org", "com", "x.com", "y.x.com", "X.com", "net", "a-b.net", "a.a-b.net", "éa.net", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/A", "?q=/a", "#/a", "/a?x://y"]
    urls = [f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "://")] + [None, "", "no-scheme/a", "a?b://c.org/d"]
    rules = [(rng.choice(("allow", "block")), h.lower(), p) for h in hosts[:-1] for p in paths[:6] if rng.random() < 0.5]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for size in (1000, 5):
        monkeypatch.setattr("recordloom.llm.urlfilter.BLOCK_RULES", size)
        rows = judge_urls(pages, rule_table(spark, rules)).orderBy("page_id").collect()
        assert [tuple(r)[1:] for r in rows] == [brute(u, rules) for u in urls]


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", 5), (None, None, 6)], "page_id long, url string, verdict int")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in judge_urls(pages, none, "block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), none).count() == 0
    odd = rule_table(spark, [("block", "", "/"), ("block", None, "/"), ("block", "org", None)])
    assert {r.verdict for r in judge_urls(pages, odd).collect()} == {"allow", "block"}


def test_many_rules_of_one_host_long_urls_and_repeated_rows(spark):
    rules = [("block" if i % 3 else "allow", "a.org", f"/{i:05}/") for i in range(20_000)]
    urls = [f"http://www.a.org/{i:05}/x" for i in range(0, 20_000, 997)] + ["http://a.org/00001/" + "y" * 1_000_000, "http://a.org/00001", "http://a.org/00001"]
    pages = spark.createDataFrame([(7, u, "r") for u in urls], "page_id long, url string, rule string")
    got = sorted(repr(tuple(r)[1:]) for r in judge_urls(pages, rule_table(spark, rules)).collect())
    assert got == sorted(repr(tuple(brute(u, rules))) for u in urls)
