"""URL rules: the cascade against plain sets, judging against brute force."""

import random

import pytest
from llm_support import SF, shipped  # noqa: F401
from pyspark.sql import functions as F

from cadence.llm import queries, url_filter


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None, key=lambda x: (x[:3], x[3] == "block"))
    return (host, path, best and best[2], best[3] if best else "allow")


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULES))
    return {r["page_id"]: tuple(r)[1:] for r in out.collect()}


def test_the_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK", 7)  # a level has several chunks
    listed = spark.range(0, 12_000, 9).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(12_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build_cascade(listed, universe)
    assert cascade.levels[0].size > 7
    assert len(cascade.levels) > 2  # false positives of the first level are there, and mended
    wrong = universe.filter(cascade.lists("key") != (F.substring("key", 2, 9).cast("int") % 9 == 0))
    assert wrong.count() == 0
    first = universe.filter(url_filter.holds(cascade.levels[0], "key")).count()
    assert listed.count() < first < 3 * listed.count()


def test_a_level_over_its_bound_raises(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError):
        url_filter.build_level(keys, 1000, 0.01, 0, max_filter_bytes=100)


def test_urls_on_edge_rows(spark):
    rules = list(queries.URL_RULES) + [("example.org", "/es/", "block"), ("a.b.c", "/x", "allow"), ("c", "/x", "block"), ("dup.d", "/", "allow"), ("dup.d", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "/y", "maybe")]
    urls = [
        None, "", "no scheme", "://", "http://", "http:///es/", "HTTP://Example.ORG/es/1?x#y", "https://example.org", "https://example.org?/es/",
        "https://www.example.org/en/12", "https://badexample.org/en/12", "http://example.org/EN/1", "http://a.b.c/xy", "http://z.b.c/xy", "http://a.b.c/",
        "ftp://dup.d/", "http://.org/", "http://org./", "http://u@x.com:8/fr/#a", "http://com/de/?", "http://a://b.org/es/", "http://ünï.org/é",
        "http://" + "a." * 5000 + "org/" + "p" * 50_000, "http://x.com/fr/", "http://x.com/fr/", "http://example.org/es/\n/de",
    ]
    usable = [r for r in rules if r[0] and r[1] and r[2] in ("allow", "block")]
    assert judged(spark, urls, rules) == {i: brute_judge(u, usable) for i, u in enumerate(urls)}
    nothing = judged(spark, urls, [])
    assert {v[2:] for v in nothing.values()} == {(None, "allow")}


def test_random_rules_and_urls(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 3)))
    host = lambda k: ".".join(part() for _ in range(rng.randrange(1, k)))
    path = lambda k: "".join("/" + part() for _ in range(rng.randrange(1, k)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(4), path(3)) for _ in range(40))}.values())
    urls = [f"http://{host(5)}{path(4)}" for _ in range(400)]
    assert judged(spark, urls, rules) == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


def test_columns_without_rows_and_native(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, host int, rule int, keys int, best int")
    out = url_filter.judge_urls(pages, spark.createDataFrame(queries.URL_RULES, url_filter.RULES))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == 0
    plan = queries.op12_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
