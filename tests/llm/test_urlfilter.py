import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm.queries.op6 import LISTED, RULES
from quadrille.llm.urlfilter import TooLarge, build_cascade, expected_bits, judge, shares


def brute(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    labels = host.split(".")
    blocked = bool(host) and any(".".join(labels[i:]) in listed for i in range(len(labels)))
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "block" if blocked else "allow"


URLS = [
    "http://a.example.net/en/x?y#z", "https://example.net/en/", "https://example.net/en", "https://EXAMPLE.com/de/1", "http://notexample.com/de/", "http://x.org/fr/", "http://org/fr/", "http://x.org/FR/",
    "http://x.net", "http://x.net/", "http://x.net?q=/en/", "http://x.net#/", "ftp://Spam-Farm.example.org/a", "http://www.spam-farm.example.org:80/", "http://xspam-farm.example.org/", "no scheme", "://", "://host", "", None,
    "http://a://b/c", "http:///path", "http://..spam-farm.example.org/", "x" * 5000 + "://h.casino-win.example.com/" + "y" * 5000, "http://ÀÉ.example.com/de/é", "http://x.org/fr/\n?a",
]


def test_verdicts_match_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    listed = spark.createDataFrame([(k,) for k in LISTED] + [(None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, listed, RULES).collect()}
    assert got == {i: brute(u, set(LISTED)) for i, u in enumerate([*URLS, *URLS])}
    small = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, listed, RULES, max_bits=1).collect()}
    assert small == got
    assert judge(pages.limit(0), listed, RULES).count() == 0
    assert {r.verdict for r in judge(pages.filter("page_id = 12"), listed.limit(0), RULES).collect()} == {"allow"}


@pytest.mark.parametrize(("listed", "others"), [(0, 50), (50, 0), (1, 3000), (1500, 1500), (2500, 30)])
def test_cascade_is_exact(spark, listed, others):
    rng = random.Random(listed)
    keys = [f"k{i}-{rng.random()}" for i in range(listed + others)]
    universe = spark.createDataFrame([(k, i < listed) for i, k in enumerate(keys)], "key string, listed boolean")
    cascade = build_cascade(universe)
    assert universe.filter(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    if listed:
        with pytest.raises(TooLarge):
            build_cascade(universe, max_bits=10)


def test_plan_is_native_and_holds_each_level_once(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/") for i in range(300)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.com",) for i in range(0, 300, 3)], "key string")
    found = judge(pages, listed, RULES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    universe = pages.selectExpr("substring_index(url, '/', -1) AS x", "split(url, '/')[2] AS key").selectExpr("key", "cast(substring(key, 2, position('.', key) - 2) AS int) % 3 = 0 AS listed")
    level = build_cascade(universe).levels[0]
    shown = spark.range(1).select(level.passes(F.lit("x")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("getbit") == 1 and level.hashes > 1


def test_long_lists_are_judged_by_shares(spark):
    keys = [f"host{i}.example" for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.{k}/") for i, k in enumerate(keys)] + [(None, None)], "page_id long, url string").repartition(3)
    listed = spark.createDataFrame([(k,) for k in keys[::3]] + [("unseen.example",)], "key string")
    found = judge(pages, listed, [], max_bits=1500 * 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert {r.page_id: r.listed for r in found.collect()} == {i: i % 3 == 0 for i in range(3000)} | {None: False}
    universe = pages.selectExpr("substring(split(url, '/')[2], 5) AS key", "page_id % 3 = 0 AS listed").filter("key IS NOT NULL")
    made = list(shares(universe, 4096))
    assert len(made) >= expected_bits(1000, 2000) // 4096 > 0 and sum(1 / s.modulus for s, _ in made) == 1
    assert all(8 * sum(len(x.data) for x in c.levels) <= 4096 + 8 * len(c.levels) for _, c in made)
    known = universe.select("key", "listed", *[s.has(F.col("key")).alias(f"in{i}") for i, (s, _) in enumerate(made)])
    assert known.selectExpr("listed", " + ".join(f"int(in{i})" for i in range(len(made))) + " AS n").filter("n <> 1").count() == 0


def test_expected_bits_are_near_those_used(spark):
    universe = spark.range(40_000).selectExpr("concat('k', id) AS key", "id % 40 = 0 AS listed")
    used = sum(x.bits for x in build_cascade(universe).levels)
    assert 0.8 < used / expected_bits(1000, 39_000) < 1.3
