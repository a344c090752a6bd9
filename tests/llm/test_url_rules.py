"""Url rules: parts of urls, given rules, and mined rules against their definition."""

from collections import Counter
from itertools import combinations
from math import ceil

import pytest
from pyspark.sql import functions as F

from trestle.llm import url_rules

ODD_URLS = [
    (1, None),
    (2, ""),
    (3, "no scheme/en/x"),
    (4, "://"),
    (5, "http://NET"),
    (6, "http://NET/"),
    (7, "HTTP://a.B.example.NET/en/x?q=1#y"),
    (8, "http://example.net/en"),
    (9, "http://example.net/EN/"),
    (10, "http://badexample.net/en/a"),
    (11, "http://x.example.com/de/"),
    (12, "http://x.org/fr/1/../2;p=3"),
    (13, "http://x.org?/fr/"),
    (14, "http://ü.org#/fr/"),
    (15, "ftp://a/b://c.net/d"),
    (16, "http://h.org/" + "seg/" * 50_000),
    (17, "http://h.org/" + "/".join(f"s{i}x" for i in range(3000))),
    (17, "http://h.org/same\nline"),
    (None, "http://x.net/"),
]


def parts(spark, rows):
    df = spark.createDataFrame(rows, "page_id int, url string").withColumn("rule", F.lit(3)).withColumn("__x", F.lit("y"))
    return df, url_rules.judge(df, min_count=1000)  # too few urls to mine


def test_parts_and_given_rules(spark):
    df, out = parts(spark, ODD_URLS)
    assert out.columns == ["page_id", "url", "__x", "host", "path", "rule", "verdict", "confidence"]
    rows = out.collect()
    assert len(rows) == len(ODD_URLS)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"] not in (16, 17)}
    assert got == {
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("net", "", None, "allow"),
        6: ("net", "/", "net/", "block"),
        7: ("a.b.example.net", "/en/x", "example.net/en/", "allow"),
        8: ("example.net", "/en", "net/", "block"),
        9: ("example.net", "/EN/", "net/", "block"),
        10: ("badexample.net", "/en/a", "net/", "block"),
        11: ("x.example.com", "/de/", "example.com/de/", "block"),
        12: ("x.org", "/fr/1/../2;p=3", "org/fr/", "allow"),
        13: ("x.org", "", None, "allow"),
        14: ("ü.org", "", None, "allow"),
        15: ("a", "/b://c.net/d", None, "allow"),
        None: ("x.net", "/", "net/", "block"),
    }
    assert url_rules.judge(df.limit(0)).count() == 0
    assert url_rules.judge(df).count() == len(ODD_URLS)  # mined rules take the odd urls too


def mined_by_definition(labelled, max_items, min_support, min_count, min_confidence):
    n, blocked = len(labelled), sum(v == "block" for _, v in labelled)
    least = max(ceil(min_support * n), min_count)
    held = Counter(t for ts, _ in labelled for t in ts)
    bad = Counter(t for ts, v in labelled if v == "block" for t in ts)
    count, said = Counter(), Counter()
    for ts, v in labelled:
        own = sorted((t for t in ts if held[t] >= least), key=lambda t: (-abs(bad[t] * n - held[t] * blocked), t))[:max_items]
        for size in range(1, len(own) + 1):
            for s in combinations(sorted(own), size):
                count[s] += 1
                said[s, v] += 1
    rules = {(s, v): k / count[s] for (s, v), k in said.items() if k >= least and k / count[s] >= min_confidence}
    kept = [
        r for r in rules if not any(rules.get((tuple(x for x in r[0] if x != t), r[1]), 0) >= rules[r] for t in r[0] if len(r[0]) > 1)
    ]
    return sorted(kept, key=lambda r: (-rules[r], -said[r], len(r[0]), " ".join(r[0]))), rules


@pytest.mark.parametrize("max_items", [3, 8])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_mined_rules_by_definition(spark, max_items, limit, monkeypatch):
    monkeypatch.setattr(url_rules, "MAX_BROADCAST", limit)
    hosts = ["a.example.net", "cheap-pills.example.com", "cheap-tips.x.net", "b.example.org", "pills.tips.net", "news.example.com"]
    urls = [f"http{'s' * (i % 2)}://{hosts[i * i % 6]}/{'en de fr es'.split()[i * 7 % 13 % 4]}/{i % 5}/{'buy' if i % 11 < 4 else 'read'}?p{i % 3}=1" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    args = {"max_items": max_items, "min_support": 0.02, "min_count": 4, "min_confidence": 0.7}
    url = F.col("url")
    split = df.select("url", url_rules.tokens(url, url_rules.host(url), url_rules.path(url)).alias("t"), url_rules.host(url).alias("h"), url_rules.path(url).alias("p"))
    given = {r["url"]: (r["t"], r["rule"]) for r in split.withColumn("rule", url_rules.given_rule(F.col("h"), F.col("p"), url_rules.RULES)[1]).collect()}
    labelled = [(set(given[u][0]), given[u][1]) for u in urls if given[u][1]]
    rules, confidence = mined_by_definition(labelled, *args.values())
    assert len(rules) > 5
    out = {r["page_id"]: r for r in url_rules.judge(df, **args).collect()}
    for i, u in enumerate(urls):
        first = next((r for r in rules if set(r[0]) <= set(given[u][0])), None)
        wanted = given[u][1] or (first[1] if first else "allow")
        assert out[i]["verdict"] == wanted
        assert out[i]["confidence"] == (None if given[u][1] or not first else confidence[first])


def test_sample_of_labelled_urls_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.net/"), F.when(F.col("id") % 2 == 0, "de/").otherwise("fr/"), "id").alias("url"))
    other = spark.createDataFrame([(-1, "http://y.com/fr/9")], "page_id long, url string")
    out = url_rules.judge(df.union(other), sample_urls=500)
    assert out.where("page_id = -1").first()["verdict"] == "block"
