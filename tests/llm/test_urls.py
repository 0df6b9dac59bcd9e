"""URL verdicts against plain Python, and the filter against its keys."""

import re

from pyspark.sql import functions as F

from tessera.llm.urls import BlockedBloom, canonical, judge_urls
from tessera.llm.queries import URL_RULES, op3_url_filter


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://A.Net", "https://a.net/", "http://x.example.NET/en/1?q#f", "http://example.com/de/9", "http://notexample.com/de/", "ftp://b.org/fr/://c.net/", "http://u@h.net:80/p#/x", "http://É.org/fr/é", "://net/", "http://net?/", "http://spam.org/en/1/", "HTTPS://www.SPAM.org/en/1.html?utm_source=x#a", "http://spam.org/en/1?b=2&a=1&ref=z", "http://spam.org/en/2"]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://spam.org/en/1")], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    listed = spark.createDataFrame([("http://spam.org/en/1",), ("http://spam.org/en/1/",), (None,), ("https://m.spam.org/en/1?a=1&b=2",)], "url string")
    got = {r["page_id"]: r for r in judge_urls(pages, URL_RULES, listed).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert got[i]["verdict"] == rule[1]
    assert [got[i]["verdict"] for i in (14, 15, 16, 17, None)] == ["block", "block", "block", "allow", "block"]
    assert got[0]["verdict"] == "allow" and got[0]["canonical"] is None
    assert judge_urls(pages.limit(0), URL_RULES, listed).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, (), listed.limit(0)).collect()} == {"allow"}


def test_canonical_forms(spark):
    same = ["http://a.org/x/", "https://www.A.org:443/x.html#f", "http://m.a.org/x/index.html?utm_source=1", "http://u@a.org./x"]
    rows = spark.createDataFrame([(u,) for u in same], "url string").select(canonical(F.col("url")).alias("c")).collect()
    assert {r["c"] for r in rows} == {"a.org/x"}


def test_filter_misses_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = BlockedBloom.build(keys, "h")
    assert keys.where(~bloom.may_contain(F.col("h"))).count() == 0
    others = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h"))
    assert others.where(bloom.may_contain(F.col("h"))).count() < 600
    tiny = BlockedBloom.build(keys, "h", max_bytes=64)
    assert len(tiny.words) == 1 and keys.where(~tiny.may_contain(F.col("h"))).count() == 0


def test_listed_sites_have_no_last_number(spark, tmp_path):
    numbers = ["0", "19999", "20000", "123456", "9" * 25, "007", "x", "5/6"]
    urls = [f"http://www.cheap-pills.example.com/en/{n}.html" for n in numbers] + ["http://other.example.com/en/30000"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in op3_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i]["listed"] for i in range(9)] == [True] * 5 + [False] * 4
    assert [got[i]["verdict"] for i in range(9)] == ["block"] * 5 + ["allow"] * 4
