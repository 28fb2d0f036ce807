import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefit.llm.queries import URL_RULES
from tablefit.llm.url_filter import ALLOW, BLOCK, Rule, UrlFilter, judge_urls, with_host_and_path, with_lexical_features

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, features string, top string"


def plain(url, rules):
    """Host, path and the longest fitting rule."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def table(spark, urls):
    return spark.createDataFrame([(i, u, *("x" for _ in range(6))) for i, u in enumerate(urls)], SCHEMA)


def check(rows, urls, rules=URL_RULES):
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id], rules)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict in (ALLOW, BLOCK) and verdict in (None, r.verdict)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = judge_urls(pages, URL_RULES).collect()
    check(rows, urls)
    assert all(r.verdict == (BLOCK if r.block_score >= 0.5 else ALLOW) for r in rows if r.rule is None)


def test_edge_cases(spark):
    urls = [None, "", "no-scheme.org/a", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?x#y", "http://example.org",
            "https://org/", "http://notexample.org/es/", "http://b.com/fr/?a=1", "http://b.com#frag/fr/", "http://b.com/FR/",
            "ftp://u:p@h.com:80/de/a%20b", "http://ÉÀ.com/fr/ü", "x://a.org/b://c.com/de/", "http:///fr/", "http://.org/",
            "http://b.com/fr/" + "a/" * 50_000, "http://b.com/fr/?a=1", "://com/de/", "http://a.org/line\nbreak"]
    check(judge_urls(table(spark, urls), URL_RULES).collect(), urls)
    assert judge_urls(table(spark, []), URL_RULES).count() == 0
    nothing = judge_urls(table(spark, urls), [Rule(BLOCK, "nowhere", "/")]).collect()
    assert {r.verdict for r in nothing} == {ALLOW} and {r.rule for r in nothing} == {None}
    assert {r.verdict for r in judge_urls(table(spark, urls), [], default=BLOCK).collect()} == {BLOCK}
    one = judge_urls(table(spark, ["http://a.com/de/1", "http://b.net/"]), URL_RULES).collect()
    assert one[0].verdict == BLOCK


def test_lexical_features(spark):
    url = "https://www.a-b.example.com/x/longest/p1.html?q=1&r=2#top"
    row = with_lexical_features(with_host_and_path(spark.createDataFrame([(url,)], "url string"))).first()
    counts = Counter(url)
    entropy = -sum(c / len(url) * math.log2(c / len(url)) for c in counts.values())
    assert abs(row.entropy - entropy) < 1e-9
    assert (row.n_chars, row.depth, row.n_params, row.n_labels, row.n_hyphens, row.longest_part, row.has_fragment) == (
        len(url), 3, 2, 4, 1, 7, 1)
    assert (row.top, row.site, row.extension, row.head) == ("com", "example.com", "html", "x")
    assert abs(row.digit_ratio - 3 / len(url)) < 1e-9


def test_held_out_accuracy(spark):
    """Long paths of digits are blocked; the trees find that on hosts never seen."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        path = "/".join("".join(rng.choice(list("0123456789" if bad else "abcdefgh"), 6)) for _ in range(4 if bad else 2))
        rows.append((f"http://h{i}.example.com/{path}", int(bad)))
    urls = with_host_and_path(spark.createDataFrame(rows, "url string, blocked int"))
    train, test = urls.where(F.crc32(F.col("url").cast("binary")) % 4 != 0), urls.where(F.crc32(F.col("url").cast("binary")) % 4 == 0)
    judged = UrlFilter.fit(train, max_labelled=800).score(test.drop("blocked")).join(test, "url").collect()
    assert np.mean([(r.block_score >= 0.5) == bool(r.blocked) for r in judged]) > 0.97


@pytest.mark.parametrize("word", ["Python", "Pandas", "Arrow"])
def test_no_python_in_the_plan(spark, word):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert word not in judge_urls(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
