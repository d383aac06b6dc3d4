"""Cascades against plain sets, verdicts against SQL and a plain reading of the contract."""

import random

import duckdb
import pytest

from foldlight.llm.queries import ALLOW_RULES, BLOCK_RULES, HOST_WORDS, ORACLE, url_filter
from foldlight.llm.url_filter import build_cascade, fit_url_filter, host_and_path, hosts_with_words


@pytest.mark.parametrize("listed, others", [(0, 50), (50, 0), (1, 5000), (800, 4000), (3000, 3000), (4000, 300)])
def test_membership_is_exact(spark, listed, others):
    rows = [(f"k{i}", i < listed) for i in range(listed + others)]
    cascade = build_cascade(spark.createDataFrame(rows, "key string, listed boolean").repartition(3))
    assert all((k in cascade) == flag for k, flag in rows)
    if listed and others:
        assert cascade.n_bytes < 200 + 4 * listed
    if listed >= 800 and others >= 3000:
        assert len(cascade.levels) > 2


def test_size_is_checked(spark):
    rows = [(f"k{i}", i % 2 == 0) for i in range(2000)]
    with pytest.raises(ValueError):
        build_cascade(spark.createDataFrame(rows, "key string, listed boolean"), most_bytes=50)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.execute(ORACLE["op6_url_filter"])
    names = [d[0] for d in want.description]
    got = url_filter(spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall(), key=lambda r: r[0]) or sorted(
        map(str, map(tuple, got))
    ) == sorted(map(str, want.fetchall()))
    assert {r.verdict for r in got} == {"allow", "block"}


def plain(url):
    host, path = host_and_path(url)
    fits = []
    for verdict, rules in (("allow", ALLOW_RULES), ("block", BLOCK_RULES)):
        for rule in rules:
            at = rule.index("/")
            if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
                fits.append((-len(rule), rule, verdict))
    if fits:
        return host, path, min(fits)[1], min(fits)[2]
    parts = host.replace("-", ".").split(".")
    return host, path, None, "block" if any(w in parts for w in HOST_WORDS) else "allow"


ODD = [
    None,
    "",
    "no scheme.org/es/",
    "http://",
    "http://org/",
    "http://ORG",
    "http://Example.ORG/es/x?y#z",
    "http://sub.example.org/en/1",
    "http://example.org/en/2",
    "http://example.org?/es/",
    "http://notexample.org/es/",
    "http://a.com/de",
    "http://a.com/de/",
    "ftp://www.free-bets.net/x://y.org/",
    "http://example.org//es/",
    "http://.org/",
    "http://a..org/",
    "http://ÄÖ.org/é",
    "http://user@casino.com:80/fr/",
]


def test_odd_urls(spark):
    rng = random.Random(4)
    rows = [(i, u, "x") for i, u in enumerate(ODD + ODD[:4])] + [(None, "http://org/", "x"), (3, "http://a.org/", "x")]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    hosts = hosts_with_words(pages, HOST_WORDS)
    got = fit_url_filter(pages, ALLOW_RULES, BLOCK_RULES, hosts).judge(pages).collect()
    want = sorted(str((i, *plain(u))) for i, u, _ in rows)
    assert sorted(str(tuple(r)) for r in got) == want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    hosts = hosts_with_words(pages, HOST_WORDS)
    assert fit_url_filter(pages, ALLOW_RULES, BLOCK_RULES, hosts).judge(pages).count() == 0


def test_host_of_very_many_labels(spark):
    """Only endings as long as a rule's host are looked at, so a long host takes no longer than it is."""
    hosts = ["a." * 50_000 + "example.org", "b." * 50_000 + "casino.com", ".".join(["x"] * 5000), "..org", "."]
    pages = spark.createDataFrame([(i, f"http://{h}/en/1") for i, h in enumerate(hosts)], "page_id long, url string")
    model = fit_url_filter(pages, ["org/"], ["example.org/en/1", "b.casino.com/"], hosts_with_words(pages, ["casino"]))
    got = {r.page_id: (r.rule, r.verdict) for r in model.judge(pages).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("b.casino.com/", "block"), 2: (None, "allow"), 3: ("org/", "allow"), 4: (None, "allow")}
