import math

import __spark_entry__
from tracequarry.llm.urls import RULES, buckets_of, fitted, parts_of, text_of, url_verdicts


def score(url):
    bias, weights = fitted()
    found = buckets_of(text_of(*parts_of(url)))
    return bias + sum(weights[b] for b in found) / math.sqrt(len(found)) if parts_of(url) != ("", "") else None


def plain(url):
    host, path = parts_of(url)
    best = None
    for verdict, rule in RULES:
        domain, slash, start = rule.partition("/")
        if (host == domain or host.endswith(f".{domain}")) and path.startswith(slash + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best[0] if best else "block" if (score(url) or 0) > 0 else "allow"


def check(rows, frame):
    got = sorted((str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in frame.collect()))
    assert got == sorted(str((p, *plain(u))) for p, u in rows)


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    check(rows, __spark_entry__.queries()["op6_url_filter"](spark, sf))


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://EXAMPLE.com/en/7x?q=/en/", "http://com/en/", "http://xcom/en/1", "http://a.example.net/de/8?x", "http://a.NET/de/", "x://é€😀.org/es/ü#/", "a://b?c://d/e", "http://h.com/EN/", "http://h/" + "long/" * 20000, "http://\n.org/es/\n"]
    rows = [(k % 9, u) for k, u in enumerate(urls)] + [(None, urls[4])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, host int")
    check(rows, url_verdicts(frame))
    assert url_verdicts(frame.limit(0)).count() == 0


def test_held_out_accuracy():
    bad = "http://spam-farm.example.org/en/728 https://www.cheap-pills.example.com/fr/1 http://casino-bonus.example.net/en/2 http://porn-tube.example.org/de/4".split()
    good = "https://ththre.example.com/fr/825 http://www.newspaper.example.org/en/5 https://m.therin.example.net/en/2 https://blog.history.example.com/de/7 https://ththwh.example.org/en/3".split()
    assert [u for u in bad if score(u) <= 0] == [] and [u for u in good if score(u) > 0] == []
