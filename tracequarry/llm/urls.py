"""URL filter: rules by host and path prefix, and logistic regression on hashed character n-grams for the rest.

The model is fitted on a small labelled table of URLs; judging is Spark SQL expressions only.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams (three hexadecimal digits), and the n-grams' lengths.
BUCKETS, SIZES = 4096, (3, 4, 5)

# The rules that the contract names, as (verdict, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: The labelled table: URLs to keep out, and URLs to let in.
BAD = """
    http://spam-farm.test/offers/1 http://www.spamlinks.test/en/3 https://cheap-pills.test/buy/viagra http://cheap-meds.test/pills/22
    https://online-casino.test/bonus/7 http://casino-slots.test/free-spins http://poker-bets.test/win/90 https://best-betting.test/odds
    http://xxx-videos.test/watch/12 https://adult-cams.test/live http://free-porn.test/tube/4 http://sexy-singles.test/join
    http://replica-watches.test/sale http://fake-rolex.test/cheap/11 https://cheap-bags.test/outlet http://discount-pharmacy.test/order
    http://crack-keygen.test/download http://warez-torrents.test/full/8 https://free-movies-hd.test/stream http://pirate-dvd.test/rip
    http://fast-payday-loans.test/apply https://easy-money.test/earn/1000 http://get-rich-quick.test/start http://crypto-doubler.test/invest
    http://miracle-diet.test/lose-weight https://hair-loss-cure.test/order http://click-farm.test/ads/2 http://link-farm.test/seo/backlinks
    http://content-farm.test/article/1 https://ad-clicks.test/banner?id=2 http://win-prize.test/claim-now http://free-gift-cards.test/survey
    http://phish-login.test/verify-account http://malware-cleaner.test/scan https://fake-antivirus.test/setup.exe http://buy-followers.test/cheap
    http://spam-blog.test/en/12 https://m.spam-farm.test/fr/70 http://pills-online.test/de/5 http://blog.cheap-deals.test/es/14
""".split()
GOOD = """
    https://en.encyclopedia.test/wiki/History https://www.dailynews.test/world/2021/05/story https://docs.library.test/reference/index.html
    https://blog.gardener.test/en/88 http://m.weather.test/forecast/12 https://www.university.test/research/papers/77 https://museum.test/exhibits/3
    https://theatre.test/en/685 http://other.test/fr/825?page=2 https://m.thetation.test/de/474.html https://www.therin.test/es/770
    https://station.test/timetable/41 http://blog.thenation.test/en/960 https://www.authority.test/about https://mathematics.test/lessons/algebra
    https://cooking.test/recipes/bread http://hiking.test/trails/34 https://astronomy.test/planets/mars https://www.therapist.test/articles/9
    https://community.test/forum/thread/5512 http://hospital.test/departments/cardiology https://bookshop.test/authors/a https://school.test/calendar
    https://opendata.test/datasets/rivers https://www.citycouncil.test/minutes/2020 https://photography.test/guides/light http://railway.test/map
    https://blog.another.test/en/25#top https://thither.test/es/533/ http://www.northern.test/en/671 https://history.test/de/301 https://orchestra.test/concerts
    https://m.thing.test/fr/12 https://weather-station.test/en/4 http://book-club.test/de/19 https://www.open-source.test/projects/7
""".split()


def text_of(host: str, path: str) -> str:
    """What the n-grams are taken from: digits become 0, all but visible ASCII becomes ~, ends are marked."""
    kept = "".join("0" if c in "0123456789" else c if "!" <= c <= "~" else "~" for c in host + path)
    return f"<{kept}>"


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path as the queries take them from a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    stop = min((k for c in "?#" if (k := rest.find(c, end)) >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def buckets_of(text: str) -> list[int]:
    """Buckets of all n-grams of a text."""
    return [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:3], 16) for n in SIZES for i in range(len(text) - n + 1)]


@lru_cache(maxsize=8)
def fitted(bad: tuple[str, ...] = tuple(BAD), good: tuple[str, ...] = tuple(GOOD), rounds: int = 150, rate: float = 2.0, shrink: float = 2e-4) -> tuple[float, tuple[float, ...]]:
    """Bias and weights of the logistic regression, by gradient descent over the labelled table (a small one: it is held here)."""
    rows = [(buckets_of(text_of(*parts_of(u))), y) for y, urls in ((1.0, bad), (0.0, good)) for u in urls]
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(rounds):
        steps, off = [0.0] * BUCKETS, 0.0
        for found, y in rows:
            scale = 1 / math.sqrt(len(found))
            miss = y - 1 / (1 + math.exp(-bias - scale * sum(weights[b] for b in found)))
            off += miss
            for b in found:
                steps[b] += miss * scale
        weights = [w * (1 - rate * shrink) + rate * s / len(rows) for w, s in zip(weights, steps, strict=True)]
        bias += rate * off / len(rows)
    return round(bias, 6), tuple(round(w, 6) for w in weights)


def _rule_case(rules: tuple[tuple[str, str], ...], pick: int) -> str:
    """SQL for the rule (pick 1) or its verdict (pick 0): the longest that fits, in the order given among equals."""
    cases = []
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{slash}{path}%' THEN '{rule[pick]}'")
    return f"CASE {' '.join(cases)} END"


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: tuple[float, tuple[float, ...]] | None = None) -> DataFrame:
    """Judges every url of pages(page_id, url); other columns are ignored and rows are never merged.

    Returns page_id, host (ASCII lower case), path, rule (the longest that fits the host or a domain above it and begins
    the path, else null), score (log odds of being bad, null if the URL has no host and path) and verdict: the rule's, else
    block for a positive score. A null url, or one without ://, has an empty host and path and is allowed. Rows without
    page_id and repeated rows have a row each; a url of any length is judged whole, in one row's memory; an empty table
    gives an empty one.
    """
    bias, weights = model or fitted()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = pages.select("page_id", F.expr("IF(instr(url, '://') > 0, substr(url, instr(url, '://') + 3), '')").alias("rest"))
    rest = F.coalesce(F.col("rest"), F.lit(""))
    found = found.select("page_id", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    plain = F.regexp_replace(F.regexp_replace(F.concat("host", "path"), "[0-9]", "0"), r"[^\x21-\x7e]", "~")
    found = found.withColumn("c", F.split(F.concat(F.lit("<"), plain, F.lit(">")), ""))
    table = f"CAST(split('{','.join(map(str, weights))}', ',') AS array<double>)"
    gram = "IF(size(c) < {n}, 0D, aggregate(sequence(0, size(c) - {n}), 0D, (acc, i) -> acc + {t}[CAST(conv(substr(md5(concat({p})), 1, 3), 16, 10) AS INT)]))"
    total = " + ".join(gram.format(n=n, t=table, p=", ".join(f"c[i + {k}]" for k in range(n))) for n in SIZES)
    count = " + ".join(f"greatest(size(c) - {n - 1}, 0)" for n in SIZES)
    found = found.withColumn("score", F.expr(f"IF(host = '' AND path = '', NULL, {bias}D + ({total}) / sqrt({count}))"))
    found = found.withColumns({"rule": F.expr(_rule_case(rules, 1)), "verdict": F.expr(_rule_case(rules, 0))})
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")


def verdict_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same over the view pages, for DuckDB, without the score."""
    bias, weights = fitted()
    grams = " + ".join(f"coalesce(list_sum([w[('0x' || substr(md5(substr(t, i, {n})), 1, 3))::INT + 1] for i in range(1, length(t) - {n - 2})]), 0)" for n in SIZES)
    count = " + ".join(f"greatest(length(t) - {n - 1}, 0)" for n in SIZES)
    return f"""
WITH w AS (SELECT string_split('{",".join(map(str, weights))}', ',')::DOUBLE[] AS w),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, '<' || regexp_replace(regexp_replace(host || path, '[0-9]', '0', 'g'), '[^\\x21-\\x7e]', '~', 'g') || '>' AS t FROM p),
s AS (SELECT page_id, host, path, CASE WHEN host = '' AND path = '' THEN NULL ELSE {bias} + ({grams}) / sqrt({count}) END AS score FROM c, w)
SELECT page_id, host, path, {_rule_case(rules, 1)} AS rule,
  coalesce({_rule_case(rules, 0)}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s"""
