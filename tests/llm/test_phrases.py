"""Collocations against brute force; test_sql.py compares the query with SQL."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import phrases
from tracequarry.llm.phrases import Bitmaps, Keys, collocations, grown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(x == lang and len(y) > len(w) and 100 * b >= 100 * a and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1)) for (x, y), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], k))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s, k) for lang, rows in found.items() for rank, (s, a, p, left, right, k) in enumerate(sorted(rows)[:top], 1))


def got(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()))


ROWS = [
    ("en", "The cat sat. The cat sat! a a a a a a, the cat\tsat on: The mat"),
    ("en", "the CAT sat;the cat\x0bsat on the mat  on the mat a a a"),
    ("en", "the cat sat;the cat\x0bsat on the mat  on the mat a a a"),
    (None, "É é É é x y x y"), ("und", "x y x y É é\x00 z\x1cz x y"), ("de", None), ("de", ""), ("de", ".,;"), ("fr", "eins"), ("fr", "a b c d e f g " * 4),
]


@pytest.mark.parametrize(("least", "longest", "top"), [(2, 5, 2000), (1, 3, 4), (3, 2, 5), (2, 1, 9)])
def test_odd_rows(spark, least, longest, top):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "lang string, text string, N int, Phrase string")
    found = got(collocations(docs, least, longest, top))
    assert found == plain(ROWS, least, longest, top) and (found or longest == 1)
    assert collocations(docs.limit(0), least, longest, top).collect() == []


def test_shards_and_groups(spark, sf, monkeypatch):
    """Many shards for each language, small bundles, a full bitmap of keys, several groups of sorted candidates.

    Sums of buckets are added in several levels.
    """
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    want = got(collocations(docs, 6))
    for name, value in {"SHARD": 500, "PORTION": 50, "BUNDLE": 8, "MOST_BITS": 64, "SORTED": 40, "GROUP": 1 << 9, "FAN": 3}.items():
        monkeypatch.setattr(phrases, name, value)
    again = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert want and got(collocations(again, 6)) == want


def test_bitmaps_at_their_edges():
    """Phrases over the edges of parts, and over several of them."""
    rnd = np.random.default_rng(5)
    places = rnd.integers(0, 3, 2000).astype(np.int32)
    keep = np.array([False, True, True])
    maps = Bitmaps(places, keep)
    assert maps.counts().tolist() == [0, *np.bincount(places)[1:]]
    order = np.argsort(maps.word, kind="stable")
    found = {}
    for phrase, n in grown(maps, np.arange(3)[:, None], maps.word[order], maps.part[order], maps.bits[order], 5, None):
        found |= {tuple(p): int(c) for p, c in zip(phrase.tolist(), n, strict=True)}
    want = Counter(tuple(places[i : i + k].tolist()) for k in range(2, 6) for i in range(len(places) - k + 1))
    assert found == {p: c for p, c in want.items() if 0 not in p}


def test_keys_hold_nothing_back(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("h"))
    keys = Keys.of(frame, F.col("h"))
    assert keys.has(np.array([r.h for r in frame.collect()], np.int64).view(np.uint64)).all()
    others = spark.range(5000, 6000).select(F.xxhash64("id").alias("h")).collect()
    assert keys.has(np.array([r.h for r in others], np.int64).view(np.uint64)).mean() < 0.1


def test_products_of_many_digits(spark):
    a, n, left, right = 4 * 10**12, 9 * 10**14 + 7, 5 * 10**12 + 3, 6 * 10**12 + 1
    row = spark.sql(f"SELECT (CAST(1000 * CAST({a}L AS decimal(19,0)) AS decimal(19,0)) * CAST({n}L AS decimal(19,0))) div (CAST({left}L AS decimal(19,0)) * CAST({right}L AS decimal(19,0))) AS s").first()
    assert row.s == 1000 * a * n // (left * right)


def test_words_of_no_frequent_pair_are_not_counted(spark):
    """A word that comes often, but never twice before or after the same word, is part of no candidate."""
    text = " ".join(f"often x{i}" for i in range(50)) + " . both of . both of . both of"
    layout = spark.createDataFrame([("en", text)], "lang string, text string").mapInArrow(lambda b: phrases._shards(b, 1000, 1000), phrases.LAYOUT)
    assert sorted((r.phrase, r.n) for r in phrases._frequent(layout, 3, 5).collect()) == [("both", 3), ("both of", 3), ("of", 3)]


def test_levels_of_buckets(spark, monkeypatch):
    """The buckets that reach a count are the same in one group and in groups of any size."""
    rnd = np.random.default_rng(7)
    texts = [(lang, " ".join(f"w{k}" for k in rnd.zipf(1.3, 400) % 500)) for lang in ("en", "de") for _ in range(40)]
    layout = spark.createDataFrame(texts, "lang string, text string").repartition(4).mapInArrow(lambda b: phrases._shards(b, 300, 1000), phrases.LAYOUT).cache()
    want = phrases._frequent_buckets(layout, 20).cells
    for group, fan in ((1 << 12, 2), (1 << 9, 3), (1, 2)):
        monkeypatch.setattr(phrases, "GROUP", group)
        monkeypatch.setattr(phrases, "FAN", fan)
        assert (phrases._frequent_buckets(layout, 20).cells == want).all()
    assert want.any()
    layout.unpersist()


@pytest.mark.parametrize("most", [2, 1000])
def test_a_task_adds_up_its_shards(most):
    """Counts of several shards leave a task as a row for each phrase, or are passed on when many are held; nothing is lost."""
    own = [[("en", "a b", 2, 3), ("de", "a b", 2, 1)], [("en", "a b", 2, 4)], [("en", "c", 1, 5), ("en", "a b", 2, 1)], [("fr", "d e f", 3, 7)]]
    batches = [pa.RecordBatch.from_pylist([dict(zip(phrases._COUNTS.names, r, strict=True)) for r in rows], phrases._COUNTS) for rows in own]
    found = [tuple(r.values()) for b in phrases._summed(iter(batches), most) for r in b.to_pylist()]
    total = Counter()
    for lang, phrase, size, n in found:
        total[lang, phrase, size] += n
    assert total == {("en", "a b", 2): 8, ("de", "a b", 2): 1, ("en", "c", 1): 5, ("fr", "d e f", 3): 7}
    assert len(found) == (4 if most == 1000 else len(found)) and list(phrases._summed(iter([]), most)) == []
