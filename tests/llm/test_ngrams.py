import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

import __spark_entry__
from tracequarry.llm import ngrams
from tracequarry.llm.ngrams import STEPS, fit_weights, lm_scores


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]


def fold(doc_id):
    return crc32(str("" if doc_id is None else doc_id).encode()) % 5


def plain(rows):
    """Scores by doc_id, counted in plain Python; and the probability of a word after another, or after the start."""
    train = [words(t) for d, t in rows if fold(d) != 1]
    gone = [words(t) for d, t in rows if fold(d) == 2]
    count = lambda texts: (Counter(w for t in texts for w in [1, *t]), Counter(p for t in texts for p in zip([1, *t], t, strict=False)))
    (one, two), (one_gone, two_gone) = count(train), count(gone)
    n, v = sum(one.values()) - one[1], len(one) - (1 in one)
    left = n - (sum(one_gone.values()) - one_gone[1])
    cells = Counter()
    for t in gone:
        for a, b in zip([1, *t], t, strict=False):
            before, pair, word = one[a] - one_gone[a], two[a, b] - two_gone[a, b], one[b] - one_gone[b]
            cells[before.bit_length(), round(-STEPS * math.log2(pair / before)) if pair else -1, round(STEPS * math.log2(word)) if word else -1] += 1
    weights = fit_weights([(*c, k) for c, k in cells.items()], left, v)

    def probability(a, b):
        w = weights[one[a].bit_length()]
        return w[0] / (v + 1) + w[1] * one[b] / max(1, n) + w[2] * two[a, b] / max(1, one[a])

    found = []
    for d, text in rows:
        t = words(text)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(probability(a, b)) for a, b in zip([1, *t], t, strict=False))
        found.append((str(d), fold(d) == 1, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return sorted(found), probability, one


def same(got, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_query_against_plain_counts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = __spark_entry__.queries()["op7_lm_score"](spark, sf).collect()
    want, probability, one = plain(rows)
    same(got, want)
    known = [w for w in one if w != 1]
    for a in (1, "the", "was", known[5]):
        assert sum(probability(a, b) for b in known) + probability(a, "unseen word") == pytest.approx(1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows_in_small_blocks(spark, monkeypatch):
    long = "the cat sat on the mat and the dog sat on the cat " * 20_000
    rows = [(k, f"The cat {k % 7} sat\ton the mat {'x ' * (k % 5)}É é") for k in range(60)]
    rows += [(100, None), (101, ""), (None, "no id here"), (102, " \n\t"), (5, rows[5][1]), (103, long), (104, "unseen words only"), (None, None)]
    frame = spark.createDataFrame([(*r, 1.5, 7) for r in rows], "doc_id int, text string, score double, block int").repartition(4)
    same(lm_scores(frame).collect(), plain(rows)[0])
    assert lm_scores(frame.limit(0)).count() == 0
    alone = lm_scores(spark.createDataFrame([(d, "a b") for d in range(200) if fold(d) == 1][:2], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == r.score == 0 for r in alone)


def test_blocks_are_summed_in_levels(spark, monkeypatch):
    """One word in every block: no group of a shard has more rows than FAN, and the scores stay as they are."""
    rows = [(k, f"the cat {k % 7} sat on the {'x ' * (k % 5)}") for k in range(120)] + [(900, "the")] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)  # two blocks from each
    want = sorted(map(tuple, lm_scores(frame).collect()))
    seen = []
    original = ngrams.saved
    monkeypatch.setattr(ngrams, "saved", lambda f, name: seen.append((name, original(f, name))) or seen[-1][1])
    monkeypatch.setattr(ngrams, "FAN", 8)
    got = sorted(map(tuple, lm_scores(frame).collect()))
    assert len(got) == len(want) and all(g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9) for g, w in zip(got, want, strict=True))
    same(lm_scores(frame).collect(), plain(rows)[0])
    levels = [f for name, f in seen if name == "lm-asked"]
    assert len(levels) > 1 and max(levels[0].groupBy("grams", "shard").count().agg({"count": "max"}).first()) > 16
    for f in levels:
        assert f.groupBy("grams", "shard", "part").count().agg({"count": "max"}).first()[0] <= 16


def test_shards_and_blocks_do_not_matter():
    keys = np.array([5, 3, 2**63 + 9, 8, 12], np.uint64)
    order, found, first = ngrams._dealt(keys, 3)
    assert sorted(order) == list(range(5)) and list(found) == sorted({int(k) % 3 for k in keys}) and first[-1] == 5
    for x in ([], [0], [255, 1], [256], [1 << 40]):
        a = np.array(x, np.int64)
        assert list(ngrams._unpacked(ngrams._packed(a), len(a))) == x
