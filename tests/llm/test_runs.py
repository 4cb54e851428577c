"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracequarry.llm import entries
from tracequarry.llm.runs import Words, found_runs, periodic_runs


def plain(words):
    w = {x: k for k, x in enumerate(dict.fromkeys(words))}
    w = np.array([w[x] for x in words], np.int64)
    found = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edges[edges[:, 1] - edges[:, 0] >= max(6, 4 * q) - q].tolist():
            e += q
            if not any((w[s : e - p] == w[s + p : e]).all() for p in range(1, q)):
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def test_random_words():
    rnd = random.Random(7)
    seen = 0
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            n, k = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5, 30])
            w = [rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3)):
                a, p, m = rnd.randrange(n + 1), rnd.randint(1, 8), rnd.randint(1, 40)
                for i in range(a, min(n, a + m)):
                    w[i] = w[a + (i - a) % p]
            texts.append(np.array(w, np.int64))
        found = found_runs(np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])))
        for k, t in enumerate(texts):
            want = plain(t.tolist())
            seen += len(want)
            assert found.get(k, []) == want, t.tolist()
    assert seen > 500


@pytest.mark.parametrize("text", [[bin(i).count("1") % 2 for i in range(4096)], [0] * 3000, [i % 7 for i in range(3000)]])
def test_hash_is_verified(text):
    """The words of Thue and Morse, for which rolling hashes of 64 bits agree by mistake, and plain repetitions."""
    words = Words(np.array(text, np.int64))
    rnd = random.Random(1)
    for _ in range(300):
        i, j = sorted(rnd.sample(range(len(text)), 2))
        n = next((k for k in range(len(text) - j) if text[i + k] != text[j + k]), len(text) - j)
        assert words.ahead(i, j) == n
        assert words.behind(i, j) == next((k for k in range(i) if text[i - k - 1] != text[j - k - 1]), i)
    assert found_runs(np.array(text, np.int64), np.array([0, len(text)])).get(0, []) == plain(text)


def test_long_text():
    base = [f"w{i}" for i in range(997)]
    text = base * 60 + ["x"] + ["y"] * 50_000
    numbers = {w: k for k, w in enumerate(dict.fromkeys(text))}
    found = found_runs(np.array([numbers[w] for w in text], np.int64), np.array([0, len(text)]))
    assert found[0] == [(0, 997 * 60, 997), (997 * 60 + 1, 50_000, 1)]


def test_odd_rows(spark):
    rows = [
        (1, None, "c"), (2, "", "c"), (3, " \t\n ", "c"), (4, "a b " * 6, "c"), (4, "a b " * 6, "c"), (None, "x\x0by\x0cx y x y", "c"),
        (5, "é é é é é é z", "c"), (6, "a a a a a", "c"), (7, "p q r s t " * 3 + "p q r s", "c"), (8, "p q r s t " * 4, "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    got = sorted((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.text) for r in periodic_runs(docs).collect())
    want = []
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain(words)
        want.append((doc_id or 0, len(words), tuple(runs), collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in entries.op12_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for doc_id, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs, r = plain(words), got[doc_id]
        some += len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 5
