import math
from collections import Counter
from zlib import crc32

import numpy as np

import __spark_entry__
from tracequarry.llm.quality import BAD, BUCKETS, GOOD, counted, fit, fit_labels, hashed, quality_filter, quality_scores, votes


def test_query_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in __spark_entry__.queries()["op1_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [rows[d].kept for d, q in labels.items() if q == 1]
    bad = [rows[d].kept for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8]
    cast = np.stack([np.where(rng.random(len(truth)) < p, np.where(truth, GOOD, BAD), np.where(truth, BAD, GOOD)) for p in right] + [np.zeros(len(truth), int)] * 5, axis=1)
    patterns, times = np.unique(cast, axis=0, return_counts=True)
    model = fit_labels(patterns, times.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    for k, p in enumerate(right):
        assert abs(model.says[k, 0, GOOD] - p) < 0.03 and abs(model.says[k, 1, BAD] - p) < 0.06


def test_odd_rows(spark):
    prose = "The old bridge crosses a quiet river, and people walk over it each day. Some of them stop to look at boats. "
    rows = [(k, prose + f"Number {k} was seen by my friend near house {k * 7}.") for k in range(60)]
    rows += [(100 + k, "BUY!! NOW!! $$$ %%% " * (k + 30)) for k in range(12)]
    rows += [(200, None), (201, ""), (None, prose), (202, " \n\t"), (203, prose * 20_000), (5, rows[5][1]), (204, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 3)]
    frame = spark.createDataFrame([(*r, 3.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = quality_scores(frame).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[d] for d in [*range(60), 200, 201, 202, None]) and not any(kept[100 + k] for k in range(12))
    left = quality_filter(frame)
    assert left.columns == frame.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality_scores(frame.limit(0)).count() == quality_filter(frame.limit(0)).count() == 0


def test_counts_do_not_depend_on_chunks():
    text = "Ab1 é!\n" * 400_000
    whole = counted(text)
    assert whole.classes.sum() == len(text) and whole.shapes.sum() == len(text) - 3
    assert whole.n_words == 800_000 and whole.lines == 400_000 and whole.repeated_lines == 399_999
    assert all(0 <= b < BUCKETS for b in hashed(whole)[0]) and len(votes(whole)) == 8


def test_copies_and_nulls_take_no_places(spark):
    prose = "The old bridge crosses a quiet river, and people walk over it each day. Some of them stop to look at boats. "
    rows = [(k, prose + f"Number {k} was seen by my friend near house {k * 7}.") for k in range(300)]
    rows += [(1000 + k, f"BUY!! NOW!! $$$ %%% x{k} " * (k + 30)) for k in range(60)]
    extra = [(2000 + k, None) for k in range(20_000)] + [(30_000 + k, rows[3][1]) for k in range(3000)] + [(50_000 + k, " \n") for k in range(3000)]
    plain = fit(spark.createDataFrame(rows, "doc_id long, text string"), 100_000)[1]
    more = fit(spark.createDataFrame(extra + rows, "doc_id long, text string").repartition(5), 100_000)[1]
    turned = fit(spark.createDataFrame(rows[::-1] + extra, "doc_id long, text string").repartition(3), 100_000)[1]
    assert np.allclose(plain.weights, more.weights, atol=0.02) and abs(plain.bias - more.bias) < 0.02
    assert np.array_equal(more.weights, turned.weights) and more.bias == turned.bias
    few = fit(spark.createDataFrame(extra + rows, "doc_id long, text string"), 40)[1]
    assert few(*hashed(counted(rows[0][1]))) >= 0.5 > few(*hashed(counted(rows[310][1])))


def plain_counts(text):
    """Votes and features of a text by loops over its characters, words and lines."""
    kind = lambda c: 0 if c.isspace() else (1 if c.islower() else 2 if c.isupper() else 3) if c.isalpha() else 4 if c.isdigit() else 5 if c in ".,;:!?'\"()-" else 6
    kinds, words, lines = [kind(c) for c in text], text.split(), [x for x in text.split("\n") if x]
    n, times = len(words), Counter(words)
    if not n:
        return [0] * 8, {}
    shown, letters = sum(k > 0 for k in kinds), sum(k in (1, 2, 3) for k in kinds)
    share = lambda a, b: a / b if b else 0
    same, variety = sum(a == b for a, b in zip(words, words[1:], strict=False)), len(times) / n * n**0.15
    ends, odd = sum(w[-1] in ".!?" for w in words) / n, sum(not any(c.isalnum() for c in w) for w in words) / n
    twice = share(len(lines) - len(set(lines)), len(lines))
    symbols, capitals = share(kinds.count(6), shown), share(kinds.count(2), letters)
    ruled = [
        (symbols > 0.1, symbols < 0.02), (letters >= 20 and capitals > 0.4, capitals < 0.15), (n >= 20 and same / n > 0.2, same / n < 0.05), (n >= 50 and variety < 0.6, n >= 50 and variety > 1),
        (share(letters, shown) < 0.7, share(letters, shown) > 0.85), (n >= 50 and (ends > 0.5 or ends == 0), 0.02 <= ends < 0.35), (n >= 20 and odd > 0.2, odd < 0.05), (len(lines) >= 4 and twice > 0.3, len(lines) >= 4 and twice < 0.1),
    ]
    mass = Counter()
    shapes = Counter(tuple(kinds[i : i + 4]) for i in range(len(kinds) - 3))
    for (a, b, c, d), k in shapes.items():
        mass[(((a * 7 + b) * 7 + c) * 7 + d) * 2654435761 % BUCKETS] += k / sum(shapes.values())
    often = Counter()
    for w, k in times.items():
        mass[crc32(w.encode()) % BUCKETS] += k / n
        often[k.bit_length() - 1] += k / n
    for step, v in often.items():
        mass[crc32(f"often {step - int(math.log2(n))}".encode()) % BUCKETS] += v
    mass[crc32(b"same") % BUCKETS] += same / n
    return [BAD if bad else GOOD if good else 0 for bad, good in ruled], {b: math.sqrt(v) for b, v in mass.items() if v}


def test_query_against_brute_force(spark):
    """All votes, the label model, the scorer and every decision, by loops; the sample's bound lets all distinct texts in."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = {d: plain_counts(t) for d, t in texts.items()}
    rows = Counter(tuple(v) for v, _ in made.values())
    good = {r: 0.9 * 0.25 ** r.count(BAD) for r in rows}
    for _ in range(100):
        prior = min(max(sum(good[r] * n for r, n in rows.items()) / len(texts), 1e-3), 1 - 1e-3)
        says = {}
        for k in range(8):
            for c in (0, 1):
                cast = {v: 0.1 + sum(n * (good[r] if c == 0 else 1 - good[r]) for r, n in rows.items() if r[k] == v) for v in (GOOD, BAD)}
                says[k, c] = {v: x / sum(cast.values()) for v, x in cast.items()} | {0: 1.0}
        both = {r: (prior * math.prod(says[k, 0][v] for k, v in enumerate(r)), (1 - prior) * math.prod(says[k, 1][v] for k, v in enumerate(r))) for r in rows}
        good = {r: a / (a + b) for r, (a, b) in both.items()}
    chosen = {t: made[d] for d, t in texts.items() if t.split()}
    bias, weights = 0.0, Counter()
    for _ in range(300):
        step, off = Counter(), 0.0
        for v, features in chosen.values():
            miss = good[tuple(v)] - 1 / (1 + math.exp(-bias - sum(weights[b] * x for b, x in features.items())))
            off += miss
            for b, x in features.items():
                step[b] += miss * x
        for b in {*step, *weights}:
            weights[b] += 4 * (step[b] / len(chosen) - 1e-4 * weights[b])
        bias += 4 * off / len(chosen)
    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, (v, features) in made.items():
        score = 1 / (1 + math.exp(-bias - sum(weights[b] * x for b, x in features.items()))) if texts[d].split() else 1.0
        assert got[d].votes == sum(x * 3**k for k, x in enumerate(v)) and abs(got[d].posterior - good[tuple(v)]) < 1e-6
        assert abs(got[d].score - score) < 2e-3 and (got[d].kept == (score >= 0.25) or abs(score - 0.25) < 2e-3)
