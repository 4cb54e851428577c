"""Language models against a plain version, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracequarry.llm import entries, language
from tracequarry.llm.language import END, ORDER, START, calibrated, fitted, languages, sample, words_of


class Plain:
    """Interpolated Kneser-Ney with dictionaries."""

    def __init__(self, texts, chars):
        self.c = [Counter() for _ in range(ORDER + 1)]
        for text in texts:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                s = START + word + END
                for end in range(2, len(s) + 1):
                    g = s[max(0, end - ORDER) : end]
                    self.c[len(g)][g] += 1
        for k in range(ORDER - 1, 0, -1):
            for g in self.c[k + 1]:
                self.c[k][g[1:]] += 1
        self.all, self.kinds = ([defaultdict(float) for _ in self.c] for _ in range(2))
        self.discount = [0.0]
        for k in range(1, ORDER + 1):
            once, twice = (sum(n == m for n in self.c[k].values()) for m in (1, 2))
            self.discount.append(once / (once + 2 * twice) if once and twice else 0.75)
            for g, n in self.c[k].items():
                self.all[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += min(n, self.discount[k])
        self.chars = chars

    def p(self, context, char):
        p = 1 / (self.chars + 1)
        for k in range(1, min(ORDER, len(context) + 1) + 1):
            c = context[len(context) - k + 1 :]
            if self.all[k].get(c):
                p = max(0, self.c[k][c + char] - self.discount[k]) / self.all[k][c] + self.kinds[k][c] / self.all[k][c] * p
        return p

    def log2(self, word):
        s = START + word + END
        return sum(math.log2(self.p(s[:i], s[i])) for i in range(1, len(s)))


TEXTS = [("aa", "the cat sat on the mat. the hat! A THE that 7up x_y"), ("aa", "cat cat"), ("bb", "le chat est là, été l'été, le le"), ("bb", "là où 日本語")]


def test_models_as_plain(spark):
    models = fitted(spark.createDataFrame(TEXTS, "lang string, text string"))
    assert models.langs == ["aa", "bb"]
    words = ["the", "cat", "hat", "là", "été", "zzzz", "t", "thethethe", "日本", "q"]
    found = models.log2(words)
    for k, lang in enumerate(models.langs):
        own = Plain([t for x, t in TEXTS if x == lang], models.chars)
        assert np.allclose(found[:, k], [own.log2(w) for w in words], rtol=1e-5)
        # what can follow a beginning has probability one in all, with one character that was never seen
        every = {c for _, t in TEXTS for w in re.findall(r"[^\W\d_]+", t.lower()) for c in w} | {END}
        assert len(every) == models.chars
        for context in (START, START + "t", START + "tha", START + "zz"):
            assert abs(sum(own.p(context, c) for c in [*every, "\u0001"]) - 1) < 1e-9


def test_words_in_portions(monkeypatch):
    text = "Ein Wort, noch eins; ½ und İstanbul 12 a" * 30
    whole = [w for part in words_of(text) for w in part]
    monkeypatch.setattr(language, "PORTION", 7)
    assert [w for part in words_of(text) for w in part] == whole and "wort" in whole


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entries.op13_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and re.search(r"[^\W\d_]", docs[r.doc_id].text or "")]
    assert len(held) > 30 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.98


def test_rejection(spark, sf):
    """Texts of a language that isn't learned are refused, those of the others are not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 300")
    found = languages(docs, F.col("lang") != "es").join(docs.select("doc_id", "lang"), "doc_id").collect()
    other, own = [r for r in found if r.lang == "es"], [r for r in found if r.lang != "es"]
    assert np.mean([r.accepted for r in other]) < 0.3 and np.mean([r.accepted for r in own]) > 0.95


def test_odd_rows(spark, sf):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 ½ ... _", "en", 1), (4, "the cat", None, 1), (None, "the cat", "en", 1), (5, "l'été là", "fr", 1), (5, "l'été là", "fr", 1), (6, "the " * 50_000, "en", 1), (7, "x" * 300_000, "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE int")
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score) for r in languages(docs, F.lit(True)).collect())
    assert [(r[0], r[1]) for r in got] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (5, "fr"), (6, "en"), (7, got[8][1])]
    assert all(r[2] == 0 for r in got if r[1] == "und") and got[5] == got[6]
    none = languages(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.lang_pred, r.score, r.learned) for r in none} == {("und", 0.0, False)}
    assert languages(docs.limit(0), F.lit(True)).collect() == []
    one = languages(docs.where("lang = 'en'"), F.lit(True)).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_TEXTS", 5)
    monkeypatch.setattr(language, "FIT_LENGTH", 40)
    rows = [("aa", f"word{k} more") for k in range(300)] + [("aa", "the same copy")] * 300 + [("bb", "long " * 50)] + [("bb", f"kurz {k}") for k in range(3)]
    got = sample(spark.createDataFrame(rows, "lang string, text string"), 100).collect()
    for lang in ("aa", "bb"):
        mine = [r.text for r in got if r.lang == lang]
        assert 0 < len(mine) == len(set(mine)) <= 5 and sum(map(len, mine)) <= 50


def test_calibration_without_texts():
    model = calibrated(np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64))
    assert model.scores(np.array([[3.0]]), np.array([5]))[0].tolist() == [0]
