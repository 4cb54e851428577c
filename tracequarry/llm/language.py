"""Language of texts: interpolated Kneser-Ney models of characters, one for each language.

A text is its words, runs of letters in lower case, and a word is its characters between a start and an end. Models are
fitted on a bounded sample of distinct labelled texts: Spark counts n-grams and derives discounts, contexts and
continuation counts by grouping, and the driver sorts them into arrays by a hash of the n-gram, with a column for each
language. A text goes to the language of the lowest cross-entropy for each character. How sure that is comes from a logistic
regression on sampled texts that the models were not fitted on: judged as they are, and once more with the model of their
own language left out, which is how a text of an unknown language looks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, saved

#: Characters of an n-gram.
ORDER = 5
#: Bounds of the sample: characters of all languages, distinct texts of a language, and characters of a text; of the texts,
#: one in DELETED is for calibration.
FIT_CHARS, FIT_TEXTS, FIT_LENGTH, DELETED = 4_000_000, 1500, 20_000, 4
#: Score from which a prediction is accepted.
ACCEPTED = 0.5
#: Language of texts without a letter, and where nothing can be learned.
UNKNOWN = "und"
#: Characters of a text that are taken at once, and distinct words that a task remembers, or characters of these.
PORTION, WORDS, CHARS = 1 << 20, 200_000, 1 << 22
#: Words of texts that are summed at once.
TOKENS = 1 << 17

START, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
GRAMS = "lang string, gram string, n long"


def words_of(text: str) -> Iterator[list[str]]:
    """Words of a text, in portions that end with a word."""
    at = 0
    while at < len(text):
        end = at + PORTION
        while end < len(text) and (text[end].isalnum() or text[end - 1].isalnum()):
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def letters(word: str) -> str:
    """A word without what isn't a letter (signs such as one half count as parts of words)."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _hashes(codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each order, hashes of the n-grams that end at each code and begin at first (its word's start) or later.

    codes are code points of words one after another. An n-gram that would begin before its word is the longest that
    doesn't, so its hash is that of the order below.
    """
    place, x = np.arange(len(codes)), codes.astype(np.uint64) + np.uint64(1)
    found, total, factor = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    for k in range(ORDER):
        at = place - k
        own = np.where(at >= first, x[np.maximum(at, 0)], np.uint64(0))
        total = total + own * factor
        factor = np.uint64(int(factor) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = total ^ (total >> np.uint64(31))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        found.append(mixed ^ (mixed >> np.uint64(29)))
    return found


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words with their starts and ends, the place where the word of each begins, and the words' lengths."""
    codes = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    return codes, np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


@dataclass
class Models:
    """Models of all languages: for each order, sorted hashes of n-grams with a discounted share for each language, and
    sorted hashes of contexts with what they leave to the order below."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    chars: int

    def log2(self, words: list[str]) -> np.ndarray:
        """Base-two log probability of each word by each language."""
        codes, first, lengths = _laid_out(words)
        hashes = _hashes(codes, first)
        # starts are given and not predicted
        inside = np.flatnonzero(np.arange(len(codes)) > first)
        p = np.full((len(inside), len(self.langs)), 1 / (self.chars + 1))
        room = inside - first[inside]
        for k in range(ORDER):
            mine = np.flatnonzero(room >= k)
            at = inside[mine]
            if k:
                keys, left = self.contexts[k]
                p[mine] *= _looked_up(keys, left, hashes[k - 1][at - 1], 1.0)
            else:
                p *= self.contexts[0][1]
            p[mine] += _looked_up(*self.grams[k], hashes[k][at], 0.0)
        sums = np.cumsum(np.vstack([np.zeros((1, len(self.langs))), np.log2(p)]), axis=0)
        ends = np.cumsum(lengths - 1)
        return sums[ends] - sums[ends - lengths + 1]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], otherwise)


# --- fitting ---------------------------------------------------------------------------------------------------------


def sample(texts: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """lang, text and deleted of a bounded sample of texts(lang, text), of distinct texts of each language.

    All languages have the same share of fit_chars. Texts come in the order of a hash until a language has its share or
    FIT_TEXTS texts; longer texts than FIT_LENGTH characters are not drawn. The driver gets the number of languages.
    """
    able = texts.where(F.col("lang").isNotNull() & (F.length("text") <= FIT_LENGTH) & F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("h", F.xxhash64("text"))
    counts = saved(able.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("distinct")), "languages")
    n_langs = max(1, counts.count())
    # about twice the wanted number passes here, so that few rows are grouped and ranked
    share = F.least(F.lit(1.0), F.lit(2.0 * FIT_TEXTS) / F.col("distinct"))
    thin = able.join(counts.select("lang", share.alias("share")), "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    thin = thin.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    ranked = thin.withColumns({"rank": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    drawn = ranked.where((F.col("rank") <= FIT_TEXTS) & (F.col("chars") <= F.greatest(F.lit(fit_chars // n_langs), F.lit(FIT_LENGTH))))
    return drawn.select("lang", "text", (F.col("rank") % DELETED == 0).alias("deleted"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of ORDER characters, and shorter ones that begin with a word's start."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for words in words_of(text):
                for word in filter(None, map(letters, words)):
                    s = f"{START}{word}{END}"
                    for end in range(2, len(s) + 1):
                        key = lang, s[max(0, end - ORDER) : end]
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "gram": [k[1] for k in counts], "n": list(counts.values())}, schema)


def _of_order(top: DataFrame) -> list[DataFrame]:
    """lang, gram and n for each order from 1: n is how often a gram came where nothing can stand before it, else how
    many characters did."""
    found, longer = [], top.where(F.length("gram") == ORDER)
    found.append(longer)
    for k in range(ORDER - 1, 0, -1):
        preceded = longer.select("lang", F.substring("gram", 2, ORDER).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        longer = preceded.union(top.where(F.length("gram") == k))
        found.append(longer)
    return found[::-1]


def fitted(texts: DataFrame) -> Models:
    """Models of texts(lang, text), a bounded sample; the driver gets its n-grams as they are sorted into arrays."""
    top = saved(texts.select("lang", "text").mapInArrow(given_back(_grams), GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    langs = sorted(r[0] for r in top.select("lang").distinct().collect())
    number = {lang: k for k, lang in enumerate(langs)}
    chars = top.select(F.substring("gram", -1, 1)).distinct().count()

    def arrays(rows: pa.Table, otherwise: float) -> tuple[np.ndarray, np.ndarray]:
        names = rows["gram"].to_pylist()
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in names], np.int64)
        ends = np.cumsum(lengths)
        keys = _hashes(codes, np.repeat(ends - lengths, lengths))[-1][ends - 1] if names else np.zeros(0, np.uint64)
        keys, at = np.unique(keys, return_inverse=True)
        values = np.full((len(keys), len(langs)), otherwise, np.float32)
        values[at, [number[x] for x in rows["lang"].to_pylist()]] = rows["value"].to_numpy()
        return keys, values

    grams, contexts = [], []
    for k, counts in enumerate(_of_order(top), 1):
        rare = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        # without singletons (a tiny sample) a middling discount keeps unseen n-grams possible
        discount = F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.75)
        counts = counts.join(rare.select("lang", discount.alias("discount")), "lang").withColumn("context", F.substring("gram", 1, k - 1))
        sums = counts.groupBy("lang", "context").agg(F.sum("n").alias("all"), (F.sum(F.least(F.col("n"), F.col("discount"))) / F.sum("n")).alias("value"))
        shares = counts.join(sums.select("lang", "context", "all"), ["lang", "context"]).select("lang", "gram", (F.greatest(F.lit(0.0), F.col("n") - F.col("discount")) / F.col("all")).alias("value"))
        grams.append(arrays(shares.toArrow(), 0.0))
        if k == 1:
            left = {r["lang"]: r["value"] for r in sums.collect()}
            contexts.append((np.zeros(0, np.uint64), np.array([[left.get(x, 1.0) for x in langs]], np.float32)))
        else:
            contexts.append(arrays(sums.select("lang", F.col("context").alias("gram"), "value").toArrow(), 1.0))
    return Models(langs, grams, contexts, chars)


@dataclass
class Calibration:
    """Mean and spread of a language's cross-entropy, and a logistic regression on what is known of a prediction."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def features(self, bits: np.ndarray, chars: np.ndarray, best: np.ndarray, second: np.ndarray) -> np.ndarray:
        """One; how far the cross-entropy is above the usual; the next language's above it, alone and by length."""
        rows = np.arange(len(bits))
        low, gap = bits[rows, best], np.minimum(second, 30.0) - bits[rows, best]
        above = (low - self.mean[best]) / self.spread[best]
        long = np.log1p(chars) / 8
        # a short text's cross-entropy varies more
        return np.stack([np.ones(len(bits)), np.clip(above, -4, 12), np.clip(above, -4, 12) * long, np.clip(gap, 0, 4), np.clip(gap, 0, 4) * long], axis=1)

    def scores(self, bits: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language of each text, and the probability that it is right."""
        best = np.argmin(bits, axis=1)
        others = bits.copy()
        others[np.arange(len(bits)), best] = np.inf
        x = self.features(bits, chars, best, others.min(axis=1))
        return best, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def calibrated(bits: np.ndarray, chars: np.ndarray, lang: np.ndarray) -> Calibration:
    """From cross-entropies (a row for each text, a column for each language), lengths and numbers of true languages."""
    n_langs = bits.shape[1]
    own = bits[np.arange(len(bits)), lang]
    mean, spread = np.full(n_langs, own.mean() if len(own) else 0.0), np.full(n_langs, max(0.05, own.std() if len(own) else 0.0))
    for k in range(n_langs):
        if (mine := own[lang == k]).size > 1:
            mean[k], spread[k] = np.median(mine), max(0.05, 1.4826 * np.median(np.abs(mine - np.median(mine))))
    model = Calibration(mean, spread, np.zeros(5))
    if n_langs < 2 or not len(bits):
        # there is nothing to be told from: what is far above the usual is refused
        model.weights = np.array([4.0, -1.0, 0.0, 0.0, 0.0])
        return model
    xs, ys = [], []
    for without in (False, True):
        some = bits.copy()
        if without:
            some[np.arange(len(bits)), lang] = np.inf
        best = np.argmin(some, axis=1)
        others = some.copy()
        others[np.arange(len(bits)), best] = np.inf
        xs.append(model.features(some, chars, best, others.min(axis=1)))
        ys.append((best == lang).astype(np.float64))
    x, y = np.vstack(xs), np.concatenate(ys)
    w = np.zeros(5)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(5)
        w -= np.clip(np.linalg.solve(curve, x.T @ (p - y) + 0.5 * w), -5, 5)
    model.weights = w
    return model


# --- prediction ------------------------------------------------------------------------------------------------------


class _Scorer:
    """Cross-entropies of texts; distinct words are scored once while they are remembered."""

    def __init__(self, models: Models):
        self.models = models
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.chars = 0
        self.scores, self.lengths = np.zeros((0, len(self.models.langs))), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Scores the words that are new; a word without a letter has no length."""
        new = list(islice(self.number, len(self.lengths), None))
        if not new:
            return
        plain = [letters(w) for w in new]
        found, lengths = np.zeros((len(plain), len(self.models.langs))), np.array([len(w) + 1 if w else 0 for w in plain], np.int64)
        some = np.flatnonzero(lengths)
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            found[part] = self.models.log2([plain[i] for i in part])
        self.scores, self.lengths = np.vstack([self.scores, found]), np.append(self.lengths, lengths)
        self.chars += sum(map(len, new))

    def bits(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each character by each language of each text, and its number of characters, with an end for each word."""
        texts = list(texts)
        total, chars = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def add() -> None:
            if held:
                self._learn()
                ids, sizes = np.concatenate(held), np.array([len(x) for x in held])
                starts = np.cumsum(sizes) - sizes
                np.subtract.at(total, owners, np.add.reduceat(self.scores[ids], starts, axis=0))
                np.add.at(chars, owners, np.add.reduceat(self.lengths[ids], starts))
                held.clear()
                owners.clear()
            if len(self.number) > WORDS or self.chars > CHARS:
                self._forget()

        n = 0
        for k, text in enumerate(texts):
            for words in words_of(text):
                if words:
                    held.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
                    owners.append(k)
                    n += len(words)
                if n >= TOKENS:
                    add()
                    n = 0
        add()
        return total / np.maximum(1, chars)[:, None], chars


def _measured(batches: Iterator[pa.RecordBatch], models: Models) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(models)
    for batch in batches:
        bits, chars = scorer.bits(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "bits": bits.tolist(), "chars": pa.array(chars)}, pa.schema([("lang", pa.string()), ("bits", pa.list_(pa.float64())), ("chars", pa.int64())]))


def _predicted(batches: Iterator[pa.RecordBatch], models: Models, calibration: Calibration) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(models)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        bits, chars = scorer.bits(t.as_py() or "" for t in texts)
        best, score = calibration.scores(bits, chars)
        langs = [models.langs[k] if n else UNKNOWN for k, n in zip(best, chars, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.where(chars > 0, score, 0.0))], [*batch.schema.names[:-1], "lang_pred", "score"])


def languages(docs: DataFrame, learn: Column, accepted: float = ACCEPTED, fit_chars: int = FIT_CHARS) -> DataFrame:
    """Predicts the language of every whole text of docs(doc_id, text, lang); it learns from the rows where learn holds.

    Returns doc_id, learned (whether learn holds), lang_pred, score (0 to 1, the probability that the prediction is right,
    also against languages that aren't known) and accepted (score at least that). A prediction comes from the text alone.
    Learning takes the bounded sample that sample() describes. Rows of a null lang, and texts without a letter, teach
    nothing.

    One row for each row; a null text or one without a letter is `und` with score 0, as is every text where there is
    nothing to learn from. With one language only, a text that is far from what is usual for it gets a low score.
    Repeated rows are predicted alike, rows without doc_id like any other; equal cross-entropies go to the lesser name. A
    very long text is read in portions. Other columns, whatever their names, are ignored. An empty table gives an empty one.
    """
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce(learn, F.lit(False)).alias("learned"), "text")
    drawn = saved(sample(able.where("learned").select("lang", "text"), fit_chars), "language-sample")
    shown = [F.col("doc_id"), F.col("learned")]
    if drawn.isEmpty():
        return able.select(*shown, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    models = fitted(drawn.where("NOT deleted"))
    measured = drawn.where("deleted").select("lang", "text").mapInArrow(given_back(partial(_measured, models=models)), "lang string, bits array<double>, chars long").collect()
    measured = sorted((r for r in measured if r["lang"] in models.langs), key=lambda r: (r["lang"], r["chars"], r["bits"]))
    bits = np.array([r["bits"] for r in measured]).reshape(len(measured), len(models.langs))
    calibration = calibrated(bits, np.array([r["chars"] for r in measured]), np.array([models.langs.index(r["lang"]) for r in measured], np.int64))
    found = able.select(*shown, "text").mapInArrow(given_back(partial(_predicted, models=models, calibration=calibration)), "doc_id long, learned boolean, lang_pred string, score double")
    return found.withColumn("accepted", (F.col("score") >= accepted) & (F.col("lang_pred") != UNKNOWN))
