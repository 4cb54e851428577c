"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, small_batches

#: Votes of a labeller.
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Buckets of the scorer's features, characters handled at a time, and rows that the scorer is fitted on, about.
BUCKETS, CHUNK, FIT_ROWS = 4096, 1 << 20, 4000

#: Probability of good under which a text goes: only where the scorer is fairly sure.
THRESHOLD = 0.25

SPACE, LOWER, UPPER, LETTER, DIGIT, MARK, SYMBOL = range(7)


@cache
def character_classes() -> np.ndarray:
    """The class of each code point up to 65535; those above count as the last."""

    def of(c: str) -> int:
        if c.isspace():
            return SPACE
        if c.isalpha():
            return LOWER if c.islower() else UPPER if c.isupper() else LETTER
        return DIGIT if c.isdigit() else MARK if c in ".,;:!?'\"()-" else SYMBOL

    return np.array([of(chr(i)) for i in range(1 << 16)], np.uint8)


@dataclass
class Counts:
    """What labellers and scorer take from a whole text."""

    classes: np.ndarray
    shapes: np.ndarray
    words: Counter
    n_words: int
    same: int
    ends: int
    odd: int
    lines: int
    repeated_lines: int


def counted(text: str) -> Counts:
    """Counts of a text: character classes, class sequences of four characters, words, and how they repeat."""
    table, classes, shapes = character_classes(), np.zeros(7, np.int64), np.zeros(7**4, np.int64)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK + 3].encode("utf-32-le", "replace"), "<u4")
        c = table[np.minimum(points, 65535)].astype(np.int64)
        classes += np.bincount(c[:CHUNK], minlength=7)
        if len(c) > 3:
            shapes += np.bincount(((c[:-3] * 7 + c[1:-2]) * 7 + c[2:-1]) * 7 + c[3:], minlength=7**4)
    words = text.split()
    distinct = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return Counts(
        classes, shapes, distinct, len(words), sum(map(eq, words, words[1:])),
        sum(n for w, n in distinct.items() if w[-1] in ".!?"), sum(n for w, n in distinct.items() if not any(map(str.isalnum, w))),
        len(lines), len(lines) - len(set(lines)),
    )


def votes(x: Counts) -> tuple[int, ...]:
    """The labellers' votes: symbols, capitals, words said twice, variety, letters, sentence ends, wordless tokens, lines."""
    n, shown = x.n_words, int(x.classes[1:].sum())
    letters = int(x.classes[LOWER : LETTER + 1].sum())
    if not n:
        return (ABSTAIN,) * 8
    share = lambda a, b: a / b if b else 0.0
    symbols, capitals, same = share(x.classes[SYMBOL], shown), share(x.classes[UPPER], letters), share(x.same, n)
    variety, ends, odd, twice = share(len(x.words), n) * n**0.15, share(x.ends, n), share(x.odd, n), share(x.repeated_lines, x.lines)
    found = (
        (symbols > 0.1, symbols < 0.02),
        (letters >= 20 and capitals > 0.4, capitals < 0.15),
        (n >= 20 and same > 0.2, same < 0.05),
        (n >= 50 and variety < 0.6, n >= 50 and variety > 1.0),
        (share(letters, shown) < 0.7, share(letters, shown) > 0.85),
        (n >= 50 and (ends > 0.5 or ends == 0), 0.02 <= ends < 0.35),
        (n >= 20 and odd > 0.2, odd < 0.05),
        (x.lines >= 4 and twice > 0.3, x.lines >= 4 and twice < 0.1),
    )
    return tuple(BAD if bad else GOOD if good else ABSTAIN for bad, good in found)


def hashed(x: Counts) -> tuple[np.ndarray, np.ndarray]:
    """The scorer's features: buckets and values. Shapes, words and word frequencies each have shares that sum to one."""
    at = np.nonzero(x.shapes)[0]
    buckets, values = [at * 2654435761 % BUCKETS], [x.shapes[at] / max(1, x.shapes.sum())]
    if x.n_words:
        times = np.fromiter(x.words.values(), np.int64, len(x.words))
        buckets.append(np.fromiter((crc32(w.encode("utf-8", "replace")) % BUCKETS for w in x.words), np.int64, len(x.words)))
        values.append(times / x.n_words)
        step = np.log2(times).astype(np.int64)
        often = np.bincount(step, times) / x.n_words
        buckets.append(np.array([crc32(f"often {k - int(np.log2(x.n_words))}".encode()) % BUCKETS for k in range(len(often))]))
        values.append(often)
        buckets.append(np.array([crc32(b"same") % BUCKETS]))
        values.append(np.array([x.same / x.n_words]))
    total = np.bincount(np.concatenate(buckets), np.concatenate(values), BUCKETS)
    at = np.nonzero(total)[0]
    return at, np.sqrt(total[at])


def code(found: tuple[int, ...]) -> int:
    """Votes as one number, in base three."""
    return sum(v * 3**k for k, v in enumerate(found))


@dataclass
class LabelModel:
    """Share of good texts, and for each labeller, class (good, bad) and vote its probability; an abstention says nothing."""

    prior: float
    says: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        log = np.log([self.prior, 1 - self.prior])[None, :] + sum(np.log(self.says[k][:, patterns[:, k]]).T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -700, 700)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct rows of votes and how often each occurs (Dawid and Skene, 1979).

    It starts from the objections: the more labellers call a text bad, the less it is taken for good. That says which
    class is the good one, and it suits labellers that each know one kind of bad text.
    """
    good = 0.9 * 0.25 ** (patterns == BAD).sum(axis=1)
    total = max(1, counts.sum())
    for _ in range(rounds):
        weight = np.stack([good * counts, (1 - good) * counts])
        prior = float(np.clip(weight[0].sum() / total, 1e-3, 1 - 1e-3))
        says = np.ones((patterns.shape[1], 2, 3))
        for k in range(patterns.shape[1]):
            for c in range(2):
                cast = np.array([weight[c][patterns[:, k] == v].sum() + 0.1 for v in (GOOD, BAD)])
                says[k, c, GOOD], says[k, c, BAD] = cast / cast.sum()
        model = LabelModel(prior, says)
        good = model.posterior(patterns)
    return model


@dataclass
class Scorer:
    """A logistic regression over hashed features."""

    bias: float
    weights: np.ndarray

    def __call__(self, at: np.ndarray, values: np.ndarray) -> float:
        """Probability of good."""
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ values, -700, 700))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 300, rate: float = 4.0, shrink: float = 1e-4) -> Scorer:
    """Gradient descent towards soft labels."""
    if not rows:
        return Scorer(0.0, np.zeros(BUCKETS))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, values) in enumerate(rows):
        x[i, at] = values
    bias, weights = 0.0, np.zeros(BUCKETS, np.float32)
    for _ in range(rounds):
        miss = (good - 1 / (1 + np.exp(-np.clip(x @ weights + bias, -60, 60)))).astype(np.float32)
        weights += rate * (miss @ x / len(rows) - shrink * weights)
        bias += rate * float(miss.mean())
    return Scorer(float(bias), weights.astype(np.float64))


def _map(docs: DataFrame, of, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rows = [of(i, batch, counted(texts[i].as_py() or "")) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return docs.mapInArrow(given_back(run), schema)


def _pattern_rows(codes: list[int]) -> np.ndarray:
    return np.array([[c // 3**k % 3 for k in range(8)] for c in codes], np.int64).reshape(-1, 8)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[LabelModel, Scorer]:
    """Label model over the votes of all texts, and a scorer fitted on a hash sample of about fit_rows distinct ones.

    The driver gets a count for each row of votes, 3^8 at most, and the sample's features, about fit_rows rows.
    """
    texts = docs.select("text")
    counts = sorted(map(tuple, _map(texts, lambda i, b, x: (code(votes(x)),), "pattern int").groupBy("pattern").count().collect()))
    patterns, times = _pattern_rows([c for c, _ in counts]), np.array([n for _, n in counts], np.float64)
    labels = fit_labels(patterns, times)
    # copies are drawn once and texts without a word not at all, so neither takes the places of others
    worded = docs.select("text", F.xxhash64("text").alias("h")).where(r"text RLIKE '(?U)\\S'")
    share = min(1.0, fit_rows / max(1, worded.agg(F.approx_count_distinct("h", 0.02)).first()[0]))
    chosen = worded.where(F.abs(F.col("h") % 1_000_003) < share * 1_000_003).groupBy("h").agg(F.min("text").alias("text"))
    drawn = _map(chosen, lambda i, b, x: (code(votes(x)), *hashed(x)), "pattern int, at array<int>, value array<double>").toArrow()
    codes, at, value = (drawn.column(c).combine_chunks() for c in ("pattern", "at", "value"))
    rows = [(codes[i].as_py(), at[i].values.to_numpy(), value[i].values.to_numpy()) for i in range(len(codes))]
    # the order of the numbers themselves: neither buckets nor values are negative
    rows.sort(key=lambda r: (r[0], r[1].astype(">i4").tobytes(), r[2].astype(">f8").tobytes()))
    good = labels.posterior(_pattern_rows([r[0] for r in rows])) if rows else np.zeros(0)
    return labels, fit_scorer([r[1:] for r in rows], good)


def quality_scores(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Judges every whole text of docs(doc_id, text); one row for each row, other columns are ignored.

    Returns doc_id, votes (of the labellers, in base three), posterior (probability of good by the label model), score
    (by the scorer) and kept (score at least threshold). An empty or null text gets no vote but abstentions and no
    features, and is kept: there is nothing against it. Repeated rows and rows without doc_id have a row each, and copies
    have the same scores. Votes of all rows count in the label model, copies as often as they come; the scorer is fitted
    on distinct texts. A very long text is counted in portions. A score equal to the threshold is kept. An empty table
    gives an empty one.
    """
    if docs.select("text").isEmpty():
        return docs.selectExpr("CAST(doc_id AS long) doc_id", "0 votes", "0D posterior", "0D score", "true kept")
    with small_batches(docs.sparkSession):
        labels, scorer = fit(docs, fit_rows)

    def judged(i: int, batch: pa.RecordBatch, x: Counts) -> tuple:
        found = votes(x)
        score = scorer(*hashed(x)) if x.n_words else 1.0
        return batch.column("doc_id")[i].as_py(), code(found), float(labels.posterior(np.array([found]))[0]), score, score >= threshold

    return _map(docs.select(F.col("doc_id").cast("long"), "text"), judged, "doc_id long, votes int, posterior double, score double, kept boolean")


def quality_filter(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs(text) that the classifier keeps, all columns, whatever their names.

    The decisions, also on null, empty, very long and repeated texts, are those of quality_scores(); an empty table gives
    an empty one.
    """
    if docs.select("text").isEmpty():
        return docs
    with small_batches(docs.sparkSession):
        _, scorer = fit(docs, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (counted(t.as_py() or "") for t in batch.column("text"))
            yield batch.filter(pa.array([not x.n_words or scorer(*hashed(x)) >= threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(given_back(run), docs.schema)
