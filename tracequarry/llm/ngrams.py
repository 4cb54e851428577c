"""Language-model scores of texts: word pairs, words and a uniform share, mixed by deleted interpolation.

The counts grow with the corpus, so they are never in one place. Texts are read in blocks; each block asks for its
distinct words and pairs of words, dealt to shards by hash, and a shard answers with the sums over all blocks. The mixture
weights depend on how often the word before was seen (in powers of two). They are learned by expectation-maximisation on
the counts of a part of the training texts that is deleted from the counts which it is predicted from.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import saved

#: Folds of the documents: how many, the one that is not learned from, and the deleted one.
FOLDS, HELD_OUT, DELETED = 5, 1, 2
#: Words of a block, and words of the corpus for each shard of the counts, about.
BLOCK, SHARD = 1 << 20, 1 << 21
#: Blocks, or sums of blocks, that a shard adds up at once.
FAN = 1024
#: Steps in which probabilities and counts are told apart for the weights, per factor of two.
STEPS = 4
#: Keys of the start and the end of a text; words are not empty and have no space.
START, END = xxh64_intdigest(b" "), xxh64_intdigest(b"")

LAYOUT = "block long, deleted boolean, ids array<long>, folds binary, lengths binary, tokens binary, words binary, n_tokens long"
ASKED = "grams int, shard int, block long, deleted boolean, keys binary, counts binary"
ANSWERED = "block long, grams int, shard int, counts binary, deleted binary, seen long, total long, total_deleted long"
CELLS = "bucket int, pair int, word int, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs; all lowest bytes first, so that zeros lie together."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    if n:
        whole[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return whole.view("<i8").reshape(-1)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs of keys."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


# --- blocks ----------------------------------------------------------------------------------------------------------


class _Block:
    """Texts gathered into one row of LAYOUT."""

    def __init__(self):
        self.ids, self.folds, self.tokens, self.n = [], [], [], 0
        self.vocab: dict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__

    def add(self, doc_id: int | None, fold: int, text: bytes) -> None:
        found = np.fromiter(map(self.vocab.__getitem__, text.lower().split()), np.int32)
        self.ids.append(doc_id)
        self.folds.append(fold)
        self.tokens.append(found)
        self.n += len(found)

    def row(self, block: int, deleted: bool) -> tuple:
        """The row; words are numbered by how often they come, which packs well."""
        tokens, n = np.concatenate(self.tokens), len(self.vocab)
        order = np.argsort(-np.bincount(tokens, minlength=n), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        keys = np.fromiter((xxh64_intdigest(w) for w in self.vocab), np.uint64, n)[order]
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        return block, deleted, self.ids, bytes(self.folds), _packed(lengths), _packed(rank[tokens]), keys.tobytes(), self.n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LAYOUT; the number of a deleted block is odd."""
    schema, at = _schema(LAYOUT), TaskContext.get().partitionId() << 32
    held = {False: _Block(), True: _Block()}
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for k, (doc_id, fold) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            own = held[deleted := fold == DELETED]
            own.add(doc_id, fold, texts[k].as_py())
            if own.n + 2 * len(own.ids) >= BLOCK:
                yield _batch([own.row(2 * at + deleted, deleted)], schema)
                held[deleted], at = _Block(), at + 1
    for deleted, own in held.items():
        if own.ids:
            yield _batch([own.row(2 * at + deleted, deleted)], schema)
            at += 1


@dataclass
class _Texts:
    """The texts of a block, each with its start and end: keys of the words, and for each place the word's number."""

    folds: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    flat: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, row: dict) -> _Texts:
        folds = np.frombuffer(row["folds"], np.uint8)
        lengths = _unpacked(row["lengths"], len(folds)) + 2
        keys = np.concatenate([np.frombuffer(row["words"], "<u8"), np.array([START, END], np.uint64)])
        ends = np.cumsum(lengths)
        flat = np.full(int(ends[-1]), -1, np.int64)
        flat[ends - lengths], flat[ends - 1] = len(keys) - 2, len(keys) - 1
        flat[flat < 0] = _unpacked(row["tokens"], row["n_tokens"])
        return cls(folds, ends - lengths, keys, flat, np.repeat(np.arange(len(folds)), lengths))

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct keys of words and of pairs, and for each place but the starts which of them it is."""
        after = np.ones(len(self.flat), bool)
        after[self.starts] = False
        places = np.nonzero(after)[0]
        pairs, pair_at = np.unique(_pair_keys(self.keys[self.flat[places - 1]], self.keys[self.flat[places]]), return_inverse=True)
        return [(self.keys, self.flat), (pairs, pair_at)]


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in the order of their shards; the shards that occur; where each begins, and the end."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    return order, found, np.append(first, len(keys))


def _ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    schema = _schema(ASKED)
    for batch in batches:
        for row in batch.to_pylist():
            texts = _Texts.read(row)
            learned = (texts.folds != HELD_OUT)[texts.of]
            inside = np.ones(len(texts.flat), bool)
            inside[texts.starts] = False
            for grams, ((keys, at), weight) in enumerate(zip(texts.grams(), (learned, learned[inside]), strict=True), 1):
                counts = np.bincount(at[weight], minlength=len(keys))
                order, found, first = _dealt(keys, shards)
                keys, counts = keys[order], counts[order]
                rows = [(grams, int(s), row["block"], row["deleted"], keys[a:b].tobytes(), _packed(counts[a:b])) for s, a, b in zip(found, first, first[1:], strict=False)]
                for k in range(0, len(rows), 1000):
                    yield _batch(rows[k : k + 1000], schema)


def _answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """The sums of a shard for each block that asked, and a row (block -1) of what the shard holds."""
    grams, shard = key[0].as_py(), key[1].as_py()
    blocks, deleted = asked["block"].to_pylist(), asked["deleted"].to_pylist()
    keys = [np.frombuffer(k.as_buffer(), "<u8") for k in asked["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, gone = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    parts = np.split(at, ends[:-1])
    for part, counts, is_deleted in zip(parts, asked["counts"], deleted, strict=True):
        n = _unpacked(counts.as_py(), len(part))  # keys of a block are distinct, so each place is added to once
        total[part] += n
        if is_deleted:
            gone[part] += n
    found = [(block, grams, shard, _packed(total[part]), _packed(gone[part]), None, None, None) for block, part in zip(blocks, parts, strict=True)]
    words = distinct != np.uint64(START) if grams == 1 else np.ones(len(distinct), bool)
    found.append((-1, grams, shard, None, None, int((total[words] > 0).sum()), int(total[words].sum()), int(gone[words].sum())))
    return pa.Table.from_batches([_batch(found, _schema(ANSWERED))])


def _merged(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """What a part of the blocks asks a shard for, as one row that asks like a block."""
    grams, shard, part, deleted = (k.as_py() for k in key)
    keys = [np.frombuffer(k.as_buffer(), "<u8") for k in asked["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    for part_of, counts in zip(np.split(at, np.cumsum([len(k) for k in keys])[:-1]), asked["counts"], strict=True):
        total[part_of] += _unpacked(counts.as_py(), len(part_of))
    return pa.Table.from_batches([_batch([(grams, shard, 2 * part + deleted, deleted, distinct.tobytes(), _packed(total))], _schema(ASKED))])


def _passed_on(key: tuple[pa.Scalar, ...], asked: pa.Table, answered: pa.Table) -> pa.Table:
    """The answer to a part of the blocks, for each of them."""
    grams, shard = key[0].as_py(), key[1].as_py()
    keys = [np.frombuffer(k.as_buffer(), "<u8") for k in asked["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    answer = answered.to_pylist()[0]
    total, gone = (_unpacked(answer[c], len(distinct)) for c in ("counts", "deleted"))
    parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    rows = [(block, grams, shard, _packed(total[part]), _packed(gone[part]), None, None, None) for block, part in zip(asked["block"].to_pylist(), parts, strict=True)]
    return pa.Table.from_batches([_batch(rows, _schema(ANSWERED))])


def _answers(asked: DataFrame, blocks: int, groups: int) -> DataFrame:
    """The sums of each shard for each block that asked, whatever the number of blocks.

    The commonest words are in every block, so a shard that has one gets a row from each. Where that is more than FAN rows,
    parts of the blocks are summed first and ask in their stead, in as many levels as it takes, and what they learn goes
    back down. A row of a part has no more keys than its shard.
    """
    if blocks <= FAN:
        return saved(asked.repartition(groups, "grams", "shard").groupBy("grams", "shard").applyInArrow(_answer, ANSWERED), "lm-counts")
    parts = (blocks + FAN // 2 - 1) // (FAN // 2)
    asked = saved(asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))), "lm-asked")
    by = ["grams", "shard", "part", "deleted"]
    told = _answers(saved(asked.groupBy(*by).applyInArrow(_merged, ASKED), "lm-parts"), parts, groups)
    down = told.where("block >= 0").selectExpr("grams", "shard", "block div 2 AS part", "block % 2 = 1 AS odd", "counts", "deleted")
    own = asked.withColumn("odd", F.col("deleted")).groupBy("grams", "shard", "part", "odd").cogroup(down.groupBy("grams", "shard", "part", "odd")).applyInArrow(_passed_on, ANSWERED)
    return saved(own.union(told.where("block = -1")), "lm-counts")


# --- places with their counts ----------------------------------------------------------------------------------------


@dataclass
class _Places:
    """For each word or end of a block's texts: its count, that of the word before it, and that of the two."""

    texts: _Texts
    of: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray

    @classmethod
    def read(cls, row: dict, answers: list[dict], shards: int, without_deleted: bool) -> _Places:
        texts = _Texts.read(row)
        counts = []
        for grams, (keys, at) in enumerate(texts.grams(), 1):
            order, found, first = _dealt(keys, shards)
            got = {r["shard"]: r for r in answers if r["grams"] == grams}
            sums = [_unpacked(got[s]["counts"], b - a) - (_unpacked(got[s]["deleted"], b - a) if without_deleted else 0) for s, a, b in zip(found.tolist(), first, first[1:], strict=False)]
            own = np.empty(len(keys), np.int64)
            own[order] = np.concatenate(sums)
            counts.append(own[at])
        inside = np.ones(len(texts.flat), bool)
        inside[texts.starts] = False
        places = np.nonzero(inside)[0]
        return cls(texts, texts.of[places], counts[0][places], counts[0][places - 1], counts[1])


def _buckets(before: np.ndarray) -> np.ndarray:
    """0 for what was never seen, else 1 and the power of two."""
    return np.frexp(before.astype(np.float64))[1].astype(np.int64)


def _cells(key: tuple[pa.Scalar, ...], layout: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """How often places of deleted texts have which bucket, pair probability and word count, to 1 / STEPS of a factor of two."""
    schema = _schema(CELLS)
    x = _Places.read(layout.to_pylist()[0], answers.to_pylist(), shards, True)
    pair, word = np.full(len(x.of), -1, np.int64), np.full(len(x.of), -1, np.int64)
    some = x.pair > 0
    pair[some] = np.rint(-STEPS * np.log2(x.pair[some] / x.before[some]))
    word[x.word > 0] = np.rint(STEPS * np.log2(x.word[x.word > 0]))
    cells, n = np.unique((_buckets(x.before) << 40) + ((pair + 1) << 20) + word + 1, return_counts=True)
    return pa.table([pa.array(v, f.type) for v, f in zip((cells >> 40, (cells >> 20 & 0xFFFFF) - 1, (cells & 0xFFFFF) - 1, n), schema, strict=True)], schema=schema)


@dataclass
class Mixture:
    """The model apart from its counts: words learned from, distinct ones, and weights (uniform, word, pair) by bucket."""

    tokens: int
    distinct: int
    weights: np.ndarray

    def log10(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log probabilities of places by their counts."""
        w = self.weights[_buckets(before)]
        return np.log10(w[:, 0] / (self.distinct + 1) + w[:, 1] * word / max(1, self.tokens) + w[:, 2] * pair / np.maximum(1, before))

    def base(self, word: np.ndarray) -> np.ndarray:
        """Log probabilities by the words' own counts, one half added."""
        return np.log10((word + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def fit_weights(cells: Iterable[tuple[int, int, int, int]], tokens: int, distinct: int, rounds: int = 200) -> np.ndarray:
    """Weights of each of 64 buckets by expectation-maximisation over cells (bucket, pair, word, n); tokens: not deleted.

    Each weight begins with one place, so none is zero but those of pairs after a word that was never seen, where there is
    no pair. A bucket without places has the weights of the next lower one that has some.
    """
    found = np.array(sorted(cells), np.int64).reshape(-1, 4)
    if not tokens:
        return np.tile([1.0, 0.0, 0.0], (65, 1))
    likely = np.stack(
        [
            np.full(len(found), 1 / (distinct + 1)),
            np.where(found[:, 2] >= 0, 2.0 ** (found[:, 2] / STEPS) / tokens, 0),
            np.where(found[:, 1] >= 0, 2.0 ** (-found[:, 1] / STEPS), 0),
        ],
        axis=1,
    )
    weights, last = np.zeros((65, 3)), np.array([0.1, 0.45, 0.45])
    for bucket in range(65):
        mine = found[:, 0] == bucket
        n, p = found[mine, 3], likely[mine]
        able = np.array([1.0, 1.0, float(bucket > 0)])
        w = last * able / (last * able).sum()
        for _ in range(rounds if len(n) else 0):
            share = p * w
            share *= (n / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) + able
            w /= w.sum()
        weights[bucket] = w
        last = w if bucket else last
    return weights


def _scored(key: tuple[pa.Scalar, ...], layout: pa.Table, answers: pa.Table, shards: int, model: Mixture) -> pa.Table:
    schema = _schema(SCORES)
    row = layout.to_pylist()[0]
    x = _Places.read(row, answers.to_pylist(), shards, False)
    n = len(x.texts.folds)
    sums = lambda v: np.bincount(x.of, v, n)
    columns = (
        row["ids"], x.texts.folds == HELD_OUT, sums(np.ones(len(x.of))).astype(np.int64), sums(x.word > 0).astype(np.int64),
        sums(model.base(x.word)), sums(model.log10(x.word, x.before, x.pair)),
    )
    return pa.table([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores every whole text of docs(doc_id, text) by a model that learns from those outside the held-out fold.

    A document's fold is crc32 of its doc_id as text, modulo FOLDS (without doc_id: of the empty text). Words are runs
    without ASCII white space, A-Z in lower case, and each text has an end, counted as a word. Returns doc_id, held_out,
    n_tokens (words and the end), n_known (those that the training texts have), train_tokens, base_score (words alone,
    one half added to each count) and score (by the mixture), both base-ten logarithms; one row for each row, other
    columns are ignored. A null or empty text is an end alone. Without training texts all words are alike. Repeated rows
    are scored alike, and those that are learned from count each time. A text is never cut, so a very long one makes a
    block as long as itself. An empty table gives an empty one.

    Counts are whole sums over all training texts. The driver gets sums of shards and, for the weights, how often deleted
    texts have each combination of a bucket and two rounded logarithms, whose number is bounded and not by the corpus.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), fold)
    layout = saved(texts.mapInArrow(_blocks, LAYOUT), "lm-blocks")
    words = layout.agg(F.sum(F.col("n_tokens") + 2 * F.size("ids"))).first()[0] or 0
    shards = words // SHARD + 1
    # groups are large and known in number, so they are dealt out by that and not by the session's number of partitions
    blocks = layout.count()
    answers = _answers(layout.mapInArrow(partial(_ask, shards=shards), ASKED), blocks, 4 * shards)
    distinct, tokens, deleted = answers.where("block = -1 AND grams = 1").agg(F.sum("seen"), F.sum("total"), F.sum("total_deleted")).first()
    tokens, distinct, deleted = tokens or 0, distinct or 0, deleted or 0
    layout = layout.repartition(max(1, 2 * blocks), "block")
    to_blocks = answers.where("block >= 0").select("block", "grams", "shard", "counts", "deleted").repartition(max(1, 2 * blocks), "block")
    held = layout.where("deleted").groupBy("block").cogroup(to_blocks.where("block % 2 = 1").groupBy("block")).applyInArrow(partial(_cells, shards=shards), CELLS)
    cells = held.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()
    model = Mixture(tokens, distinct, fit_weights(map(tuple, cells), tokens - deleted, distinct))
    scores = layout.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInArrow(partial(_scored, shards=shards, model=model), SCORES)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
