"""Collocations: phrases of a few words, mined depth-first over compressed position bitmaps.

Texts are gathered into shards of one language. A shard has a bitmap of places for each word, without its empty parts of
32 places. Shifting a phrase's bitmap by a place and ANDing it with the words' bitmaps extends the phrase by each word that
ever follows it; the popcount of what is left is the shard's count, and Spark sums these over all shards. Boundaries of
pieces are places without a word, so no phrase crosses one.

What is frequent is known only from the sums, so there are two rounds: pairs; then the words of frequent pairs, and depth-first
all longer phrases of which each two neighbours are a frequent pair. Words that no frequent pair holds are part of no candidate
and never counted by name. Shards learn what was frequent from a bitmap of hashed keys whose size is bounded. It may let others
pass but never holds one back, and sums decide in the end: results are exact at any size. Most words, pairs and triples are
seldom, so before the rounds all of them are counted in hashed buckets, and only those in a bucket that holds enough are counted
by name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import given_back, saved

#: Occurrences of a phrase, its words, and rows for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Places of a shard (a text is never cut), bytes of a text made into words at once, entries of bitmaps extended at once.
SHARD, PORTION, BUNDLE = 1 << 21, 1 << 21, 1 << 14
#: Bits of the bitmaps of hashed keys: for each key, and at most (8 MB).
KEY_BITS, MOST_BITS = 32, 1 << 26
#: Words of a bucket on the average (and about as many pairs and triples), bounds of the number of buckets (16 MB as bits), buckets
#: of a slice.
LOAD, LEAST_BUCKETS, MOST_BUCKETS, SLICE = 8, 1 << 16, 1 << 27, 1 << 16
#: Filled buckets of a slice, over all shards, that are added at once (3 to 6 bytes each), and rows of sums that are.
GROUP, FAN = 1 << 22, 64
#: Counts by name that a task adds up before they go out.
ADDED = 1 << 18
#: Candidates of a language that are sorted in one task.
SORTED = 1 << 20

_CLEAN = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)
_LAYOUT = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("places", pa.binary()), ("n", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
LAYOUT = "lang string, words binary, places binary, n long"
COUNTS = "lang string, phrase string, size int, n long"
_SLICES = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
SLICES = "slice int, part int, at binary, counts binary"


# --- shards ----------------------------------------------------------------------------------------------------------


class _Shard:
    """Texts of a language gathered into one row of LAYOUT; word 0 is the boundary of pieces."""

    def __init__(self):
        self.places, self.n = [], 0
        self.vocab: dict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[b"."]

    def add(self, text: bytes, portion: int) -> None:
        text, at = text.lower().translate(_CLEAN), 0
        while at < len(text):
            # portions end at a space, where nothing ends but a word
            end = text.find(b" ", at + portion)
            end = len(text) if end < 0 else end
            words = text[at:end].replace(b"\n", b" . ").split()
            self.places.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
            self.n, at = self.n + len(words), end
        self.places.append(np.zeros(1, np.int32))

    def row(self, lang: str) -> pa.RecordBatch:
        places = np.concatenate(self.places)
        return pa.RecordBatch.from_pydict({"lang": [lang], "words": [b" ".join(self.vocab)], "places": [places.tobytes()], "n": [int((places > 0).sum())]}, _LAYOUT)


def _shards(batches: Iterator[pa.RecordBatch], shard: int, portion: int) -> Iterator[pa.RecordBatch]:
    """Rows of LAYOUT; whatever the number of languages, a task holds so many places and a text at most."""
    held: dict[str, _Shard] = defaultdict(_Shard)
    n = 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for k, lang in enumerate(batch.column(0).to_pylist()):
            own = held[lang]
            n -= own.n
            own.add(texts[k].as_py(), portion)
            n += own.n + 1
            if n >= shard:
                most = max(held, key=lambda x: held[x].n)
                n -= held[most].n
                yield held.pop(most).row(most)
    for lang, own in held.items():
        yield own.row(lang)


# --- bitmaps ---------------------------------------------------------------------------------------------------------


class Bitmaps:
    """The places of a shard's kept words as bitmaps in parts of 32, empty ones left out, by part and then word."""

    def __init__(self, places: np.ndarray, keep: np.ndarray):
        at = np.flatnonzero(keep[places])
        # one number for each place: its part, its word, and its bit in the part
        key = at >> 5 << 32 | places[at].astype(np.int64) << 5 | at & 31
        key.sort()
        first = np.flatnonzero(np.append(True, np.diff(key >> 5) != 0)) if len(at) else np.zeros(0, np.int64)
        bit = np.left_shift(np.uint32(1), (key & 31).astype(np.uint32))
        self.bits = np.bitwise_or.reduceat(bit, first) if len(at) else np.zeros(0, np.uint32)
        key = key[first]
        self.word, self.part = (key >> 5 & (1 << 27) - 1).astype(np.int32), (key >> 32).astype(np.int32)
        self.begin = np.searchsorted(self.part, np.arange((len(places) >> 5) + 3, dtype=np.int32))
        self.size = len(keep)

    def counts(self) -> np.ndarray:
        """Popcount of each word's bitmap."""
        return np.bincount(self.word, np.bitwise_count(self.bits), self.size).astype(np.int64)

    def extended(self, owner: np.ndarray, part: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shifts bitmaps by a place and ANDs them with those of all words: owner, word, part and bits of what is left.

        A bit that leaves its part begins a second entry of the next one; entries of a part never share a bit.
        """
        low, carry = bits << np.uint32(1), bits >> np.uint32(31)
        some, over = low > 0, carry > 0
        owner, part, bits = (np.concatenate(x) for x in ((owner[some], owner[over]), (part[some], part[over] + 1), (low[some], carry[over])))
        n = self.begin[part + 1] - self.begin[part]
        take = np.repeat(self.begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.repeat(bits, n) & self.bits[take]
        hit = np.flatnonzero(both)
        take, of = take[hit], np.repeat(np.arange(len(part)), n)[hit]
        return owner[of], self.word[take], self.part[take], both[hit]


def grown(maps: Bitmaps, phrases: np.ndarray, owner: np.ndarray, part: np.ndarray, bits: np.ndarray, longest: int, follows, bundle: int = BUNDLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first extensions of phrases (a row of word numbers each, owner says whose a bitmap entry is) with their counts.

    follows(before, word) says which words may stand after the phrases before (a row each), or is None for all.
    """
    owner, word, part, bits = maps.extended(owner, part, bits)
    if follows is not None:
        may = follows(phrases[owner], word)
        owner, word, part, bits = owner[may], word[may], part[may], bits[may]
    if not len(owner):
        return
    key = owner.astype(np.int64) * maps.size + word
    order = np.argsort(key, kind="stable")
    key, part, bits = key[order], part[order], bits[order]
    new = np.append(True, np.diff(key) != 0)
    first = np.flatnonzero(new)
    longer = np.hstack([phrases[key[first] // maps.size], (key[first] % maps.size)[:, None]])
    yield longer, np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    if longer.shape[1] < longest:
        owner = np.cumsum(new) - 1
        for a, b in _bundles(owner, bundle):
            yield from grown(maps, longer, owner[a:b], part[a:b], bits[a:b], longest, follows, bundle)


def _bundles(owner: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about so many entries that begin and end with an owner's."""
    at = 0
    while at < len(owner):
        end = int(np.searchsorted(owner, owner[min(at + size, len(owner)) - 1], "right"))
        yield at, end
        at = end


# --- what is frequent ------------------------------------------------------------------------------------------------


class Keys:
    """A set of hashed keys as a bitmap of a bounded size: what is in the set passes, others seldom do."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(64 * len(cells) - 1)

    @classmethod
    def of(cls, frame: DataFrame, key: Column) -> Keys:
        """From the rows of a frame; the driver gets an eight-byte cell for each 64 bits at most."""
        size = 64
        most = frame.count()
        while size < min(KEY_BITS * most, MOST_BITS):
            size *= 2
        at = key.bitwiseAND(F.lit(size - 1))
        cells = frame.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63L AS int))")).alias("bits")).toArrow()
        found = np.zeros(size // 64, np.uint64)
        found[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
        return cls(found)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same as _pair_key(), from the words' keys."""
    return a ^ (b << np.uint64(1) | b >> np.uint64(63))


def _of_three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A key of three words, from theirs."""
    return _of_two(a, b) ^ (c << np.uint64(2) | c >> np.uint64(62))


def _word_key(word: Column) -> Column:
    return F.xxhash64("lang", word)


def _pair_key(phrase: Column) -> Column:
    """Of two words: that of the first, and that of the second turned by a bit."""
    a, b = _word_key(F.substring_index(phrase, " ", 1)), _word_key(F.substring_index(phrase, " ", -1))
    return a.bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63)))


def _word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """The same as _word_key(); a boundary has none."""
    seed = xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _slice_rows(part: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of SLICES for sorted buckets; their low and high bytes lie apart, which packs well."""
    first = np.flatnonzero(np.append(True, np.diff(at // SLICE) != 0)) if len(at) else np.zeros(0, np.int64)
    rows: dict[str, list] = {"slice": [], "part": [], "at": [], "counts": []}
    for a, b in zip(first, np.append(first[1:], len(at))[: len(first)], strict=True):
        own = counts[a:b]
        rows["slice"].append(int(at[a]) // SLICE)
        rows["part"].append(part)
        rows["at"].append((at[a:b] % SLICE).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())
        rows["counts"].append(own.astype("u1" if own.max() < 256 else "<u4" if own.max() < 1 << 32 else "<u8").tobytes())
    return pa.RecordBatch.from_pydict(rows, _SLICES)


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """How often the words, pairs and triples of each shard fall into which bucket."""
    n = TaskContext.get().partitionId() * 1009
    for batch in batches:
        for k in range(batch.num_rows):
            places = np.frombuffer(batch.column(2)[k].as_buffer(), np.int32)
            keys = _word_keys(batch.column(0)[k].as_py(), batch.column(1)[k].as_py().split(b" "))
            words = np.bincount(places, minlength=len(keys))
            words[0] = 0
            mask, word = np.uint64(buckets - 1), places > 0
            left = np.flatnonzero(word[:-1] & word[1:])
            pairs = (_of_two(keys[places[left]], keys[places[left + 1]]) & mask).astype(np.uint32)
            left = np.flatnonzero(word[:-2] & word[1:-1] & word[2:])
            triples = (_of_three(keys[places[left]], keys[places[left + 1]], keys[places[left + 2]]) & mask).astype(np.uint32)
            more, times = np.unique(np.concatenate([pairs, triples]), return_counts=True)
            at = np.concatenate([more, (keys & mask).astype(np.uint32)])
            order = np.argsort(at, kind="stable")
            at, counts = at[order], np.concatenate([times, words])[order]
            first = np.flatnonzero(np.append(True, np.diff(at) != 0))
            counts = np.add.reduceat(counts, first)
            some = counts > 0
            n += 1
            yield _slice_rows(n % parts, at[first][some].astype(np.int64), counts[some])


def _adder(parts: int, least: int | None = None) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """Adds a slice's rows to a row of the next level; or, with least, to a bit for each bucket that reaches it."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _added(key, rows, parts, least)

    return run


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table, parts: int, least: int | None) -> pa.Table:
    sums = np.zeros(SLICE, np.int64)
    for at, counts in zip(rows["at"], rows["counts"], strict=True):
        at = np.frombuffer(at.as_buffer(), np.uint8).reshape(2, -1).T.copy().view("<u2").reshape(-1)
        data = counts.as_buffer()
        sums[at] += np.frombuffer(data, {1: "u1", 4: "<u4", 8: "<u8"}[len(data) // len(at)]).astype(np.int64)
    index = key[0].as_py()
    if least is not None:
        bits = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.Table.from_pydict({"slice": [index], "part": [0], "at": [bits], "counts": [b""]}, _SLICES)
    found = np.flatnonzero(sums)
    return pa.Table.from_batches([_slice_rows(key[1].as_py() % parts, found + index * SLICE, sums[found])])


def _frequent_buckets(layout: DataFrame, least: int) -> Keys:
    """The buckets whose words, pairs and triples come least times or more in all; what comes so often is in one of them.

    Shards of a slice are added in groups of about GROUP filled buckets, and these sums in levels of FAN rows, so a slice is never
    one group of all shards. The driver gets a bit for each bucket.
    """
    places, shards = layout.agg(F.sum("n"), F.count("*")).first()
    buckets = LEAST_BUCKETS
    while buckets < min((places or 0) // LOAD, MOST_BUCKETS):
        buckets *= 2
    # words, pairs and triples fill three buckets a place at most
    parts = max(1, min(shards, -(-3 * (places or 0) * SLICE // (buckets * GROUP))))
    sums = layout.mapInArrow(given_back(partial(_bucketed, buckets=buckets, parts=parts)), SLICES)
    while parts > 1:
        fewer = -(-parts // FAN)
        sums = sums.groupBy("slice", "part").applyInArrow(_adder(fewer), SLICES)
        parts = fewer
    found = sums.groupBy("slice").applyInArrow(_adder(1, least), SLICES).select("slice", "at").toArrow()
    cells = np.zeros(buckets // 64, np.uint64)
    for index, bits in zip(found["slice"].to_pylist(), found["at"], strict=True):
        cells[index * (SLICE // 64) : (index + 1) * (SLICE // 64)] = np.frombuffer(bits.as_buffer(), "<u8")
    return Keys(cells)


def _counted(batches: Iterator[pa.RecordBatch], size: int, longest: int, words: Keys, pairs: Keys, triples: Keys | None, bundle: int) -> Iterator[pa.RecordBatch]:
    """Counts of one round in each shard: pairs of words (size 2), or words and what is longer (3), of those that pass."""

    def may_follow(keys: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        may = pairs.has(_of_two(keys[before[:, -1]], keys[word]))
        if triples is not None and before.shape[1] > 1:
            may &= triples.has(_of_three(keys[before[:, -2]], keys[before[:, -1]], keys[word]))
        return may

    for batch in batches:
        for k in range(batch.num_rows):
            lang, text, places = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), np.frombuffer(batch.column(2)[k].as_buffer(), np.int32)
            vocab = text.split(b" ")
            keys = _word_keys(lang, vocab)
            keep = words.has(keys)
            keep[0] = False
            maps, names = Bitmaps(places, keep), pa.array(vocab, pa.binary())
            if size > 2:
                counts = maps.counts()
                found = np.flatnonzero(counts)
                yield from _rows(lang, names, found[:, None], counts[found])
            if longest < size:
                continue
            follows = partial(may_follow, keys)
            order = np.argsort(maps.word, kind="stable")
            word, part, bits = maps.word[order], maps.part[order], maps.bits[order]
            single = np.arange(len(vocab))[:, None]
            for a, b in _bundles(word, bundle):
                for phrases, n in grown(maps, single, word[a:b], part[a:b], bits[a:b], longest, follows, bundle):
                    if phrases.shape[1] >= size:
                        yield from _rows(lang, names, phrases, n)


def _rows(lang: str, names: pa.Array, phrases: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 50_000):
        some = phrases[at : at + 50_000]
        parts = [names.take(pa.array(some[:, k])) for k in range(some.shape[1])]
        text = (pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), text, pa.array(np.full(len(some), some.shape[1], np.int32)), pa.array(n[at : at + 50_000])], schema=_COUNTS)


def _summed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds up what a task's shards count, so that a phrase leaves a task once; whenever most phrases are held, they go out."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 2 * most:
            held = [_added_up(held)]
            n = held[0].num_rows
            if n >= most:
                yield from held
                held, n = [], 0
    if n:
        yield _added_up(held)


def _added_up(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    found = pa.Table.from_batches(batches, _COUNTS).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
    return found.rename_columns(["lang", "phrase", "size", "n"]).select(_COUNTS.names).cast(_COUNTS).combine_chunks().to_batches()[0]


# --- phrases and their scores ----------------------------------------------------------------------------------------


def _frequent(layout: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, size and n of all phrases of 2 to longest words that occur least times or more, and of their words."""
    spark = layout.sparkSession
    if longest < 2:
        return spark.createDataFrame([], COUNTS)

    def summed(size: int, longest: int, words: Keys, pairs: Keys, triples: Keys | None = None) -> DataFrame:
        count, most = partial(_counted, size=size, longest=longest, words=words, pairs=pairs, triples=triples, bundle=BUNDLE), ADDED
        counts = layout.mapInArrow(given_back(lambda batches: _summed(count(batches), most)), COUNTS)
        return saved(counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-counts")

    often = _frequent_buckets(layout, least)
    twos = summed(2, 2, often, often)
    words = twos.select("lang", F.explode(F.split("phrase", " ")).alias("word")).distinct()
    return twos.union(summed(3, longest, Keys.of(words, _word_key(F.col("word"))), Keys.of(twos, _pair_key(F.col("phrase"))), often))


def _whole(name: str) -> Column:
    """A count as a decimal of 19 digits, of which two have an exact product."""
    return F.col(name).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best-scored phrases of each language of docs(lang, text), by counts over all whole texts.

    A-Z count as a-z. Texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. All counts
    are per lang: n of all words, a of the phrase (2 to longest words, least occurrences or more, overlapping ones too).
    Cut after its first k words a phrase has the score floor(1000*a*n/(l*r)) of the counts l and r of its two parts; the
    lowest-scoring cut holds, at ties the smallest k. A phrase that stands in one a word longer with the same count says
    nothing more and goes: if any longer phrase has its count, one that is longer by a word has. Returns lang, rank (from
    1), phrase (space-joined), a, l, r, n, score, cut: the first top rows of each lang by score and a, both descending,
    then phrase.

    A null lang is `und`, a null text is empty. Empty texts have no words; repeated rows count each time; a text of any
    length is counted whole, and one shard. Ties are decided to the end, as a phrase is there once. Other columns, whatever
    their names, are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    layout = saved(texts.mapInArrow(given_back(partial(_shards, shard=SHARD, portion=PORTION)), LAYOUT), "phrase-shards")
    found = _frequent(layout, least, longest)
    totals = layout.groupBy("lang").agg(F.sum("n").alias("total"))
    words = F.split("phrase", " ")
    longer = found.where("size > 2").withColumn("w", words).withColumn("w", F.explode(F.array(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"))))
    longer = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("n").alias("within"))
    alone = found.where("size > 1").join(longer, ["lang", "phrase"], "left").where("within IS NULL OR within < n").drop("within")
    cuts = alone.withColumn("w", words).select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    cuts = cuts.join(counts.withColumnsRenamed({"part": "first", "count": "l"}), ["lang", "first"]).join(counts.withColumnsRenamed({"part": "rest", "count": "r"}), ["lang", "rest"])
    scored = cuts.join(totals, "lang").withColumns({c: _whole(c) for c in ("a", "l", "r", "total")})
    # 1000 * a <= 1000 * n is taken in two steps, as the product of three may pass 38 digits where that of two doesn't
    scored = scored.withColumn("score", F.expr("(CAST(1000 * a AS decimal(19,0)) * total) div (l * r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("score", "a", "l", "r", "total", "k"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    best = saved(best, "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = best.groupBy("lang").count().select("lang", (F.floor(F.col("count") / SORTED) + 1).alias("groups"))
    best = best.join(groups, "lang").withColumn("group", F.pmod(F.xxhash64("phrase"), F.col("groups")))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    whole = {"rank": "rank", "phrase": None, "a": "a", "l": "l", "r": "r", "n": "total", "score": "score", "cut": "k"}
    return best.select("lang", *[F.col(c) if of is None else F.col(of).cast("long").alias(c) for c, of in whole.items()])


def collocations_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """lang, rank, phrase, a, l, r, n, score and cut of documents, for DuckDB."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM w),
s AS (SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, k AS size FROM g, (SELECT unnest(range(1, {longest + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, size, CAST(count(*) AS HUGEINT) AS a FROM s GROUP BY lang, phrase, size HAVING count(*) >= {least}),
fw AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
inner_of AS (SELECT lang, array_to_string(w[o:o+k-1], ' ') AS phrase, max(a) AS within FROM fw, (SELECT unnest(range(2, {longest + 1})) AS k), (SELECT unnest(range(1, {longest + 1})) AS o)
  WHERE k < size AND o + k - 1 <= size GROUP BY 1, 2),
c AS (SELECT fw.lang, fw.phrase, fw.a, w, size, unnest(range(1, size)) AS k FROM fw LEFT JOIN inner_of i ON fw.lang = i.lang AND fw.phrase = i.phrase
  WHERE size > 1 AND (within IS NULL OR 100 * within < 100 * fw.a)),
x AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, k, 1000 * c.a * t.n // (l.a * r.a) AS score FROM c JOIN t ON c.lang = t.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k+1:c.size], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, k AS cut FROM o WHERE rank <= {top}"""
