"""Periodic runs of words: stretches in which a few words come again and again.

The longest Lyndon word that starts at each word is found by a stack, scanned from right to left, under an order of words
and under its reverse. Each run has such a word as its root under one of them, so extending these roots to both sides finds
all runs. Suffixes are compared and roots extended by how far two places agree, which a binary search over rolling hashes
finds; words then verify it, so hashes decide nothing. No suffix array is made.

Most texts hold no run, and only stretches that may are scanned. In a run of period q every word but the last q comes again
within q words, so a run lies where many words in a row come again soon (candidates()).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import given_back

#: Words of a run at least, and periods in it at least.
SHORTEST, PERIODS = 6, 4
#: Words that are looked at together, and bytes of a text made into words at once.
BATCH, PORTION = 1 << 19, 1 << 22
#: Words compared one by one before hashes are.
DIRECT = 8

_MASK = (1 << 64) - 1
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Words:
    """The words of a text as numbers, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.w, self.n = ids.tolist(), len(ids)
        self.raw = ids.astype("<i4").tobytes()
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        power = np.cumprod(np.append(np.uint64(1), np.full(self.n, 0xBF58476D1CE4E5B9, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(x * power[: self.n])).tolist()
        self.power = power.tolist()
        # by distance: where a stretch begins and ends in which each word is that at the distance after it
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, n: int) -> bool:
        """Whether the hashes of n words from i and from j on are equal; i < j."""
        s = self.sums
        return not ((s[i + n] - s[i]) * self.power[j - i] - s[j + n] + s[j]) & _MASK

    def _same(self, i: int, j: int, n: int) -> bool:
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def ahead(self, i: int, j: int) -> int:
        """How many words from i and from j on are the same; i < j."""
        w, most = self.w, self.n - j
        for n in range(min(DIRECT, most)):
            if w[i + n] != w[j + n]:
                return n
        if most <= DIRECT:
            return most
        begin, end = self.known.get(j - i, (0, 0))
        if begin <= i < end:
            return end - i
        if i < begin and self._alike(i, j, begin - i) and self._same(i, j, begin - i):
            self.known[j - i] = (i, end)
            return end - i
        low, step = DIRECT, DIRECT
        while low + step <= most and self._alike(i, j, low + step):
            low, step = low + step, 2 * step
        high = min(low + step, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._alike(i, j, middle) else (low, middle)
        if not self._same(i, j, low) or low < most and w[i + low] == w[j + low]:
            low = 0
            while low < most and w[i + low] == w[j + low]:
                low += 1
        self.known[j - i] = (i, i + low)
        return low

    def behind(self, i: int, j: int) -> int:
        """How many words before i and before j are the same; i < j."""
        low, high = 0, i + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._alike(i - middle, j - middle, middle) else (low, middle)
        if not self._same(i - low, j - low, low) or low < i and self.w[i - low - 1] == self.w[j - low - 1]:
            low = 0
            while low < i and self.w[i - low - 1] == self.w[j - low - 1]:
                low += 1
        return low

    def runs(self, begin: int, end: int) -> set[tuple[int, int, int]]:
        """Start, length and period of the runs that lie within a stretch."""
        w, found = self.w, set()
        for up in (True, False):
            after = [0] * (end - begin)
            for i in range(end - 1, begin - 1, -1):
                a, j = w[i], i + 1
                while j < end:
                    b = w[j]
                    if a == b:
                        n = self.ahead(i, j)
                        if j + n >= end:
                            break  # the suffix from j on is a beginning of that from i on, hence less
                        less = w[i + n] < w[j + n]
                    else:
                        less = a < b
                    if less is not up:
                        break
                    j = after[j - begin]
                after[i - begin] = j
                if j < end and w[j] == a:
                    period = j - i
                    # the leftmost root of a run has less than a period before it and PERIODS - 2 whole ones after it
                    n = self.ahead(i, j)
                    if n <= (PERIODS - 2) * period or n + 2 * period <= SHORTEST:
                        continue
                    if i >= period and self._same(i - period, j - period, period):
                        continue
                    before = self.behind(i, j)
                    length = before + period + n
                    if length >= max(SHORTEST, PERIODS * period):
                        found.add((i - before, length, period))
        return found


def candidates(tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts, one after another in tokens, that hold all runs; starts has where texts begin, and the end.

    A run of period q in m / 2 < q <= m begins with (PERIODS - 1) * q words, SHORTEST - q at least, of which each comes
    again within m words. The last word of a text never comes again, so no stretch crosses texts.
    """
    n = len(tokens)
    if not n:
        return
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = text << 32 | tokens
    order = np.argsort(key, kind="stable")
    again = np.full(n, n, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    inside = np.zeros(n + 1, np.int64)
    m, longest = 1, int(np.diff(starts).max())
    while True:
        soon = np.concatenate([[False], again <= m, [False]])
        edge = np.flatnonzero(soon[1:] != soon[:-1]).reshape(-1, 2)
        least = m // 2 + 1
        edge = edge[edge[:, 1] - edge[:, 0] >= max((PERIODS - 1) * least, SHORTEST - m)]
        np.add.at(inside, edge[:, 0], 1)
        np.add.at(inside, np.minimum(edge[:, 1] + m, starts[text[edge[:, 0]] + 1]), -1)
        if PERIODS * m >= longest:
            break
        m *= 2
    within = np.cumsum(inside)[:n] > 0
    # neighbours of two texts are told apart
    cut = np.zeros(n, bool)
    cut[starts[:-1][np.diff(starts) > 0]] = True
    begins = np.flatnonzero(within & (cut | ~np.append(False, within[:-1])))
    ends = np.flatnonzero(within & (np.append(cut[1:], True) | ~np.append(within[1:], False))) + 1
    yield from zip(begins.tolist(), ends.tolist(), strict=True)


def found_runs(tokens: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) in order of each text that has some, by its number."""
    found: dict[int, set] = defaultdict(set)
    words, of = None, -1
    for begin, end in candidates(tokens, starts):
        text = int(np.searchsorted(starts, begin, "right")) - 1
        first = int(starts[text])
        if text != of:
            words, of = Words(tokens[first : starts[text + 1]]), text
        found[text] |= words.runs(begin - first, end - first)
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in found.items() if v}


def _words(text: bytes, vocab: dict[bytes, int]) -> np.ndarray:
    parts, at = [], 0
    while at < len(text):
        end = at + PORTION
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        own = text[at:end].split()
        parts.append(np.fromiter(map(vocab.__getitem__, own), np.int32, len(own)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _batch(ids: list, texts: list[np.ndarray], vocab: dict[bytes, int]) -> pa.RecordBatch:
    starts = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    tokens = np.concatenate(texts).astype(np.int64)
    found = found_runs(tokens, starts)
    names, kept = list(vocab), []
    for k, text in enumerate(texts):
        if k in found:
            stays = np.ones(len(text), bool)
            for start, length, period in found[k]:
                stays[start + period : start + length] = False
            text = text[stays]
        kept.append(b" ".join(map(names.__getitem__, text.tolist())))
    rows = [r for k in range(len(texts)) for r in found.get(k, ())]
    flat = np.array(rows, np.int64).reshape(-1, 3)
    runs = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(found.get(k, ())) for k in range(len(texts))])).astype(np.int32), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(starts)), runs, pa.array(kept, pa.binary()).cast(pa.string())], schema=_FOUND)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[np.ndarray] = []
    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    n = 0
    for batch in batches:
        column = batch.column(1).cast(pa.binary())
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            ids.append(doc_id)
            texts.append(_words(column[k].as_py() or b"", vocab))
            n += len(texts[-1]) + 1
            if n >= BATCH:
                yield _batch(ids, texts, vocab)
                ids, texts, n = [], [], 0
                vocab.clear()
    if ids:
        yield _batch(ids, texts, vocab)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The periodic runs of each whole text of docs(doc_id, text), and the text without their repetitions.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, so that
    words q apart are the same, of SHORTEST words and PERIODS periods at least, that no neighbouring word extends. Runs may
    overlap and lie within others. Returns doc_id, n_words, runs (start, length, period; by start, then period) and text:
    the words joined by one space, but for those that a run contains after its first q words.

    One row for each row; repeated rows and rows without doc_id are like any other, other columns are ignored. A null or
    empty text has no words and no runs, and its text is empty. A very long text is made into words in portions and
    searched whole. An empty table gives an empty one.
    """
    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(given_back(_search), FOUND)
