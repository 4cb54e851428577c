"""SentencePiece encoding and decoding by a Viterbi search that words with a common prefix share.

A text is marked (a space becomes the mark, one mark goes in front) and cut where a mark follows another character; no
piece reaches over such a cut. The distinct marked words of a portion of texts are sorted, which lays out their trie depth
first: from one word to the next only what follows their common prefix is computed, and the forward scores up to there
stay. A vocabulary file names its kind: with unigram scores the best sum wins; with merges (BPE) an edge of the lattice
is allowed if merging its two pieces' text gives just these two pieces, and exactly one path is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .common import given_back

#: The mark that stands for a space.
MARK = "▁"
#: Vocabulary file of the queries, as /opt/tokenizers/README.md describes it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a portion of texts, characters of words (each WORD more than it has) and pairs that a process remembers,
#: steps between nodes that it does, ids of a batch that goes out.
PORTION, HELD, WORD, PAIRS, STEPS, IDS = 1 << 20, 12 << 20, 16, 1 << 18, 1 << 18, 1 << 19
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    """Names of the pieces by id (empty: not a piece), their scores, the ids of bytes (-1: none), and the file's settings.

    parts has every substring of a piece.
    """

    names: list[str]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    merges: bool
    first_mark: bool = True

    def __post_init__(self):
        spelling = set(self.byte_ids)
        self.ids = {name: i for i, name in enumerate(self.names) if name and i not in spelling}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        if len(self.names) > 1 << 20:
            raise ValueError("a vocabulary has 1,048,576 pieces at most")
        self.parts = {p[k:n] for p in self.ids for n in range(1, len(p) + 1) for k in range(n)}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def vocabulary(data: bytes) -> Vocabulary:
    """Reads a SentencePiece model file. Files that rewrite texts beforehand (normalisation rules) are refused."""
    # Field numbers and piece types of the public file format.
    pieces_field, trainer_field, normaliser_field = 1, 2, 3
    normal, unknown_type, user, unused, byte = 1, 2, 4, 5, 6
    scores, byte_ids, names, unknown, merges, mark = [], [-1] * 256, [], 0, False, True
    for number, value in _fields(data):
        if number == pieces_field:
            of = dict(_fields(value))
            name, kind = of[1].decode(), of.get(3, normal)
            if kind == byte:
                byte_ids[int(name[3:5], 16)] = len(names)
            elif kind == unknown_type:
                unknown = len(names)
            scores.append(float(np.frombuffer(of[2], "<f4")[0]) if 2 in of else 0.0)
            names.append(name if kind in (normal, user, unused, byte) else "")
        elif number == trainer_field:
            merges = dict(_fields(value)).get(3, 1) == 2
        elif number == normaliser_field:
            of = dict(_fields(value))
            mark = bool(of.get(3, 1))
            if of.get(2) or of.get(4, 1):
                raise ValueError("the file's normalisation rules aren't supported")
    return Vocabulary(names, scores, byte_ids, unknown, merges, mark)


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """Reads a model file by Spark, from any store; its size is fixed, so tasks get it whole."""
    uri = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()[0])


class Node:
    """The longest part of a piece that ends a prefix: its text, length and id of the pieces that end it, the longest first,
    and the nodes after it by the next character, as far as they are known."""

    __slots__ = ("text", "found", "after")

    def __init__(self, text: str, found: list[tuple[int, int]]):
        self.text, self.found, self.after = text, found, {}


class Encoder:
    """Finds the pieces of marked words; it remembers words of HELD characters together, up to PAIRS pairs of pieces and STEPS
    steps between nodes, of which there are as many as the pieces have parts at most.

    A text without spaces is one word, so what is remembered is bounded by characters. Within the search a piece is its
    id, and a character without a piece is ~ of its code point.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.nodes, self.steps = {"": Node("", [])}, 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: of neighbours that form a piece, the best-scored, leftmost, first."""
        parts, ids, scores = list(text), self.vocab.ids, self.vocab.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int | None, piece: int) -> bool:
        """Whether merging leaves the two as they are; before is None at the start of a word."""
        names = self.vocab.names
        if before is None:
            return self.merged(names[piece]) == [names[piece]]
        first = names[before] if before >= 0 else chr(~before)
        return self.merged(first + names[piece]) == [first, names[piece]]

    def step(self, node: Node, character: str) -> Node:
        """The node after a character; nodes that are known already are reached by node.after alone."""
        text, parts = node.text + character, self.vocab.parts
        while text and text not in parts:
            text = text[1:]
        found = self.nodes.get(text)
        if found is None:
            ids = self.vocab.ids
            found = self.nodes[text] = Node(text, [(len(text) - k, ids[text[k:]]) for k in range(len(text)) if text[k:] in ids])
        if self.steps >= STEPS:
            for other in self.nodes.values():
                other.after.clear()
            self.steps = 0
        self.steps += 1
        node.after[character] = found
        return found

    def merge_steps(self, word: str, shared: int, lasts: list[int], starts: list[int], nodes: list[Node]) -> None:
        """Appends for each end of word after shared its node, the last piece of word[:end] and that one's start: the longest
        piece that fits what ends where it starts.

        A file of merges has an order and no scores to add: what the prefixes share is the one path that merging takes, and
        no sum is carried on. score_steps() is the same for a file of scores.
        """
        node, pairs = nodes[-1], self.pairs
        for end, character in enumerate(word[shared:], shared + 1):
            node = node.after.get(character) or self.step(node, character)
            for size, piece in node.found:
                start = end - size
                key = (lasts[start] << 20) + piece if start else (1 << 60) + piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.fits(lasts[start] if start else None, piece)
                if fits:
                    lasts.append(piece)
                    starts.append(start)
                    break
            else:
                lasts.append(~ord(character))
                starts.append(end - 1)
            nodes.append(node)

    def score_steps(self, word: str, shared: int, lasts: list[int], starts: list[int], nodes: list[Node], sums: list[float]) -> None:
        """Appends for each end of word after shared its node, the last piece of the best path to word[:end], its start and the
        path's sum of scores."""
        node, vocab = nodes[-1], self.vocab
        for end, character in enumerate(word[shared:], shared + 1):
            node = node.after.get(character) or self.step(node, character)
            best = (sums[end - 1] + vocab.worst, ~ord(character), end - 1)
            for size, piece in reversed(node.found):
                start = end - size
                if size == 1 or sums[start] + vocab.scores[piece] > best[0]:
                    best = (sums[start] + vocab.scores[piece], piece, start)
            sums.append(best[0])
            lasts.append(best[1])
            starts.append(best[2])
            nodes.append(node)

    def spelled(self, piece: int) -> list[int]:
        """The ids of a piece: its own, or those of an unknown character's bytes."""
        if piece >= 0:
            return [piece]
        found = [self.vocab.byte_ids[b] for b in chr(~piece).encode("utf-8", "replace")]
        return found if min(found) >= 0 else [self.vocab.unknown]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes distinct words in the order of their trie, depth first: what a word shares with the last one stays."""
        before, merges = "", self.vocab.merges
        lasts, starts, sums, nodes = [0], [0], [0.0], [self.nodes[""]]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :], starts[shared + 1 :], sums[shared + 1 :], nodes[shared + 1 :]
            if merges:
                self.merge_steps(word, shared, lasts, starts, nodes)
            else:
                self.score_steps(word, shared, lasts, starts, nodes, sums)
            path, at = array("i"), len(word)
            while at:
                if lasts[at] >= 0:
                    path.append(lasts[at])
                else:
                    path.extend(reversed(self.spelled(lasts[at])))
                at = starts[at]
            path.reverse()
            self.words[word] = path.tobytes()
            before = word

    def marked(self, text: str) -> list[str]:
        """The marked words of a text."""
        return _WORD.findall((MARK if self.vocab.first_mark and text else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids, as 32-bit numbers."""
        cut = [self.marked(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.words)
        self.held += sum(map(len, new)) + WORD * len(new)
        if self.held > HELD:
            self.words = {w: ids for w, ids in self.words.items() if w in every}
            self.held = sum(map(len, every)) + WORD * len(every)
        self.learn(new)
        for words in cut:
            yield b"".join(map(self.words.__getitem__, words))


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.raw = [n.replace(MARK, " ").encode() for n in vocab.names]
        for value, at in enumerate(vocab.byte_ids):
            if at >= 0:
                self.raw[at] = bytes([value])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; ids outside the vocabulary and control pieces have none, broken UTF-8 is replaced."""
        n = len(self.raw)
        text = b"".join([self.raw[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.vocab.first_mark and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    """An encoder for each process, so that tasks that follow each other share what it remembers."""
    return Encoder(vocabulary(model))


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts from a batch, about PORTION characters at a time, with the place of the first; null counts as empty."""
    first, held, size = 0, [], 0
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= PORTION:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _with(docs: DataFrame, column: str, kind: DataType, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs with another column, which make adds last; one of that name in either case is replaced."""
    kept = docs.select(*[c for c in docs.columns if c.lower() != column.lower()])
    return kept.mapInArrow(given_back(make), StructType([*kept.schema.fields, StructField(column, kind)]))


def encode_texts(docs: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """Adds the ids (array of int) of each whole text of docs(text) and keeps all rows and other columns.

    model is a SentencePiece file. A column that has the name already, in either case, is replaced. A null or empty text has no ids; a
    character without a piece is spelled in bytes, or is the unknown id where the vocabulary has no bytes. Repeated rows
    have the same ids each, and an empty table gives an empty one. There is no shuffle: each task encodes what it reads, in
    portions, so memory is bounded by the longest text and the caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first, texts in _portions(batch.column(at)):
                parts, ends, start = [], [0], 0
                for k, ids in enumerate(encoder.encode(texts)):
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                    if ends[-1] >= IDS or k == len(texts) - 1:
                        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                        part = batch.slice(first + start, k + 1 - start)
                        yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, column])
                        parts, ends, start = [], [0], k + 1

    return _with(docs, column, ArrayType(IntegerType()), run)


def decode_ids(frame: DataFrame, model: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds the text that the ids of frame(ids) stand for, and keeps all rows and other columns.

    Null ids give null, empty ones an empty text; ids outside the vocabulary, null ones among them and control pieces stand
    for nothing, and bytes that aren't UTF-8 are replaced. A column of that name, in either case, is replaced. Repeated rows
    have the same text each, a very long list of ids is decoded whole, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_encoder(model).vocab)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else decoder.decode(x) for x in (v.as_py() for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return _with(frame, column, StringType(), run)


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, lossless and ids of each row of docs(doc_id, text), by encoding and decoding.

    lossless says whether decoding the ids gives the text again; it does but for texts with the mark itself (it comes
    back as a space) or with what the vocabulary can't spell. A null text counts as empty; rows without doc_id and repeated
    rows have a row each; other columns are ignored, and an empty table gives an empty one. Very long texts are encoded
    whole. Both ways are gone in one pass, so that a task has one Python process.
    """
    vocab = vocabulary(model)
    spells = np.isin(np.arange(len(vocab.names)), vocab.byte_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        decoder = Decoder(encoder.vocab)
        for batch in batches:
            for first, texts in _portions(batch.column(1)):
                rows = []
                for text, data in zip(texts, encoder.encode(texts), strict=True):
                    ids = np.frombuffer(data, np.int32)
                    rows.append((len(ids), int(np.count_nonzero(spells[ids])), decoder.decode(ids.tolist()) == text, ids))
                n, spelled, lossless, ids = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(ids)))
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(spelled, pa.int64()), pa.array(lossless), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_byte_tokens", "lossless", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(given_back(run), "doc_id long, n_tokens long, n_byte_tokens long, lossless boolean, ids array<int>")
