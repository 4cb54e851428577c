"""SimHash near-duplicates of texts, paired by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import saved
from .components import components

#: Shingles of a text that are turned into bits at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned.

    ASCII letters are lower-cased, words are split at ASCII white space, and a bit is set if it is set in over half of
    the XXH64 values of the word shingles, repeats included. A text with fewer words is one shingle; without a word the
    fingerprint is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row of docs(doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(x.as_py() or b"", shingle, seed) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def ball_pairs(prints: DataFrame) -> DataFrame:
    """Links of distinct fingerprints (column fp) that differ in one or two bits: columns a and b, a star for each ball.

    Every fingerprint is dealt to all variants within half the radius: itself and 64 one-bit flips. Two fingerprints at
    distance two or less share a variant, and all that share one are within two bits of each other. A variant is reached
    by 65 fingerprints at most, so a bit mask holds a whole bucket and no bucket grows with the data. The fingerprints are
    few bytes, so adaptive execution would merge them into a task or two; they are dealt out again before they multiply.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flips = prints.select("fp").distinct().repartition(parts, "fp").select("fp", F.explode(F.expr("sequence(-1, 63)")).alias("bit"))
    flips = flips.select(
        F.expr("IF(bit < 0, fp, fp ^ shiftleft(1L, bit))").alias("variant"), F.expr("IF(bit < 0, 0L, shiftleft(1L, bit))").alias("flip"), F.expr("bit < 0").alias("itself")
    )
    balls = flips.groupBy("variant").agg(F.bit_or("flip").alias("mask"), F.bool_or("itself").alias("itself"))
    balls = balls.where("bit_count(mask) + int(itself) > 1")
    flipped = "transform(filter(sequence(0, 63), i -> getbit(mask, i) = 1), i -> variant ^ shiftleft(1L, i))"
    members = balls.select(F.expr(f"array_sort(concat(IF(itself, array(variant), array()), {flipped}))").alias("members"))
    pairs = members.select(F.expr("members[0]").alias("a"), F.explode(F.expr("slice(members, 2, size(members))")).alias("b"))
    return pairs.where("bit_count(a ^ b) <= 2").distinct()


def _grouped(found: DataFrame) -> DataFrame:
    """fp and component_id (the least doc_id among all rows of linked fingerprints) of the fingerprints of found(doc_id, fp).

    The fingerprints are the nodes of the graph, so rows without doc_id link like any other, and texts that share a doc_id
    stay apart. A group is named last.
    """
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(ball_pairs(first), "simhash-links").withColumnRenamed("node", "fp")
    named = linked.join(first, "fp").groupBy("component").agg(F.min("first").alias("least"))
    return first.join(linked.join(named, "component").select("fp", "least", F.lit(True).alias("is_linked")), "fp", "left").select("fp", F.expr("IF(is_linked, least, first)").alias("component_id"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose fingerprints are linked, directly or through others.

    Returns doc_id, fp (long), fingerprint (16 hex digits) and component_id (the least doc_id of the group), one row for
    each row of docs, repeated rows included. Equal fingerprints fall together before any pairing, so a group of copies
    costs one row. Empty and null texts have fingerprint zero and are linked like any other. Rows without doc_id belong to
    the group of their fingerprint and link others, but never name it; a group without any doc_id has a null
    component_id. A very long text is hashed in portions. Other columns of docs are ignored; an empty table gives an
    empty one.
    """
    found = saved(fingerprints(docs), "simhash-prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(_grouped(found), "fp").select("doc_id", "fp", hexed, "component_id")
