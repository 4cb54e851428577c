"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification. Spark SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: Words of a shingle, least weighted Jaccard similarity, and differing bits up to which fingerprints are compared. Bags at
#: SIMILAR differ in a bit with a probability of 0.15, or 0.19 where they hold four or five shingles; more than RADIUS of
#: 64 bits then differ about once in a million times.
SHINGLE, SIMILAR, RADIUS = 5, 0.8, 28
#: The part of an item's shingles that is looked for in all texts, the rarest of the benchmark first.
PROBED = 0.5
#: Probes, or keys of texts, up to which they are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000

#: Words are runs of letters and digits, in lower case.
_WORDS = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> '')"


def _shingled(frame: DataFrame) -> DataFrame:
    """Adds sh, the hashes of a text's shingles in order; texts with fewer words have none.

    The words are the argument of a lambda, so that they are made once however Spark moves the expression.
    """
    each = ", ".join(f"words[i + {k}]" for k in range(SHINGLE))
    shingles = f"IF(size(words) < {SHINGLE}, CAST(array() AS array<bigint>), transform(sequence(0, size(words) - {SHINGLE}), i -> xxhash64({each})))"
    return frame.withColumn("sh", F.expr(f"transform(array(transform({_WORDS}, w -> xxhash64(w))), words -> {shingles})[0]"))


def _numbered(of: str) -> str:
    """SQL: a bag of hashes as a set, each with which occurrence of it it is. {of} must be sorted."""
    return f"transform({of}, (x, i) -> xxhash64(x, i - array_position({of}, x)))"


def _simhash(of: str) -> str:
    """SQL: a bit is set if it is set in over half of the hashes."""
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(2 * size(filter({of}, x -> getbit(x, b) = 1)) > size({of}), shiftleft(1L, b), 0L))"


_EDGES = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
_MASKS = [((1 << (b - a)) - 1) << a for a, b in zip(_EDGES, _EDGES[1:], strict=False)]


def _blocks() -> str:
    """SQL: RADIUS + 1 blocks of the fingerprint fp; two fingerprints within the radius agree in one of them at least."""
    return "array(" + ", ".join(f"{k}L * {1 << 32}L + (shiftrightunsigned(fp, {a}) & {m >> a}L)" for k, (a, m) in enumerate(zip(_EDGES, _MASKS, strict=False))) + ")"


def _first_agreed() -> str:
    """SQL: the number of the first block in which fp and item_fp agree, so that a pair that meets in several counts once."""
    return "CASE " + " ".join(f"WHEN ((fp ^ item_fp) & shiftleft({m >> a}L, {a})) = 0 THEN {k}" for k, (a, m) in enumerate(zip(_EDGES, _MASKS, strict=False))) + " END"


def _keys(doc_id: str = "doc_id", text: str = "text") -> list:
    """128 bits for each distinct pair of doc_id and text, which nulls and repeated ids don't upset."""
    return [F.xxhash64(doc_id, text), F.xxhash64(text, doc_id, F.lit("key"))]


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, m (shingles), sh (sorted), bag and fp of the items that have a shingle."""
    found = _shingled(benchmark.select("item_id", "text")).where("size(sh) > 0").select("item_id", F.array_sort("sh").alias("sh"))
    return found.select("item_id", F.size("sh").alias("m"), "sh", F.expr(_numbered("sh")).alias("bag"), F.expr(_simhash("sh")).alias("fp"))


def _probes(items: DataFrame) -> DataFrame:
    """item_id, m, h, times and least: the shingles of each item that are looked for, and how many of them a window holds.

    A similar window lacks m - ceil(s * m) of an item's shingles at most, so of any choice that holds more it has the rest.
    Those are chosen that the fewest items have: what all items begin with is chosen last, and brings no text and item
    together that have nothing else in common.
    """
    known = items.select("item_id", "m", F.explode(F.expr("transform(array_distinct(sh), x -> named_struct('h', x, 'times', size(filter(sh, y -> y = x))))")).alias("x")).select("item_id", "m", "x.*")
    often = known.groupBy("h").agg(F.count("*").alias("items"))
    rare = known.join(often, "h").groupBy("item_id", "m").agg(F.array_sort(F.collect_list(F.struct("items", "h", "times"))).alias("all"))
    missing = f"(m - CAST(ceil({SIMILAR} * m - 1e-6) AS INT))"
    # as many as make up PROBED of the item, and one more than may be missing
    wanted = f"greatest(CAST(ceil({PROBED} * m) AS INT), {missing} + 1)"
    chosen = f"aggregate(all, named_struct('n', 0, 'x', CAST(array() AS array<struct<items:bigint,h:bigint,times:int>>)), (a, x) -> IF(a.n >= {wanted}, a, named_struct('n', a.n + x.times, 'x', array_append(a.x, x))))"
    found = rare.select("item_id", "m", F.expr(chosen).alias("c"))
    return found.select("item_id", "m", F.expr(f"c.n - {missing}").alias("least"), F.explode("c.x").alias("x")).select("item_id", "m", "least", "x.h", "x.times")


def _of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts joined with what was found of them by their keys; texts of which nothing was found aren't moved.

    The keys, 16 bytes each, pick the texts before the join; where they are too many to broadcast, all texts are moved.
    """
    keys = F.broadcast(found.select("k1", "k2"))
    return (texts.join(keys, ["k1", "k2"], "left_semi") if found.count() <= BROADCAST else texts).join(found, ["k1", "k2"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows of docs(doc_id, text) that repeat an item of benchmark(item_id, text): the best of each document and item.

    Returns the document's key (k1 and k2), doc_id, item_id, similarity (weighted Jaccard of the bags of five-word
    shingles, at least SIMILAR) and start (first word of the window, from 0; the first one where windows tie). Words are
    runs of letters and digits in lower case, so case and punctuation don't matter. Texts and items with fewer than five
    words, empty or null, match nothing. Repeated rows give one result for each doc_id and item_id; rows without doc_id
    have results too. A very long text costs a row for each of its shingles, and a window holds an item's length of it.
    Other columns are ignored; either table may be empty, and then so is the result.

    A window has as many shingles as the item, or fewer at the end of a text. If it is similar enough, so is the one that
    starts at its first shingle that the item has, and that one holds s / (1 + s) of both's shingles in such places: only
    those windows are made. Texts are first met by a part of each item's shingles (_probes()), all of them by those of the
    pieces around what was found. A window's fingerprint meets those of the items that it was made for in blocks, and each
    pair within the radius is compared exactly, once.
    """
    items = saved(_items(benchmark), "benchmark-items")
    probes = saved(_probes(items), "benchmark-probes")
    few = probes.count() <= BROADCAST
    k1, k2 = _keys()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    each = _shingled(texts.where(f"length(text) >= {2 * SHINGLE - 1}")).select("k1", "k2", F.posexplode_outer("sh").alias("at", "h"))
    found = each.join(F.broadcast(probes) if few else probes, "h").groupBy("k1", "k2", "item_id", "m", "least").agg(F.collect_set(F.struct("h", "times")).alias("has"), F.collect_set(F.expr("at div m")).alias("pieces"))
    found = found.where("aggregate(has, 0, (a, x) -> a + x.times) >= least")
    # a window that holds a probe lies in its piece of m shingles and those beside it
    pieces = F.expr("array_distinct(flatten(transform(pieces, p -> array(p - 1, p, p + 1))))")
    found = saved(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "m", pieces.alias("pieces"))).alias("of")), "benchmark-met")
    near = _shingled(_of(texts, found).dropDuplicates(["k1", "k2"])).select("k1", "k2", F.size("sh").alias("n"), "sh", F.explode_outer("of").alias("x")).select("k1", "k2", "n", "sh", "x.*")
    near = near.select("k1", "k2", "n", "item_id", "m", "sh", F.explode("pieces").alias("piece")).where("piece >= 0 AND piece * m < n")
    near = near.select("k1", "k2", "n", "item_id", "m", "piece", F.posexplode(F.expr("slice(sh, CAST(piece * m AS INT) + 1, m)")).alias("of", "h")).withColumn("at", F.expr("CAST(piece * m AS INT) + of"))
    known = items.select("item_id", F.explode(F.array_distinct("sh")).alias("h"))
    met = near.join(known, ["item_id", "h"])
    # the window at ats[k] has least(m, n - ats[k]) shingles, and the item m
    need = f"CAST(ceil({SIMILAR / (1 + SIMILAR)} * (least(m, n - ats[k]) + m) - 1e-6) AS INT)"
    met = met.groupBy("k1", "k2", "n", "item_id", "m").agg(F.array_sort(F.collect_set("at")).alias("ats")).where(f"size(ats) >= {SIMILAR} * m - 1e-6")
    enough = f"k + {need} <= size(ats) AND ats[least(k + {need}, size(ats)) - 1] < ats[k] + m"
    starts = F.expr(f"transform(filter(sequence(0, size(ats) - 1), k -> {enough}), k -> ats[k])")
    windows = met.select("k1", "k2", "item_id", "m", F.explode(starts).alias("start")).groupBy("k1", "k2", "m", "start").agg(F.collect_set("item_id").alias("item_ids"))
    windows = saved(windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "start", "item_ids")).alias("windows")), "benchmark-windows")
    hit = _shingled(_of(texts, windows)).select("k1", "k2", "doc_id", "sh", F.explode_outer("windows").alias("w"))
    cut = hit.select("k1", "k2", "doc_id", "w.start", "w.item_ids", F.expr("array_sort(slice(sh, w.start + 1, w.m))").alias("cut"))
    both = f"transform(array(cut), cut -> named_struct('bag', {_numbered('cut')}, 'fp', {_simhash('cut')}))[0]"
    cut = cut.select("k1", "k2", "doc_id", "start", "item_ids", F.expr(both).alias("made")).select("k1", "k2", "doc_id", "start", F.explode("item_ids").alias("item_id"), "made.bag", "made.fp")
    left = cut.withColumn("block", F.explode(F.expr(_blocks())))
    right = items.select("item_id", F.col("fp").alias("item_fp"), F.explode(F.expr(_blocks())).alias("block"))
    near = left.join(right, ["item_id", "block"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS} AND block div {1 << 32}L = {_first_agreed()}")
    pairs = near.join(items.select("item_id", F.col("bag").alias("item_bag")), "item_id")
    both = F.expr("size(array_intersect(bag, item_bag))")
    scored = pairs.select("k1", "k2", "doc_id", "item_id", "start", (both / (F.size("bag") + F.size("item_bag") - both)).alias("similarity"))
    best = scored.where(F.col("similarity") >= SIMILAR - 1e-9).groupBy("k1", "k2", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("k1", "k2", "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) that repeat no item of benchmark(item_id, text), all columns, whatever their names.

    A row goes if contaminated() finds an item in its text; rows are told by doc_id and text together, so rows that share
    a doc_id are judged by themselves, repeated rows alike, and rows without doc_id as any other. Null, empty and very short
    texts stay. An empty benchmark leaves all rows, an empty docs none.
    """
    a, b = fresh("k1", docs.columns), fresh("k2", docs.columns)
    gone = saved(contaminated(docs, benchmark).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "benchmark-hits")
    k1, k2 = _keys()
    return docs.withColumns({a: k1, b: k2}).join(gone, [a, b], "left_anti").select(*docs.columns)


def contaminated_sql() -> str:
    """doc_id, item_id, similarity and start over documents and benchmark, for DuckDB, by the same words without sketches."""
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(SHINGLE))
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents), b AS (SELECT item_id, {words} AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, i - 1 AS pos, {gram} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM d)),
bs AS (SELECT item_id, i, len(ws) - {SHINGLE - 1} AS m, {gram} AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM b)),
bc AS (SELECT item_id, m, g, count(*) AS n FROM bs GROUP BY ALL),
hit AS (SELECT doc_id, item_id, m, pos, g FROM ds JOIN bc USING (g)),
w AS (SELECT s.doc_id, s.item_id, s.m, s.pos AS start, h.g, count(*) AS n FROM hit s JOIN hit h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.pos BETWEEN s.pos AND s.pos + s.m - 1 GROUP BY ALL),
c AS (SELECT w.doc_id, w.item_id, w.m, w.start, sum(least(w.n, bc.n)) AS common FROM w JOIN bc USING (item_id, g) GROUP BY ALL),
e AS (SELECT doc_id, max(pos) AS last FROM ds GROUP BY doc_id),
s AS (SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / (least(m, last - start + 1) + m - common) AS similarity FROM c JOIN e USING (doc_id))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, (similarity, -start)) AS INT) AS start FROM s
WHERE similarity >= {SIMILAR} - 1e-9 GROUP BY doc_id, item_id"""
