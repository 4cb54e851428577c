"""Removes boilerplate lines: those that many sites share. Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: Sites from which a line counts as boilerplate; a line of few words may recur by chance, so it needs more.
SITES, SHORT_SITES, SHORT_WORDS = 5, 10, 8
#: Base-two logarithm of the sketches' buckets, and the standard errors within which an estimate is counted exactly.
LG_K, ERRORS = 10, 4


def _keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits for each distinct pair of doc_id and text, which nulls and repeated ids don't upset."""
    return [F.xxhash64(doc_id, text), F.xxhash64(text, doc_id, F.lit("key"))]


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that aren't blank: key of the document, doc_id, source, place, hash of 128 bits, needed sites."""
    k1, k2 = _keys()
    each = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("place", "line")).where("trim(line) <> ''")
    need = F.when(F.size(F.split("line", " ")) < F.lit(SHORT_WORDS), SHORT_SITES).otherwise(SITES).alias("need")
    return each.select("k1", "k2", "doc_id", "source", "place", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("line")).alias("h2"), need)


def boilerplate(docs: DataFrame) -> DataFrame:
    """The lines of docs(doc_id, text, source) that need removing: h1, h2 and first, the place of their first occurrence.

    A sketch of the sites of each line is merged while aggregating, so a line that fills a corpus costs a sketch in each
    task. Lines whose estimate is within ERRORS standard errors and one site of what they need get an exact count.
    """
    error = ERRORS * 1.04 / (1 << LG_K) ** 0.5
    least, most = F.floor(F.col("need") * (1 - error)) - 1, F.ceil(F.col("need") * (1 + error)) + 1
    lines = _lines(docs)
    spread = lines.groupBy("h1", "h2", "need").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sites"), F.min(F.struct("doc_id", "place")).alias("first"))
    spread = spread.withColumn("about", F.hll_sketch_estimate("sites")).drop("sites")
    likely = saved(spread.where(F.col("about") >= least), "line-spread")
    near = likely.where(F.col("about") <= most)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("source").alias("sites"))
    sure = likely.where(F.col("about") > most).select("h1", "h2", "first")
    return sure.union(near.join(exact, ["h1", "h2"]).where("sites >= need").select("h1", "h2", "first"))


def _cut(docs: DataFrame, removed: str) -> DataFrame:
    """docs with the text cut and the number of dropped lines in a column of a name that docs has not.

    A line that fills the corpus is one key of the join with the boilerplate, which has it once: adaptive execution splits
    such a key, and where the boilerplate is small it is broadcast.
    """
    first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("place") == F.col("first.place"))
    a, b, gone, lines = (fresh(c, [*docs.columns, removed]) for c in ("k1", "k2", "gone", "lines"))
    places = _lines(docs).join(boilerplate(docs), ["h1", "h2"]).where(~first).groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.collect_set("place").alias(gone))
    stay = F.expr(f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i]), '\\n')")
    k1, k2 = _keys()
    joined = docs.withColumns({a: k1, b: k2}).join(places, [a, b], "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(stay)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Drops from each text the boilerplate lines, but for the first occurrence of each in the corpus.

    docs has doc_id, text and source, and any other columns; all are returned, with text changed, and n_removed (lines
    dropped) is added; a column of that name is replaced, and other names don't matter. A line is boilerplate if it stands
    in texts of SITES different sources or more, in SHORT_SITES if it has fewer than SHORT_WORDS words. Lines are compared
    whole; blank ones never go. The first occurrence, by doc_id (nulls first) and place, stays, so what copies share is not
    lost with them; rows that repeat are one document in this, and are treated alike, as are rows of one doc_id with other texts
    that have the line at the same place. A null source is no site; a null text
    stays null and has no lines. A text of any length is one row and its lines are rows of their own. An empty table gives
    an empty one.
    """
    return _cut(docs.drop("n_removed"), "n_removed")


def line_dedup_filter(docs: DataFrame) -> DataFrame:
    """line_dedup() with the columns of docs: n_chars, if there, follows the text, and texts left without a line go.

    Only a text that lost lines can go: empty, blank and null ones stay as they are.
    """
    removed = fresh("n_removed", docs.columns)
    found = _cut(docs, removed)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.where((F.col(removed) == 0) | (F.trim("text") != "")).select(*docs.columns)


def line_dedup_sql() -> str:
    """doc_id, n_removed and text of documents, for DuckDB."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM d),
b AS (SELECT line, min((doc_id IS NOT NULL, coalesce(doc_id, 0), place)) AS first FROM l WHERE trim(line) <> '' GROUP BY line
  HAVING count(DISTINCT source) >= CASE WHEN len(string_split(line, ' ')) < {SHORT_WORDS} THEN {SHORT_SITES} ELSE {SITES} END),
m AS (SELECT l.*, b.line IS NOT NULL AND (l.doc_id IS NOT NULL, coalesce(l.doc_id, 0), l.place) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text FROM m GROUP BY r)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN k.text ELSE d.text END AS text FROM d LEFT JOIN k USING (r)"""
