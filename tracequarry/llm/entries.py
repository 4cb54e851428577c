"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digest_sql, digests, format_parts
from .common import table
from .decontam import contaminated, contaminated_sql
from .language import languages
from .lines import line_dedup, line_dedup_sql
from .ngrams import lm_scores
from .phrases import collocations, collocations_sql
from .pieces import encoded, read_model
from .quality import quality_scores
from .runs import periodic_runs
from .secret_scan import secret_spans
from .simhash import simhash_groups
from .urls import url_verdicts, verdict_sql
from .vectors import embedding_links


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_verdicts(table(spark, sf_dir, "pages")).drop("score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    sure = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", sure), (-7, 1, "assistant", sure)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_parts(turns.union(added)), gathered=True)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and decision for every document."""
    return quality_scores(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without boilerplate lines."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents repeat."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return encoded(table(spark, sf_dir, "documents"), read_model(spark))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where every tenth text, by the crc32 of its doc_id, goes round in a few words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # the words are bound once, as the one element of an array
    planted = F.expr("""transform(array(words), w -> if(size(w) = 0, '', array_join(transform(sequence(0, size(w) - 1), i -> w[CAST(
        if(i < g % size(w), i, g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8))) AS int)]), ' ')))[0]""")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    return split.select("doc_id", F.when(F.col("words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document, and of its text without their repetitions."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    found = languages(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_lm_score": op7_lm_score,
    "op8_chat_format": op8_chat_format,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": line_dedup_sql(),
    "op6_url_filter": verdict_sql(),
    "op8_chat_format": digest_sql(),
    "op9_decontamination": contaminated_sql(),
    "op11_collocations": collocations_sql(),
}
