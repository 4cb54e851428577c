"""Secrets in texts: fixed patterns, and tokens that a character model of random strings explains better than words.

Everything here is Spark SQL expressions; there is no Python on the executors.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that the contract of the scan names.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Tokens that the models judge, and the characters that they hold.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio per character pair (natural logarithm) from which a token is a secret.
THRESHOLD = 0.3
#: Spans whose places are summed in one go, so that many spans take time in proportion.
BLOCK = 256

#: Labelled samples of ordinary identifiers.
ORDINARY = """
    get_user_name set_current_value compute_average_latency parse_configuration_file read_next_record write_output_buffer
    max_connection_count default_timeout_seconds is_feature_enabled last_modified_timestamp number_of_partitions
    customer_account_balance total_order_amount shipping_address_line monthly_revenue_report background_worker_thread
    getElementById addEventListener createDocumentFragment removeAttributeNode isInstanceOfClass toLowerCaseString
    AbstractConnectionFactory ApplicationContextInitializer HttpServletRequestWrapper ConcurrentHashMapIterator
    IllegalArgumentException UnsupportedOperationException ResourceNotFoundException DatabaseMigrationHandler
    application-server-production continuous-integration-pipeline documentation-generator-plugin feature-branch-review
    usr/local/share/applications home/projects/source/components var/log/nginx/access-archive node_modules/package/dist
    internationalization characteristically counterproductive misunderstanding responsibilities straightforward
    unbelievable transformation infrastructure representation acknowledgement administration environmental
    Geschwindigkeitsbegrenzung Verantwortungsbewusstsein Zusammenarbeit Wissenschaftler Bundesregierung
    anticonstitutionnellement developpement gouvernement independamment responsabilidad desafortunadamente administracion
    MAX_BUFFER_SIZE DEFAULT_CHARSET_NAME ENABLE_DEBUG_LOGGING HTTP_STATUS_NOT_FOUND ENVIRONMENT_VARIABLE_PREFIX
    version_2_release_candidate chapter-12-section-3 report-2024-01-15-final backup_2023_10_31_daily page-10-of-25
    ======================== ------------------------ ________________________ ++++++++++++++++++++++++
""".split()


def random_samples(n: int = 160) -> list[str]:
    """Labelled samples of random strings: hexadecimal, base 64, and letters with digits, from a hash of a counter."""
    found = []
    for k in range(n):
        raw = b"".join(hashlib.sha256(f"sample {k} {j}".encode()).digest() for j in range(2))
        chosen = (ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64])[k % 4]
        found.append(hashlib.sha256(raw).hexdigest()[:40] if k % 5 == 0 else "".join(chosen[x % len(chosen)] for x in raw[:40]))
    return found


def transitions(samples: list[str], add: float = 0.05) -> list[list[float]]:
    """Log probability of each character after each other one, smoothed by what each character has overall."""
    pairs = Counter(p for s in samples for p in pairwise(s))
    after, single = Counter(), Counter(c for s in samples for c in s)
    for (a, _), n in pairs.items():
        after[a] += n
    total = sum(single.values()) + len(ALPHABET)
    share = {c: (single[c] + 1) / total for c in ALPHABET}
    weight = add * len(ALPHABET)
    return [[math.log((pairs[a, b] + weight * share[b]) / (after[a] + weight)) for b in ALPHABET] for a in ALPHABET]


def ratios(ordinary: list[str], secret: list[str]) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary, row by row."""
    low, high = transitions(ordinary), transitions(secret)
    return [round(h - o, 6) for ho, oo in zip(high, low, strict=True) for h, o in zip(ho, oo, strict=True)]



#: Start and end of each hit, from arrays hits and gaps: sums within blocks, then of blocks. {hits}, {gaps}, {block}
_SPANS = """
IF(size({hits}) = 0, array(), flatten(zip_with(
  transform(sequence(0, size({hits}) - 1, {block}), b -> aggregate(
    zip_with(slice({gaps}, b + 1, {block}), slice({hits}, b + 1, {block}), (g, h) -> named_struct('g', g, 'h', h)),
    named_struct('at', 0, 'got', CAST(array() AS array<struct<s:int,e:int>>)),
    (acc, x) -> IF(x.h IS NULL, acc, named_struct('at', acc.at + length(x.g) + length(x.h),
      'got', concat(acc.got, array(named_struct('s', acc.at + length(x.g), 'e', acc.at + length(x.g) + length(x.h)))))),
    acc -> acc.got)),
  aggregate(sequence(0, size({hits}) - 1, {block}), named_struct('at', 0, 'got', CAST(array() AS array<int>)),
    (acc, b) -> named_struct(
      'at', acc.at + length(array_join(slice({gaps}, b + 1, {block}), '')) + length(array_join(slice({hits}, b + 1, {block}), '')),
      'got', concat(acc.got, array(acc.at))),
    acc -> acc.got),
  (part, at) -> transform(part, x -> named_struct('s', x.s + at, 'e', x.e + at)))))
"""


def _spans(hits: str, gaps: str) -> str:
    return _SPANS.format(hits=hits, gaps=gaps, block=BLOCK)


#: Mean ratio of a token {x}, looked up in the array {w}.
_SCORE = """
aggregate(sequence(1, length({x}) - 1), 0D, (acc, i) -> acc + {w}[
  (locate(substring({x}, i, 1), '{abc}') - 1) * {n} + locate(substring({x}, i + 1, 1), '{abc}') - 1]) / (length({x}) - 1)
"""


#: Sorted {spans} without those of the last kind that lie in one of another kind: such a one ends after it, and begins
#: before it or with it, so the furthest end so far tells. Ends of blocks come first, so the time is in proportion.
_FREE = """
transform(array({spans}), a -> transform(array(transform(sequence(0, greatest(size(a) - 1, 0), {block}), b -> slice(a, b + 1, {block}))), parts ->
  flatten(zip_with(parts,
    aggregate(parts, named_struct('top', 0, 'got', CAST(array() AS array<int>)),
      (acc, p) -> named_struct('top', greatest(acc.top, coalesce(array_max(transform(p, x -> IF(x.k < 3, x.e, 0))), 0)), 'got', concat(acc.got, array(acc.top))),
      acc -> acc.got),
    (p, top) -> aggregate(p, named_struct('top', top, 'got', slice(p, 1, 0)),
      (acc, x) -> named_struct('top', IF(x.k < 3, greatest(acc.top, x.e), acc.top), 'got', IF(x.k = 3 AND acc.top >= x.e, acc.got, concat(acc.got, array(x)))),
      acc -> acc.got))))[0])[0]
"""


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD, ordinary: list[str] = ORDINARY, secret: list[str] | None = None) -> DataFrame:
    """Finds secrets in every whole text of docs(doc_id, text); one row for each row, other columns are ignored.

    Returns doc_id; n_assign, n_access and n_hex; base_sha256 over the spans of those three kinds; and spans, which adds
    the tokens of 20 or more characters that the character models take for random (kind markov) and that lie in no other
    span. A span is kind:start:end in code points, end exclusive, of the whole match; spans are sorted by start, then
    kind as listed, and joined by commas. A null text counts as empty; without a span the string is empty.

    Within a kind, matches are leftmost and don't overlap, and those too short are dropped afterwards. The patterns of
    one character class ask for the length at once, which gives the same spans: the run that a match takes is maximal.
    Rows without doc_id and repeated rows have a row each, and an empty table gives an empty one. A text of any length is
    scanned whole; the work is in proportion to it and to its spans.
    """
    table = ",".join(map(str, ratios(ordinary, random_samples() if secret is None else secret)))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    kinds = {"assign": ASSIGN, "access": ACCESS.replace("+", "{16,}"), "hex": HEX.replace("+", "{24,}"), "markov": TOKEN}
    hits = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_hits") for k, p in kinds.items()}
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("values")
    found = found.select("doc_id", "text", *hits.values(), values)
    gaps = [F.when(F.size(f"{k}_hits") > 0, F.split("text", p, -1)).alias(f"{k}_gaps") for k, p in kinds.items()]
    found = found.select("doc_id", "values", *[f"{k}_hits" for k in kinds], *gaps)
    placed = [F.expr(_spans(f"{k}_hits", f"{k}_gaps")).alias(k) for k in kinds]
    score = _SCORE.format(x="x", w=f"CAST(split('{table}', ',') AS array<double>)", abc=ALPHABET, n=len(ALPHABET))
    random = F.expr(f"transform(markov_hits, x -> {score} >= {threshold})").alias("random")
    found = found.select("doc_id", "values", random, *placed)
    found = found.withColumns(
        {
            "assign": F.expr("transform(filter(arrays_zip(assign, values), x -> length(x.values) >= 6), x -> x.assign)"),
            "markov": F.expr("transform(filter(arrays_zip(markov, random), x -> x.random), x -> x.markov)"),
        }
    )
    named = "transform({k}, x -> named_struct('s', x.s, 'k', {rank}, 'e', x.e, 'name', concat('{k}:', x.s, ':', x.e)))"
    base = F.expr(f"array_sort(concat({', '.join(named.format(k=k, rank=i) for i, k in enumerate(('assign', 'access', 'hex')))}))")
    found = found.select("doc_id", "markov", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], base.alias("base"))
    every = F.expr(_FREE.format(spans=f"array_sort(concat(base, {named.format(k='markov', rank=3)}))", block=BLOCK))
    joined = "array_join(transform({a}, x -> x.name), ',')"
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.expr(joined.format(a="base")), 256).alias("base_sha256"), F.array_join(F.transform(every, lambda x: x["name"]), ",").alias("spans")
    )
