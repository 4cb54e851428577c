from collections import defaultdict

import duckdb
import pandas as pd

import __spark_entry__
from tracequarry.llm.lines import SHORT_SITES, SHORT_WORDS, SITES, line_dedup, line_dedup_filter, line_dedup_sql


def plain(rows):
    """rows: (doc_id, text, source); text and lines removed."""
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line] |= {s} - {None}
                at = ((d is not None, d or 0), k)
                first[line] = min(first.get(line, at), at)
    out = []
    for d, t, _ in rows:
        kept, n = [], 0
        for k, line in enumerate((t or "").split("\n")):
            need = SHORT_SITES if len(line.split(" ")) < SHORT_WORDS else SITES
            if line.strip(" ") and len(sites[line]) >= need and first[line] != ((d is not None, d or 0), k):
                n += 1
            else:
                kept.append(line)
        out.append(str((d, n, None if t is None else "\n".join(kept))))
    return sorted(out)


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = __spark_entry__.queries()["op3_line_dedup"](spark, sf).select("doc_id", "n_removed", "text").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine"
    rows = [(k, f"own {k}\n{long}\n\nshort line\n \n{long} end {k % 6}", f"s{k}") for k in range(SHORT_SITES)]
    rows += [(50 + k, f"{long} four sites", f"s{k}") for k in range(SITES - 1)] + [(60, f"{long} four sites", None)]
    rows += [(None, long, "s1"), (None, None, "s2"), (71, "", "s3"), (71, f"{long}\n{long}", None), (3, rows[3][1], "s3"), (72, f"x\n{long}\n" * 20_000, "s1")]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8) for r in rows], "doc_id long, text string, source string, n_chars int, line int, h1 int")
    got = line_dedup(frame)
    assert got.columns == [*frame.columns, "n_removed"]
    assert sorted(str((r.doc_id, r.n_removed, r.text)) for r in got.collect()) == plain(rows)
    left = line_dedup_filter(frame)
    assert left.schema == frame.schema
    assert all(r.n_chars == len(r.text or "") for r in left.collect())
    assert left.where("doc_id = 71").count() == 1
    assert line_dedup(frame.limit(0)).count() == 0
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})  # noqa: F841
    assert sorted(map(str, duckdb.sql(f"SELECT doc_id, n_removed, text FROM ({line_dedup_sql()})").fetchall())) == plain(rows)


def test_clashing_columns(spark):
    long = "one two three four five six seven eight nine"
    rows = [(k, f"own {k}\n{long}", f"s{k}", k, -k, [k], "x") for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int, k1 long, gone array<long>, lines string")
    left = line_dedup_filter(frame)
    assert left.schema == frame.schema
    assert sorted(map(tuple, left.collect())) == sorted((d, t if d == 0 else f"own {d}", *r) for d, t, *r in rows)
    assert {(r.doc_id, r.n_removed, r.k1, r.lines) for r in line_dedup(frame).collect()} == {(k, int(k > 0), -k, "x") for k in range(8)}
