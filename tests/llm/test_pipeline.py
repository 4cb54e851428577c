import random
import sys
from collections import Counter

import sentencepiece

import __spark_entry__
import corpus_pipeline
from tracequarry.llm.pieces import MODEL
from tracequarry.llm.quality import quality_scores

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_decontam import plain as leaks  # noqa: E402
from test_lines import plain as without_lines  # noqa: E402
from test_near import grams, similar  # noqa: E402


def near_groups(rows):
    """The least doc_id of each document's group, by all pairs of five-word sets."""
    sets, least = {d: grams(t) for d, t in rows.items()}, {}
    for d in sorted(sets):
        if d not in least:
            least[d], todo = d, [d]
            while todo:
                a = todo.pop()
                new = [b for b in sets if b not in least and similar(sets[a], sets[b])]
                least.update(dict.fromkeys(new, d))
                todo += new
    return least


def test_run_against_brute_force(spark):
    """Each stage but the first by a plain version of itself, over what the plain stages before it leave."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = {r.doc_id: rows[r.doc_id] for r in quality_scores(docs).collect() if r.kept}
    cut = [eval(x) for x in without_lines([(d, t, s) for d, (t, s) in rows.items()])]  # noqa: S307
    rows = {d: t for d, n, t in cut if not n or t.strip(" ")}
    component = near_groups(rows)
    rows = {d: t for d, t in rows.items() if component[d] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    gone = {d for d, _ in leaks(list(rows.items()), items)}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {d: (t, library.encode(t or "")) for d, t in rows.items() if d not in gone}
    got = __spark_entry__.queries()["pipeline"](spark, sf)
    assert got.columns == [*docs.columns, "ids"]
    assert {r.doc_id: (r.text, r.ids) for r in got.collect()} == want
    assert gone and len(want) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)) + "."
    rows = [(k, f"{say(60)}\n{say(20)}", "en", f"src{k % 9}", 0) for k in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "src1", 0), (None, say(70), None, "src2", 1), (3, rows[3][1], "en", "src3", 0), (52, rows[4][1], "fr", None, 7)]
    rows += [(60, say(120_000), "en", "src1", 0), (61, "w " * 300_000, "en", "src2", 0), (62, say(90), "en", "src3", 0)]
    docs = spark.createDataFrame([(*r, 5, "x", 7, b"y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed int, k1 string, K2 long, whole binary").repartition(3)
    sf = "/root/testdata/sf0.001"
    for frame in (docs, docs.limit(0)):
        before = Counter(r.doc_id for r in frame.collect())
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
            after = Counter(r.doc_id for r in frame.collect())
            assert frame.columns == [*docs.columns, *["ids"] * (name == "token_ids")] and after <= before
            before = after
    assert len(corpus_pipeline.STAGES) == 5
