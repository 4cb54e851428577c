import random
import re
from collections import Counter

import __spark_entry__
from tracequarry.llm.decontam import contaminated, decontaminate


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain(docs, items):
    """Best window of each document and item over all windows that start with a shingle of the item, by brute force."""
    found = {}
    for d, text in docs:
        own = grams(text)
        for item, other in items:
            bag = Counter(grams(other))
            m = sum(bag.values())
            for start in range(len(own)):
                if m and own[start] in bag:
                    part = Counter(own[start : start + m])
                    both = sum((part & bag).values())
                    value = both / (sum(part.values()) + m - both)
                    if value >= 0.8 - 1e-9:
                        found[d, item] = max(found.get((d, item), (0, 0)), (value, -start))
    return {(d, i): (round(v, 9), -s) for (d, i), (v, s) in found.items()}


def got(frame):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in frame.collect()}


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs, items)
    assert want and got(__spark_entry__.queries()["op9_decontamination"](spark, sf)) == want


def test_edited_passages_and_odd_rows(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(k, say(15 + 3 * k)) for k in range(15)] + [(20, None), (21, ""), (22, "only four words here"), (23, "a b " * 12), (24, say(400))]
    docs = [(100 + k, f"{say(30)} {t}, {say(20)}") for k, t in items[:15]]
    docs += [(200 + k, f"{say(9)}\n{t.upper().replace(' ', '.  ')}") for k, t in items[:15]]
    for k, t in [*items[:15], items[-1]]:
        words = t.split()
        words[len(words) // 2] = "changed"
        docs += [(300 + k, f"{say(40)} {' '.join(words)} {say(3)}"), (400 + k, f"{say(4)} {' '.join(words[1:])}"), (500 + k, f"{' '.join(t.split()[: len(words) // 2])} {say(60)}")]
    docs += [(1, None), (2, ""), (3, "four words are here"), (4, "b a " * 9), (5, f"{say(60_000)} {items[3][1]}"), (6, items[2][1]), (6, items[2][1]), (None, items[4][1]), (7, f"{items[5][1]} {items[5][1]}")]
    frame = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, m int, start int")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, fp int")
    want = plain(docs, items)
    assert got(contaminated(frame, bench)) == want
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if not any((d, i) in want for i, _ in items))
    assert contaminated(frame.limit(0), bench).count() == 0 and decontaminate(frame, bench.limit(0)).count() == len(docs)


def test_items_cut_at_the_end(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate((60, 104, 24, 40))]
    docs = [(10 * k + j, " ".join(say(9) * before + words[: len(words) * share // 1000])) for k, words in items for j, (before, share) in enumerate([(0, 870), (1, 870), (0, 840), (1, 840), (0, 700), (1, 1000)])]
    items = [(k, " ".join(words)) for k, words in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert {0, 1, 10, 11, 20, 21} <= {d for d, _ in want}
    assert got(contaminated(frame, bench)) == want


def test_recall_of_edited_items(spark):
    """Random items, also repetitive ones, edited and cut by the start or end of a text, near the least similarity."""
    rng = random.Random(12)
    say = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    items = [(k, say(rng.randrange(5, 80), rng.choice((12, 5000)))) for k in range(60)]
    docs = []
    for k in range(1600):
        item, words = rng.choice(items)
        words = list(words)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        cut = rng.randrange(max(1, len(words) // 6))
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        docs.append((k, " ".join(say(rng.choice((0, 7)), 9999) + words + say(rng.choice((0, 0, 9)), 9999))))
    items = [(k, " ".join(words)) for k, words in items]
    want = plain(docs, items)
    found = got(contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")))
    print(f"recall {len(want.keys() & found.keys())} of {len(want)}")
    assert len(want) > 600 and found == want


def test_clashing_columns_and_null_ids(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, item, 77, 5, "x"), (1, "another text of some few words", 78, 6, "y"), (None, item, 79, 7, "z"), (2, None, 80, 8, "z"), (2, None, 80, 8, "z"), (3, f"{item} " * 900, 81, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 long, K2 int, item_id string")
    kept = decontaminate(docs, spark.createDataFrame([(9, item, 1)], "item_id long, text string, k1 int"))
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_a_common_phrase_brings_nobody_together(spark, monkeypatch):
    """500 texts and 300 items that share a phrase and nothing else; one text repeats an item."""
    from tracequarry.llm import decontam

    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase = "which of the following is true about"
    items = [(k, f"{phrase} {say(30)}") for k in range(300)]
    docs = [(k, f"{say(20)} {phrase} {say(40)}") for k in range(500)] + [(999, f"{say(9)} {items[7][1]}")]
    met = []
    original = decontam.saved
    monkeypatch.setattr(decontam, "saved", lambda frame, name: met.append((name, original(frame, name))) or met[-1][1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = got(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench))
    assert set(found) == {(999, 7)}
    stored = dict(met)
    # the phrase is no item's probe, so the one text that repeats an item is the only one that meets any
    assert stored["benchmark-met"].selectExpr("sum(size(of))").first()[0] == 1
    probes = stored["benchmark-probes"]
    assert probes.groupBy("h").count().where("count > 1").count() == 0 and probes.groupBy("item_id").count().count() == 300


def test_probes_of_repetitive_items(spark):
    """Every similar window holds as many probes as are asked for: items of few shingles, that all items have, are found."""
    items = [(1, "a b c d e " * 8), (2, "a b c d e " * 7 + "f g"), (3, "a b c d e f g h i j k l"), (4, "a b c d e")]
    docs = [(10 + k, f"x y z {t} z y x") for k, t in items] + [(20, "a b c d e " * 40), (21, "b c d e f g h i j k l m"), (22, "a b c d x")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(contaminated(frame, bench)) == plain(docs, items)
