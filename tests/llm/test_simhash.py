import re

import pytest
import xxhash

import __spark_entry__
from tracequarry.llm.components import components
from tracequarry.llm.simhash import fingerprint, simhash_groups

SCHEMA = "doc_id long, text string, fp string"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def plain_groups(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, __spark_entry__.queries()["op5_simhash_dedup"](spark, sf).collect()), key=str)
    assert got == plain_groups(rows)


def test_odd_rows(spark):
    rows = [(3, None), (2, ""), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (4, "One"), (5, "oNE"), (6, "Ünï ÜNÏ"), (7, "x " * 70000), (None, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()), key=str)
    assert got == plain_groups(rows)
    assert simhash_groups(docs.limit(0)).count() == 0


def near_texts(n=4000):
    """A chain of texts whose neighbours' fingerprints are one or two bits apart, and two far texts."""
    base = [f"w{k}" for k in range(n)]
    made, prints = [" ".join(base)], [plain_print(" ".join(base))]
    for k in range(n):
        words = made[-1].split()
        words[k] = "other"
        text = " ".join(words)
        if 0 < (plain_print(text) ^ prints[-1]).bit_count() <= 2 and all((plain_print(text) ^ p).bit_count() > 2 for p in prints[:-1]):
            made.append(text)
            prints.append(plain_print(text))
            if len(made) == 4:
                return made
    raise AssertionError("no chain")


def test_missing_and_repeated_ids_lose_no_link(spark):
    a, b, c, d = near_texts()
    for rows in (
        [(5, a), (None, b)],  # linked to a row without id
        [(9, a), (None, b), (7, c)],  # linked through it only
        [(1, a), (3, b), (3, "quite another text that stands alone")],  # one id, two texts
        [(3, "this text is alone"), (3, "that text is too"), (4, d), (3, c), (None, "nothing here at all")],
        [(2, a), (2, a), (2, a), (8, b), (8, b)],
    ):
        docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()), key=str)
        assert got == plain_groups(rows)


def test_chunks_make_no_difference():
    text = " ".join(f"w{i % 977} v{i % 31}" for i in range(40_000))
    assert fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(6, 60)] + [(3, 59), (100, 101)]])
def test_components(spark, edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in root}
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {r.node: r.component for r in got.collect()} == want
