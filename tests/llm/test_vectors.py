import math

import numpy as np

import __spark_entry__
from tracequarry.llm.vectors import embedding_links, tile_links


def brute(rows, threshold=0.93):
    """rows: (vec_id, embedding, label); n_links and component by all pairs."""
    units = []
    for v, e, label in rows:
        fit = label is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)
        units.append((np.array(e) / np.linalg.norm(np.array(e))) if fit else None)
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), least, least is None or r[0] == least))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, __spark_entry__.queries()["op4_embedding_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows_and_small_tiles(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        base = rng.normal(size=6) if k % 4 == 0 else base + rng.normal(size=6) * 0.22
        rows.append((1000 - k, [float(x) for x in base], k % 3))
    rows += [(1, [0.0] * 6, 1), (2, None, 1), (3, [], 1), (4, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5, [math.nan] * 6, 1), (6, [math.inf] * 6, 1), (7, rows[0][1], None)]
    rows += [(8, rows[0][1], 0), (9, rows[0][1], 0), (9, rows[0][1], 0), (None, rows[0][1], 0), (10, rows[0][1][:5], 0), (11, [1e-300] * 6, 2), (12, [2e-300] * 6, 2), (13, [1e300] * 6, 2)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, size int")
    want = brute([r if r[0] not in (11, 12, 13) else (r[0], [1.0] * 6, r[2]) for r in rows])
    for tile in (4096, 16):
        assert sorted(map(tuple, embedding_links(frame, tile=tile).collect()), key=str) == want
    assert embedding_links(frame.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(a, b) for i, j in tile_links(x, None, 0.93) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(900) for j in range(i + 1, 900) if x[i] @ x[j] >= 0.93}
    assert len(got) > 100


def test_missing_and_repeated_ids_lose_no_link(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    for rows in (
        [(1, at(0), 0), (9, at(2), 0), (9, at(90), 0), (4, at(91), 0)],  # one id, two vectors
        [(5, at(0), 0), (None, at(15), 0), (3, at(30), 0)],  # linked through a row without id only
        [(None, at(0), 0), (None, at(0), 0), (None, at(10), 0), (None, at(170), 0), (None, at(0), None)],
        [(2, at(0), 0), (2, at(0), 0), (2, at(0), 1), (1, at(0), 1), (7, at(1), 0)],
    ):
        frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")
        for tile in (4096, 1):
            assert sorted(map(tuple, embedding_links(frame, tile=tile).collect()), key=str) == brute(rows)
