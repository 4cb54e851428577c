"""Near-duplicate embeddings: int8 tile products with error bounds, exact recomputation of what may pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

#: Vectors of a tile, rows of a tile product held at a time, and pairs recomputed at a time.
TILE, ROWS, PAIRS = 4096, 512, 1 << 16
#: What rounding in double precision may add to a bound.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes (held as floats) of unit vectors, their scales, the codes' lengths and the lengths of what is lost."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return codes.astype(exact), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs (i, j) of unit vectors with x[i].y[j] >= threshold, in portions; y None: pairs i < j within x.

    With x = X + e and y = Y + f, where X and Y are the dequantised codes, |x.y - X.Y| <= |X||f| + |e||y|, and |y| = 1.
    Only pairs whose X.Y plus that bound reaches the threshold are multiplied again in double precision.
    """
    own, y = y is None, x if y is None else y
    qx, sx, ax, ex = quantised(x)
    qy, sy, _, ey = quantised(y) if not own else (qx, sx, ax, ex)
    for at in range(0, len(x), ROWS):
        rows = slice(at, at + ROWS)
        most = (qx[rows] @ qy.T) * sx[rows, None] * sy[None, :] + ax[rows, None] * ey[None, :] + (ex[rows] + SLACK)[:, None]
        i, j = np.nonzero(most >= threshold)
        i += at
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            hit = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            yield p[hit], q[hit]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after the links (a, b); label[i] is an index not above i."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def _tile_pair(threshold: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        own = key[2].as_py() == key[3].as_py()
        side = group["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        n_left = int((side == 0).sum())
        flat = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(side), -1)[order]
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        node, size = (group[c].to_numpy()[order] for c in ("node", "size"))
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for i, j in tile_links(x[:n_left], None if own else x[n_left:], threshold):
            j = j if own else j + n_left
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            label = _joined(label, i, j)
        hit = links > 0
        return pa.table({"node": node[hit], "links": links[hit], "root": node[label[hit]]})

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """Links vectors of equal label whose cosine, in double precision, is at least the threshold.

    vectors: vec_id, embedding (array of float or double), label; other columns are ignored. Returns vec_id, n_links
    (other rows linked directly), component_id (least vec_id reachable) and kept (vec_id = component_id), one row for
    each row; an empty table gives an empty one. A row without label, or with a null, empty, zero, null-holding or
    non-finite vector links with nothing; vectors of different lengths don't link. Rows that share a vec_id are rows of
    their own. Rows without vec_id link like any other but never name a component; one that reaches no vec_id has a null
    component_id and is kept.

    Equal vectors fall together first: each distinct one is a node. The rest of a label is dealt to tiles by hash; each
    pair of tiles is one group, which returns its nodes' link counts and a spanning forest of its links, never the pairs.
    The contract compares all vectors of a label, so the work is a label's square; memory is two tiles.
    """
    base = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = base.where(fit).withColumns({"dim": F.size("embedding"), "key": F.xxhash64("label", "embedding"), "twin": F.xxhash64(F.reverse("embedding"), "label", F.lit("twin"))})
    classes = keyed.groupBy("key", "twin", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = saved(classes, "vector-classes")
    # a class is the node of its least vec_id, or of its hash where another class has that vec_id or none is known
    shared = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.lit(True).alias("shared"))
    nodes = classes.drop("embedding").join(shared, "rep", "left").withColumn("node", F.expr("IF(rep IS NULL OR shared, key, rep)")).drop("shared")
    nodes = saved(nodes, "vector-nodes")
    tiles = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.select("key", "twin", "embedding").join(nodes, ["key", "twin"]).join(tiles, ["label", "dim"]).withColumn("mine", F.expr("CAST(pmod(twin, tiles) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("label", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.expr("int(mine > other)").alias("side"), "node", "size", "embedding")
    found = saved(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_tile_pair(threshold), "node long, links long, root long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    least = linked.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    names = linked.join(least, "component").select("node", "least", F.lit(True).alias("is_linked"))
    named = nodes.join(counts, "node", "left").join(names, "node", "left")
    named = named.select("key", "twin", F.expr("size - 1 + coalesce(links, 0)").alias("n_links"), F.expr("IF(is_linked, least, rep)").alias("component_id"))
    inside = keyed.select("vec_id", "key", "twin").join(named, ["key", "twin"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
