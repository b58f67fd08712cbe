"""Hard negatives: integer inner products of anchors and candidates by Strassen's recursion, kept in small mergeable heaps.

Two passes over the tiles of anchors and candidates. The first keeps, of each anchor, the best rows of its own label (the
positives); heaps of different tiles merge into one. The second knows the positives' scores, and with them the window of
scores in which a negative of each may lie, and keeps the best rows of other labels in each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import tiles
from skein.operators import tiling
from skein.tables import written

#: Products with a side of this length or less are not divided further.
LEAF = 16
#: Anchors that are multiplied at a time, so that a tile's scores stay small.
ANCHORS = 256


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices by seven products of halves, recursively; odd sides get a row or column of zeros.

    Sums that pass beyond int64 wrap around, which changes no result that itself fits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    out = np.empty((m, n), a.dtype)
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[:i, :l] = p1 + p4 - p5 + strassen(a12 - a22, b21 + b22)
    out[i:, l:] = p1 - p2 + p3 + strassen(a21 - a11, b11 + b12)
    return out


def window(positive: int) -> tuple[int, int]:
    """The least and largest whole score s with 50 * positive <= 100 * s <= 95 * positive; empty if the first is larger."""
    return -(-positive // 2), 19 * positive // 20


def _products(asked: pa.Table, block: pa.Table):
    """Of a block of candidates, in order of id: each anchor's place in asked, and the scores of all candidates."""
    anchors, vectors = tiles.matrices(asked["v"], block["v"])
    across = np.ascontiguousarray(vectors.T)
    for at in range(0, len(anchors), ANCHORS):
        yield from enumerate(strassen(anchors[at : at + ANCHORS], across), at)


def _positives(most: int):
    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        names, kinds = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
        ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
        of_kind = {kind: np.flatnonzero(labels == kind) for kind in set(kinds.tolist())}
        out = []
        for k, scores in _products(asked, block):
            same = of_kind[kinds[k]]
            same = same[ids[same] != names[k]]
            heap = same[tiles.best_first(scores[same], ids[same], most)]
            out.append((np.full(len(heap), names[k]), ids[heap], tiles.as_long(scores[heap])))
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _negatives(most: int):
    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        names, kinds, positives = asked["vec_id"].to_numpy(), asked["label"].to_numpy(), asked["positives"].to_pylist()
        ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
        other = {kind: np.flatnonzero(labels != kind) for kind in set(kinds.tolist())}
        out = [[] for _ in range(5)]
        for k, scores in _products(asked, block):
            windows = [(p, *window(p["positive_score"])) for p in positives[k]]
            low, high = min(w[1] for w in windows), max(w[2] for w in windows)
            rest = other[kinds[k]]
            own = scores[rest]
            some = np.flatnonzero((own >= low) & (own <= high))
            some = some[np.argsort(-own[some], kind="stable")]  # best first; ids ascend in ties
            falling = -own[some]
            for p, least, largest in windows:
                a, b = np.searchsorted(falling, -largest, side="left"), np.searchsorted(falling, -least, side="right")
                heap = some[a : min(b, a + most)] if a < b else some[:0]
                for column, values in zip(out, ([names[k]] * len(heap), [p["positive_id"]] * len(heap), ids[rest[heap]].tolist(), [p["positive_score"]] * len(heap), tiles.as_long(own[heap]).tolist()), strict=True):
                    column.extend(values)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out, strict=True)})

    return run


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor (an id that `every` divides) and each of its best rows of the same label, the best rows of other labels whose score lies between half and 0.95 of the positive's.

    Components are floor(256 x); scores are integer inner products, ties by smaller id. Rows without an id, label or
    vector, or with a null or non-finite component, take no part; of rows with one id, one does (tiles.whole_numbers);
    other columns are not read. Anchors without another row of their label, and positives with an empty window (those of
    a negative score), give no rows, and so does an empty table. A label may hold any share of the rows: tiles are cut by
    id. A score that no long can hold is given as the largest or smallest long.
    """
    known = vectors.where(F.col("label").isNotNull()).select("vec_id", "embedding", "label")
    rows = written(tiles.whole_numbers(known, "vec_id", "embedding", "label").withColumn("label", F.col("label").cast("long")), "whole-labelled")
    anchors = rows.where(F.col("vec_id") % every == 0)
    near = tiling.tiled(anchors, rows, "vec_id", _positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = tiles.ranked(near, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], positives)
    paired = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asked = written(anchors.join(paired, "vec_id"), "anchors")
    hard = tiling.tiled(asked, rows, "vec_id", _negatives(negatives), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = tiles.ranked(hard, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
