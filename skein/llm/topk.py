"""Exact top-k search by an impact-ordered index that is read a score at a time.

A block of vectors is indexed by dimension: the components are quantised to LEVELS levels, and the rows of one level are
a posting segment. For a query, what a segment adds to a row's score, over the least that the dimension can add, is its
impact. Segments are taken in descending order of impact, and each adds its impact's lower bound to its rows. At any time
a row's score lies between its sum and its sum plus a bound, the slack of the levels read and the largest impacts not
read. Reading stops when that bound proves that all but a few rows are below the k-th best sum; those few, which may be
members, are then scored exactly. Where no proof comes, all segments are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import tiles
from skein.operators import tiling
from skein.tables import written

LEVELS = 128
#: Impacts down to these shares of the largest are read before the bounds are looked at again.
SHARES = (0.25, 1 / 16, 1 / 64, 1 / 128, 1 / 256, 0.0)


class ImpactIndex:
    """The posting segments of a block of vectors (rows of an int64 matrix)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, self.width = vectors.shape
        self.low = vectors.min(axis=0)
        self.step = (vectors.max(axis=0) - self.low) // LEVELS + 1
        level = ((vectors - self.low) // self.step).T
        self.top = level.max(axis=1)
        self.rows = np.argsort(level, axis=1, kind="stable")  # of each dimension: rows in ascending order of level
        self.level = np.take_along_axis(level, self.rows, axis=1)
        self.first = np.stack([np.searchsorted(x, np.arange(LEVELS + 2)) for x in self.level])  # where each level begins
        self.all = np.arange(n)

    def possible(self, query: np.ndarray, k: int, own: int) -> np.ndarray:
        """Rows that may be among the k best for the query; row `own` (-1 if none) is not. All others are proven not to be."""
        n = len(self.vectors)
        wanted = k + (own >= 0)
        if n <= max(64, 4 * wanted):
            return self.all[self.all != own]
        size = np.abs(query)
        dims = np.flatnonzero(size)
        unit, top, up = size * self.step, self.top, query > 0  # unit: a level's impact
        largest = int((unit * top).max())
        begin = np.where(up, n, 0)  # postings from here on (up), or up to here (down), have been read
        sums = np.zeros(n, np.int64)
        for share in SHARES:
            floor = int(largest * share)
            until = np.minimum(top, floor // np.maximum(1, unit)) if floor else np.full(self.width, -1)  # levels of impact above the floor come next
            edge = np.where(up, np.take_along_axis(self.first, (until + 1)[:, None], 1)[:, 0], np.take_along_axis(self.first, (top - until)[:, None], 1)[:, 0])
            for d in dims.tolist():
                a, b = (edge[d], begin[d]) if up[d] else (begin[d], edge[d])
                if a < b:
                    impact = self.level[d, a:b] if up[d] else top[d] - self.level[d, a:b]
                    sums[self.rows[d, a:b]] += impact * unit[d]
            begin = edge
            bound = int((np.maximum(0, until) * unit + size * (self.step - 1)).sum())
            if floor and bound > int(sums.max()) - int(sums.mean()):
                continue  # no proof in sight
            least = int(np.partition(sums, n - wanted)[n - wanted])
            few = np.flatnonzero(sums >= least - bound)
            if not floor or len(few) <= max(4 * wanted, n // 64):
                return few[few != own]
        raise AssertionError("the last share is zero")

    def best(self, query: np.ndarray, k: int, own: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best for a query; ids are in ascending order."""
        some = self.possible(query, k, own)
        scores = self.vectors[some] @ query
        first = tiles.best_first(scores, ids[some], k)
        return some[first], scores[first]


def _in_tile(k: int):
    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        queries, vectors = tiles.matrices(asked["v"], block["v"])
        names, ids = asked["vec_id"].to_numpy(), block["vec_id"].to_numpy()
        own = np.searchsorted(ids, names)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == names), own, -1)
        found = []
        if vectors.dtype == np.int64:
            index = ImpactIndex(vectors)
            found = [index.best(q, k, o, ids) for q, o in zip(queries, own.tolist(), strict=True)]
        else:  # numbers too large for the index's sums: all rows are possible members
            for q, o in zip(queries, own.tolist(), strict=True):
                rest = np.flatnonzero(np.arange(len(ids)) != o)
                scores = vectors[rest] @ q
                first = tiles.best_first(scores, ids[rest], k)
                found.append((rest[first], tiles.as_long(scores[first])))
        many = [len(rows) for rows, _ in found]
        return pa.table({"query_id": np.repeat(names, many), "vec_id": ids[np.concatenate([r for r, _ in found])], "score": np.concatenate([s for _, s in found]).astype(np.int64)})

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): of every vector whose id `every` divides, the k largest integer inner products with other rows, ties by smaller id.

    Components are floor(256 x). Rows without an id or vector, or with a null or non-finite component, take no part; of
    rows with one id, one does (tiles.whole_numbers); other columns are not read. Vectors of different length meet as if
    the shorter one ended in zeros. Equal vectors tie and are ranked by id, however many there are. An empty table, or
    one row, gives no rows. A score that no long can hold is given as the largest or smallest long.
    """
    rows = written(tiles.whole_numbers(vectors.select("vec_id", "embedding"), "vec_id", "embedding"), "whole-vectors")
    found = tiling.tiled(rows.where(F.col("vec_id") % every == 0), rows, "vec_id", _in_tile(k), "query_id long, vec_id long, score long")
    return tiles.ranked(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
