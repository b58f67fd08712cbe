"""Benchmark decontamination: rare n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

The corpus is scanned twice for each block of test items. The first scan counts, over all documents, how many hold each
pair of neighbouring words of the items. The rarest pairs of an item become its seeds. The second scan joins the texts'
pairs to the seeds, and aligns the surroundings of enough hits with the item word by word (match 1, mismatch and gap -1).
No alignment that counts is missed: with m matches and e errors it has at most e + 1 unbroken runs, so it keeps m - e - 1
or more of the item's pairs. Of an item of L words and a least score of T, L - T pairs at most are lost; of L - T + x
seeds, whichever they are, x are hit within the 2 L - T words over which the alignment can spread.
An item of fewer than LEAST_WORDS words counts only as a whole: a text's runs of so many words are looked up by their hash.
Items are taken in blocks of a bounded size. A block's matches are written before the next block is sent, so what is sent
to the tasks does not grow with the benchmark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SpanHash, byte_view, map_arrow, mixed, slices, words
from skein.tables import written

N = 2
#: Items of fewer words match only as they are.
LEAST_WORDS = 4
#: Share of an item's length that an alignment's score must reach.
LEAST = 0.5
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
BITMAP = 1 << 22
MATCHES = "array<struct<item_id: bigint, score: double, start_byte: int, end_byte: int>>"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start bytes and end bytes (in their row) of the words of lower-cased texts, and the rows' word ranges."""
    data, offsets = byte_view(texts)
    starts, ends, rows = words(data, offsets)
    return SpanHash(data).of(starts, ends), starts - offsets[rows], ends - offsets[rows], np.searchsorted(rows, np.arange(len(texts) + 1))


def grams(hashes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes, the place of each one's first word, and its row; none crosses rows."""
    if len(hashes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = len(hashes) - N + 1
    h = hashes[:many].copy()
    for k in range(1, N):
        h = h * np.uint64(0x100000001B3) + hashes[k : k + many]
    rows = np.searchsorted(ranges, np.arange(many), side="right") - 1
    at = np.flatnonzero(ranges[rows + 1] >= np.arange(many) + N)
    return mixed(h[at]), at, rows[at]


def runs(hashes: np.ndarray, many: int) -> np.ndarray:
    """A hash of the run of so many words that begins at each word."""
    h = hashes[: max(0, len(hashes) - many + 1)].copy()
    for k in range(1, many):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(h) + k]
    return mixed(h)


@dataclass
class Block:
    """Some test items: their words, their n-grams in hash order, and after choosing, their seeds."""

    ids: list[int]
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, dict[int, list[int]]]  # items of fewer than LEAST_WORDS words, by number of words and hash of all of them

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Block:
        hashes, _, _, ranges = word_hashes(pa.array(texts, pa.string()))
        h, at, rows = grams(hashes, ranges)
        long = np.diff(ranges)[rows] >= LEAST_WORDS
        h, at, rows = h[long], at[long], rows[long]
        order = np.argsort(h, kind="stable")
        items = [hashes[a:b] for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
        short: dict[int, dict[int, list[int]]] = {}
        for i, item in enumerate(items):
            if 0 < len(item) < LEAST_WORDS:
                short.setdefault(len(item), {}).setdefault(int(runs(item, len(item))[0]), []).append(i)
        return Block(ids, items, h[order], rows[order], (at - ranges[rows])[order], short)

    def bitmap(self) -> np.ndarray:
        out = np.zeros(BITMAP, bool)
        out[(self.hashes & np.uint64(BITMAP - 1)).astype(np.int64)] = True
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each item: its seeds, how many of them an alignment of LEAST or more hits, and how many words it spreads over at most."""
        size = np.array([len(x) for x in self.items], np.int64)
        least = np.ceil(LEAST * size).astype(np.int64)
        hit = np.maximum(1, (least - 1) // 2)
        return size - least + hit, hit, 2 * size - least

    def chosen(self, counts: np.ndarray) -> Block:
        """With each item's rarest n-grams only; counts: documents per n-gram, in hash order."""
        keep = np.lexsort((self.place, counts, self.item))
        rank = np.arange(len(keep)) - np.searchsorted(self.item[keep], self.item[keep])
        seeds = np.sort(keep[rank < self.bounds()[0][self.item[keep]]])
        return Block(self.ids, self.items, self.hashes[seeds], self.item[seeds], self.place[seeds], self.short)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps) of two word sequences: score, first and end place in text."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        row, places, top, end = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1), 0, 0
        for word in a:
            new = np.zeros(len(b) + 1, np.int64)
            new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == word, 1, -1), row[1:] - 1))
            row = np.maximum.accumulate(new + places) - places  # gaps along the text
            k = int(row.argmax())
            if row[k] > top:
                top, end = int(row[k]), k
        return top, end

    score, end = best(item, text)
    if not score:
        return 0, 0, 0
    _, length = best(item[::-1], text[:end][::-1])
    return score, end - length, end


class Search:
    """The second scan's work in one task; equal passages are aligned once."""

    def __init__(self, block: Block):
        self.block, self.bitmap, self.known = block, block.bitmap(), {}
        _, self.hit, self.spread = block.bounds()
        self.short = {many: np.array(sorted(known), np.uint64) for many, known in block.short.items()}

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        hashes, begins, stops, ranges = word_hashes(texts)
        h, at, _ = grams(hashes, ranges)
        some = np.flatnonzero(self.bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
        h, at = h[some], at[some]
        low, high = np.searchsorted(self.block.hashes, h), np.searchsorted(self.block.hashes, h, side="right")
        each = high - low
        seed = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
        item, at = self.block.item[seed], np.repeat(at, each)  # at is in row order, so it tells the row
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1])
        item, at = item[new], at[new]
        row = np.searchsorted(ranges, at, side="right") - 1
        ahead = np.arange(len(at)) + self.hit[item] - 1
        there = np.minimum(ahead, len(at) - 1)
        near = np.flatnonzero((ahead < len(at)) & (item[there] == item) & (row[there] == row) & (at[there] - at <= self.spread[item]))
        found: dict[tuple[int, int], list[int]] = {}
        for r, i, place in zip(row[near].tolist(), item[near].tolist(), at[near].tolist(), strict=True):
            found.setdefault((r, i), []).append(place)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for (row, i), places in sorted(found.items()):
            best = self._best(self.block.items[i], i, hashes, int(ranges[row]), int(ranges[row + 1]), places)
            if best and best[0] >= LEAST * len(self.block.items[i]):
                score, a, b = best
                out[row].append({"item_id": self.block.ids[i], "score": score / len(self.block.items[i]), "start_byte": int(begins[a]), "end_byte": int(stops[b - 1])})
        for many, known in self.short.items():
            h = runs(hashes, many)
            at = np.flatnonzero(np.isin(h, known))
            row = np.searchsorted(ranges, at, side="right") - 1
            at, row = (x[ranges[row + 1] >= at + many] for x in (at, row))
            firsts = np.unique(np.stack([row.astype(np.uint64), h[at]]), axis=1, return_index=True)[1] if len(at) else at
            for k in firsts.tolist():
                for i in self.block.short[many][int(h[at[k]])]:
                    out[row[k]].append({"item_id": self.block.ids[i], "score": 1.0, "start_byte": int(begins[at[k]]), "end_byte": int(stops[at[k] + many - 1])})
        return out

    def _best(self, item: np.ndarray, i: int, hashes: np.ndarray, first: int, last: int, places: list[int]) -> tuple[int, int, int] | None:
        slack, best, windows = int(self.spread[i]), None, []
        for at in places:  # hits whose surroundings overlap make one window
            a, b = max(first, at - slack), min(last, at + slack)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        for a, b in windows:
            text = hashes[a:b]
            key = (i, text.tobytes()) if b - a <= 8 * len(item) else None
            got = self.known.get(key) if key else None
            if got is None:
                got = align(item, text)
                if key:
                    if len(self.known) > 20_000:
                        self.known.clear()
                    self.known[key] = got
            if got[0] and (best is None or got[0] > best[0]):
                best = (got[0], a + got[1], a + got[2])
        return best


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("item_id is not null and text is not null").distinct()


def _numbers(benchmark: DataFrame) -> range:
    """The numbers of the blocks into which a hash of their text parts the items."""
    chars = _items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0
    return range(-(-chars // BLOCK_CHARS))


def _block(benchmark: DataFrame, k: int, many: int) -> Block:
    got = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).orderBy("item_id", "text").collect()  # about BLOCK_CHARS
    return Block.of([r["item_id"] for r in got], [r["text"] for r in got])


def _with_rare_seeds(docs: DataFrame, block: Block) -> Block:
    if not len(block.hashes):
        return block
    sent = docs.sparkSession.sparkContext.broadcast((block.hashes, block.bitmap()))

    def count(batch: pa.RecordBatch) -> dict:
        known, bitmap = sent.value
        hashes, _, _, ranges = word_hashes(batch.column("text"))
        h, _, rows = grams(hashes, ranges)
        some = np.flatnonzero(bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
        h, rows = h[some], rows[some]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        same = known[at] == h
        seen = np.unique(rows[same] * len(known) + at[same]) % len(known)
        gram, docs_with = np.unique(seen, return_counts=True)
        return {"gram": gram, "docs": docs_with}

    got = map_arrow(docs.select(F.lower("text").alias("text")), count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()  # a row for each n-gram of the block at most
    sent.destroy()
    counts = np.zeros(len(block.hashes), np.int64)
    counts[got["gram"].to_numpy(np.int64)] = got["docs"].to_numpy(np.int64)
    counts = counts[np.searchsorted(block.hashes, block.hashes)]  # equal n-grams of several items have the same count
    return block.chosen(counts)


def _leaks(docs: DataFrame, block: Block) -> Column:
    """An array of the matches of each text with the items of one block."""
    sent = docs.sparkSession.sparkContext.broadcast(_with_rare_seeds(docs, block))
    ready: list[Search] = []

    def search(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Search(sent.value))
        out = [hit for part in slices(texts) for hit in ready[0].hits(part)]
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start_byte", pa.int32()), ("end_byte", pa.int32())])))

    return F.arrow_udf(search, MATCHES)(F.lower(F.coalesce("text", F.lit(""))))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start_byte, end_byte): the best alignment of each item that a text holds with a score of LEAST or more.

    The score is the alignment's over the item's words (1: the whole item as it is); bytes are those of the lower-cased text.
    Items of fewer than LEAST_WORDS words match as they are. Null and empty texts hold nothing; items without an id, a
    text or a word are not searched; repeated rows give repeated matches; an empty benchmark gives no rows.
    """
    parts, blocks = [], list(_numbers(benchmark))
    for k in blocks:
        block = _block(benchmark, k, len(blocks))
        found = docs.select("doc_id", F.explode(_leaks(docs, block)).alias("m")).select("doc_id", "m.*")
        parts.append(found if len(blocks) == 1 else written(found, "leaks"))
    if not parts:
        return docs.select("doc_id", F.explode(F.from_json(F.lit("[]"), MATCHES)).alias("m")).select("doc_id", "m.*")
    return reduce(DataFrame.unionByName, parts)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, whose text holds no benchmark item (see matches)."""
    blocks = list(_numbers(benchmark))
    for k in blocks:
        docs = docs.where(F.size(_leaks(docs, _block(benchmark, k, len(blocks)))) == 0)
        docs = docs if len(blocks) == 1 else written(docs, "clean")
    return docs
