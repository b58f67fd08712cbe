"""Toxicity by maximum-scoring segments.

1. Every word and every word beginning has a log-odds of toxic against clean documents with an informative Dirichlet
   prior (the background rate), less its doubt (a multiple of its standard deviation), so rare words count for little.
2. A text is the sequence of its words' scores, each less a drift; a word counts once in each passage (see once_a_passage), and anew in the next. One linear scan
   (Ruzzo and Tompa) finds all maximal segments; runs of like sign are joined first, which leaves the segments unchanged.
3. Extreme-value statistics (Karlin and Altschul) calibrate segment scores: lambda and K come from clean texts, a
   segment is significant if its E-value is low, and a text's evidence is the sum of its significant segments'
   normalised scores. A logistic curve fitted on the training labels maps evidence to 0..1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SpanHash, byte_view, labelled_sample, map_arrow, slices, within_bytes, words

#: Score tables have fixed sizes, whatever the vocabulary: whole words, and beginnings of so many bytes.
TABLES = ((0, 1 << 19), (7, 1 << 18), (6, 1 << 17), (5, 1 << 17), (4, 1 << 16))
PRIOR = 4.0
DRIFT = 0.3
LOWEST, HIGHEST = -2.0, 8.0
E_VALUE = 0.05
#: Standard deviations by which a log-odds is drawn towards zero.
DOUBT = 1.4


def buckets(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Per table: the bucket of each word and whether the word is long enough for it; then starts, ends and rows of words."""
    data, offsets = byte_view(texts)
    starts, ends, rows = words(data, offsets)
    spans = SpanHash(data)
    out = []
    for size, many in TABLES:
        long = ends - starts > size
        to = np.minimum(starts + size, ends) if size else ends
        out.append(((spans.of(starts, to) & np.uint64(many - 1)).astype(np.int64), long))
    return out, starts, ends, rows


def maximal_segments(scores: Iterable[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) of a sequence, in one pass (Ruzzo and Tompa 1999)."""
    total, found = 0.0, []  # of each: left sum, right sum, first, end
    for k, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        left, right, first = total, total + score, k
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, k + 1))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, right - left) for left, right, first, end in found]


def once_a_passage(scores: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
    """Sets positive scores of words that a passage repeats to -DRIFT.

    A passage ends where the sum of its scores is down to 0, or HIGHEST below its peak; a single word that is repeated
    thus gives no sum that grows, and a later copy of a passage scores like the first. What is repeated at once, within
    HIGHEST / DRIFT words, is in the same passage.
    """
    where = np.flatnonzero(scores > 0)
    if not len(where):
        return
    again = np.ones(len(where), bool)
    again[np.unique(rows[where] * TABLES[0][1] + names[where], return_index=True)[1]] = False
    where = where[np.isin(rows[where], np.unique(rows[where[again]]))]  # rows without repeated words stay as they are
    below = np.cumsum(np.minimum(scores, 0), dtype=np.float64)[where].tolist()
    row, total, peak, before, seen = -1, 0.0, 0.0, 0.0, set()
    repeated = []
    for k, r, name, score, low in zip(where.tolist(), rows[where].tolist(), names[where].tolist(), scores[where].tolist(), below, strict=True):
        total = total + low - before if r == row else 0.0
        row, before = r, low
        if total <= 0:
            total = peak = 0.0
            seen.clear()
        elif total <= peak - HIGHEST:
            peak = total
            seen.clear()
        if name in seen:
            repeated.append(k)
            total -= DRIFT
        else:
            seen.add(name)
            total += score
            peak = max(peak, total)
    scores[repeated] = -DRIFT


@dataclass
class SegmentModel:
    tables: list[np.ndarray]
    rate: float = 1.0  # lambda
    k: float = 1e-3
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def word_scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        best = self.tables[0][found[0][0]]
        for table, (bucket, long) in zip(self.tables[1:], found[1:], strict=True):
            start = np.where(long, table[bucket], 0)
            best = np.where(start > np.maximum(best, 0), start, best)
        return np.clip(best, LOWEST, HIGHEST) - np.float32(DRIFT)

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]], np.ndarray]:
        """Words of each row; of rows that have any, the segments as (start byte, end byte, score); the word scores."""
        found, starts, ends, rows = buckets(texts)
        scores = self.word_scores(found)
        counts = np.bincount(rows, minlength=len(texts))
        out: dict[int, list[tuple[int, int, float]]] = {}
        if not len(scores):
            return counts, out, scores
        once_a_passage(scores, found[0][0], rows)
        up = scores > 0
        cut = np.ones(len(scores), bool)
        cut[1:] = (up[1:] != up[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(scores)) - 1
        sums, run_rows = np.add.reduceat(scores.astype(np.float64), first), rows[first]
        begins, stops = starts - self._offset(texts)[rows], ends - self._offset(texts)[rows]
        toxic = np.unique(run_rows[up[first]])
        low, high = np.searchsorted(run_rows, toxic), np.searchsorted(run_rows, toxic, side="right")
        for row, a, b in zip(toxic.tolist(), low.tolist(), high.tolist(), strict=True):
            out[row] = [(int(begins[first[a + i]]), int(stops[last[a + j - 1]]), s) for i, j, s in maximal_segments(sums[a:b].tolist())]
        return counts, out, scores

    @staticmethod
    def _offset(texts: pa.Array) -> np.ndarray:
        return byte_view(texts)[1]

    def evidence(self, words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Sum of the significant segments' normalised scores, the best normalised score, and those segments."""
        level = math.log(max(self.k * max(words, 1), 1e-12))
        kept = [(a, b, self.rate * s - level) for a, b, s in segments if math.exp(min(50.0, level - self.rate * s)) <= E_VALUE]
        best = max((self.rate * s - level for _, _, s in segments), default=0.0)
        return sum(x[2] for x in kept), max(best, 0.0), kept

    def score(self, total: float, best: float) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(total) + c * math.log1p(best)))))


def _tables(sample: DataFrame, sizes: tuple[int, int]) -> list[np.ndarray]:
    """Per table the log-odds of each bucket's words, from the clean and toxic documents that have them."""

    def count(batch: pa.RecordBatch) -> dict:
        y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), np.int64)
        found, _, _, rows = buckets(batch.column("text"))
        out: dict[str, list] = {"part": [], "bucket": [], "clean": [], "toxic": []}
        for part, ((bucket, long), (_, many)) in enumerate(zip(found, TABLES, strict=True)):
            seen = np.unique(rows[long] * many + bucket[long])  # a document counts once for each word
            label, at = y[seen // many], seen % many
            some, where = np.unique(at, return_inverse=True)
            toxic = np.bincount(where, weights=label, minlength=len(some)).astype(np.int64)
            out["part"].append(np.full(len(some), part))
            out["bucket"].append(some)
            out["clean"].append(np.bincount(where, minlength=len(some)) - toxic)
            out["toxic"].append(toxic)
        return {k: np.concatenate(v) for k, v in out.items()}

    rows = map_arrow(sample, count, "part long, bucket long, clean long, toxic long").groupBy("part", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # most words tell nothing; the driver gets the buckets that do, and never more rows than the tables have
    got = rows.select("part", "bucket", log_odds(F.col("clean"), F.col("toxic"), *sizes).cast("float").alias("odds")).where(F.abs("odds") > 0.02).toPandas()
    tables = []
    for part, (_, many) in enumerate(TABLES):
        own, table = got[got["part"] == part], np.zeros(many, np.float32)
        table[own["bucket"].to_numpy()] = own["odds"].to_numpy()
        tables.append(table)
    return tables


def log_odds(clean: Column, toxic: Column, all_clean: int, all_toxic: int) -> Column:
    """Log-odds of toxic against clean with a Dirichlet prior at the background rate, drawn DOUBT standard deviations to zero."""
    rate = (clean + toxic + 0.01) * PRIOR / (all_clean + all_toxic + 0.02)
    beside = F.lit(PRIOR) - F.least(rate, F.lit(PRIOR - 0.01))
    odds = lambda n, most: F.log((n + rate) / (F.greatest(F.lit(most) - n, F.lit(0)) + beside))
    delta = odds(toxic, all_toxic) - odds(clean, all_clean)
    spread = F.sqrt(1 / (clean + rate) + 1 / (toxic + rate))
    return F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - DOUBT * spread)


def trained(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = 20_000, most_bytes: int = 256 << 20) -> SegmentModel | None:
    """A model fitted on whole labelled texts, none twice: about `most` of them at most, with about so many bytes in all; None without both labels."""
    whole = labelled_sample(docs, labels, "toxic", held_out, most)
    whole = whole.withColumn("text", F.lower("text")).groupBy("text", "y").agg(F.min("doc_id").alias("doc_id")).persist()
    try:
        sample = within_bytes(whole, most_bytes)
        sizes = dict(map(tuple, sample.groupBy("y").count().collect()))
        if not sizes.get(0) or not sizes.get(1):
            return None
        return _calibrated(SegmentModel(_tables(sample, (sizes[0], sizes[1]))), sample)
    finally:
        whole.unpersist()


def _calibrated(model: SegmentModel, sample: DataFrame) -> SegmentModel:
    sent = sample.sparkSession.sparkContext.broadcast(model)
    edges = np.arange(LOWEST - DRIFT - 0.05, HIGHEST + 0.15, 0.1)

    def scanned(batch: pa.RecordBatch) -> dict:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        counts, segments, scores = sent.value.segments(batch.column("text"))
        clean = np.repeat(y == 0, counts)
        bins = np.histogram(scores[clean], edges)[0]
        best = [[s for *_, s in segments.get(i, ())] for i in range(len(y))]
        return {"y": [*map(int, y), -1], "words": [*map(int, counts), 0], "scores": [*best, bins.astype(float).tolist()]}

    got = map_arrow(sample, scanned, "y long, words long, scores array<double>").toPandas()  # a row for each text of the bounded sample
    bins = np.sum([np.asarray(x) for x in got[got["y"] == -1]["scores"]], axis=0)
    got = got[got["y"] >= 0]
    middle = (edges[1:] + edges[:-1]) / 2
    # one imagined toxic word among the clean ones keeps lambda finite where clean texts have none
    weights = np.append(bins, 1.0) / (bins.sum() + 1.0)
    points = np.append(middle, HIGHEST - DRIFT)
    low, high = 1e-3, 20.0
    for _ in range(80):
        rate = (low + high) / 2
        if float(weights @ np.exp(np.minimum(rate * points, 600))) < 1:
            low = rate
        else:
            high = rate
    model.rate = min(low, 5.0)
    clean = got[got["y"] == 0]
    maxima = np.array([max(x, default=0.0) for x in clean["scores"]])
    model.k = float(len(clean) / max(1e-9, (np.maximum(clean["words"].to_numpy(), 1) * np.exp(-model.rate * maxima)).sum()))
    seen = [model.evidence(n, [(0, 0, s) for s in x])[:2] for n, x in zip(got["words"], got["scores"], strict=True)]
    x = np.column_stack([np.ones(len(seen)), np.log1p(np.array(seen))])
    y, w = got["y"].to_numpy(float), np.zeros(3)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.05 * (w[1:] ** 2).sum())

    for _ in range(60):  # Newton's steps of a logistic regression with a weak ridge, halved while they overshoot
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([0, 0.1, 0.1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    model.curve = tuple(map(float, w))
    return model


def toxicity(docs: DataFrame, model: SegmentModel | None) -> DataFrame:
    """docs with score, predicted (1 from 0.5) and passages: significant segments (start_byte, end_byte, evidence) of the lower-cased text.

    Null and empty texts have no segment and get the curve's lowest score; without a model all scores are 0.
    Rows are independent, so ties and repeated rows change nothing; columns named score, predicted or passages are replaced.
    """
    docs = docs.drop("score", "predicted", "passages")
    kind = "struct<score: double, passages: array<struct<start_byte: int, end_byte: int, evidence: double>>>"
    if model is None:
        empty = F.from_json(F.lit("[]"), "array<struct<start_byte: int, end_byte: int, evidence: double>>")
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "passages": empty})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32()), ("evidence", pa.float64())])

    def scored(texts: pa.Array) -> pa.Array:
        model, out = sent.value, []
        plain = {"score": model.score(0.0, 0.0), "passages": []}
        for part in slices(texts):
            counts, segments, _ = model.segments(part)
            for row, n in enumerate(counts.tolist()):
                if row not in segments:
                    out.append(plain)
                    continue
                total, best, kept = model.evidence(n, segments[row])
                out.append({"score": model.score(total, best), "passages": [{"start_byte": a, "end_byte": b, "evidence": e} for a, b, e in kept]})
        return pa.array(out, pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))]))

    out = docs.withColumn("_skein_toxicity", F.arrow_udf(scored, kind)(F.lower(F.coalesce("text", F.lit("")))))
    score = F.col("_skein_toxicity.score")
    return out.withColumns({"score": score, "predicted": (score >= 0.5).cast("int"), "passages": F.col("_skein_toxicity.passages")}).drop("_skein_toxicity")
