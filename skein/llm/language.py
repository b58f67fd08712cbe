"""Language ID by a byte convolutional network.

Every text is cut into fixed-length byte windows; each window passes filters of several widths, max pooling and a
softmax. The network is trained in numpy on a bounded sample of labelled windows; a document's language is the one
with the highest probability averaged over all its windows (by bytes), so whole texts count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import byte_view, pieces, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of all rows, the row of each, and its length in bytes."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    rows = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[rows] + nth * WINDOW
    sizes = np.minimum(offsets[rows + 1] - starts, WINDOW)
    if not len(rows):
        return np.zeros((0, WINDOW), np.uint8), rows, sizes
    index = np.minimum(starts[:, None] + np.arange(WINDOW), len(data) - 1)
    return data[index] * (np.arange(WINDOW) < sizes[:, None]), rows, sizes


@dataclass
class ByteConvNet:
    """One table per filter tap: the tap's weight for each byte value, which is embedding and filter in one."""

    languages: list[str]
    taps: list[np.ndarray]  # per width: (width, 256, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(languages: list[str], filters: int, rng: np.random.Generator) -> ByteConvNet:
        taps = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        many = filters * len(WIDTHS)
        return ByteConvNet(languages, taps, np.zeros(many, np.float32), rng.normal(0, 0.2, (many, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def _responses(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        padded = np.ascontiguousarray(np.pad(x, ((0, 0), (0, max(WIDTHS) - 1))).T).astype(np.intp)
        for width, taps in zip(WIDTHS, self.taps, strict=True):
            out = np.take(taps[0], padded[:WINDOW], axis=0)
            for k in range(1, width):
                out += np.take(taps[k], padded[k : k + WINDOW], axis=0)
            yield width, out

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def paired(self) -> Callable[[np.ndarray], np.ndarray]:
        """Window probabilities with two taps in one table of byte pairs: the same sums with half the look-ups."""
        two, three, four = self.taps
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)
        two_ab, three_ab, four_ab, four_cd = pair(two, 0), pair(three, 0), pair(four, 0), pair(four, 2)

        def probabilities(x: np.ndarray) -> np.ndarray:
            out = []
            for start in range(0, len(x), 128):
                # positions first, so that pooling runs along whole rows of memory
                part = np.ascontiguousarray(np.pad(x[start : start + 128], ((0, 0), (0, max(WIDTHS) - 1))).T).astype(np.intp)
                pairs = (part[:-1] << 8) | part[1:]
                first = pairs[:WINDOW]
                pooled = [np.take(two_ab, first, axis=0).max(axis=0)]
                response = np.take(three_ab, first, axis=0)
                response += np.take(three[2], part[2 : 2 + WINDOW], axis=0)
                pooled.append(response.max(axis=0))
                response = np.take(four_ab, first, axis=0)
                response += np.take(four_cd, pairs[2 : 2 + WINDOW], axis=0)
                pooled.append(response.max(axis=0))
                out.append(self._softmax(np.concatenate(pooled, axis=1)))
            return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

        return probabilities

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 64) -> None:
        """Adam on cross-entropy; the gradient of max pooling reaches only the taps at the best position."""
        params = [*self.taps, self.bias, self.dense, self.offset]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        filters, step = self.taps[0].shape[2], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                # short texts must work too: a third of the windows are cut to a random length
                short = np.where(rng.random(len(some)) < 0.33, rng.integers(16, WINDOW, len(some)), WINDOW)
                xb = x[some] * (np.arange(WINDOW) < short[:, None])
                padded = np.pad(xb, ((0, 0), (0, max(WIDTHS) - 1)))
                pooled, best = [], []
                for _, response in self._responses(xb):
                    pooled.append(response.max(axis=0))
                    best.append((response == pooled[-1]).argmax(axis=0))
                hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
                z = hidden @ self.dense + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                p /= len(some)
                back = (p @ self.dense.T) * (hidden > 0)
                grads = []
                for w, (width, where) in enumerate(zip(WIDTHS, best, strict=True)):
                    g, own = np.zeros_like(self.taps[w]), back[:, w * filters : (w + 1) * filters]
                    for k in range(width):
                        seen = np.take_along_axis(padded, where + k, axis=1)
                        np.add.at(g[k], (seen, np.arange(filters)[None, :]), own)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _training_windows(docs: DataFrame, held_out: Column, texts_per_language: int, bytes_per_language: int) -> DataFrame:
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out & F.col("text").rlike(r"\p{L}"))
    sizes = learn.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    # the languages are a short list of labels; only their names, counts and sizes come to the driver
    share = {r["lang"]: min(1.0, texts_per_language / r["n"], bytes_per_language / r["bytes"]) for r in sizes.collect()}
    if not share:
        return docs.limit(0).select(F.lit("").alias("lang"), F.lit(b"").alias("window"))
    most = F.create_map(*[x for k, part in share.items() for x in (F.lit(k), F.lit(int(1e6 * part)))])
    learn = learn.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1_000_000)) < most[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x, rows, _ = windows_of(*byte_view(part.column("text")))
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang").take(pa.array(rows)), "window": pa.array([w.tobytes() for w in x], pa.binary())})

    return learn.select("lang", "text").mapInArrow(cut, "lang string, window binary")


def trained(docs: DataFrame, held_out: Column, texts_per_language: int = 1000, bytes_per_language: int = 1 << 20, filters: int = 16, steps: int = 600, seed: int = 7) -> ByteConvNet | None:
    """A network fitted on all windows of at most about texts_per_language whole texts of each language, with about so many bytes in all.

    None if no row has both a text with a letter and a language.
    """
    got = _training_windows(docs, held_out, texts_per_language, bytes_per_language).toPandas().sort_values(["lang", "window"])
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(languages, got["lang"].to_numpy())
    rng = np.random.default_rng(seed)
    # languages weigh alike: windows of rarer ones are repeated
    size = np.bincount(y).max()
    again = np.concatenate([rng.permutation(np.resize(np.flatnonzero(y == k), min(size, 4 * int((y == k).sum())))) for k in range(len(languages))])
    net = ByteConvNet.fresh(languages, filters, rng)
    epochs = int(np.clip(steps * 64 / len(again), 2, 40))
    net.train(x[again], y[again], epochs, 0.004, rng)
    return net


def language(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """docs with lang_pred and score: the best language over all windows and its probability.

    `und` and 0.0 for a null or empty text, a text without a letter, and whenever nothing could be learnt.
    Rows are independent: ties, repeated rows and extra columns change nothing; columns named lang_pred, score,
    or beginning with _skein_ are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(net)
    ready: list[Callable] = []

    def classified(texts: pa.Array) -> pa.Array:
        net = sent.value
        if not ready:
            ready.append(net.paired())
        labels, scores = [], [np.zeros(0)]
        for part in slices(texts):
            data, offsets = byte_view(part)
            total = np.zeros((len(part), len(net.languages)))
            x, rows, sizes = windows_of(data, offsets)
            if len(rows):
                np.add.at(total, rows, ready[0](x) * sizes[:, None])
            total /= np.maximum(1e-9, total.sum(axis=1, keepdims=True))
            best = total.argmax(axis=1)
            labels += [net.languages[k] for k in best]
            scores.append(np.clip(total[np.arange(len(best)), best], 0, 1))
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    known = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    out = docs.withColumn("_skein_language", F.arrow_udf(classified, "struct<lang_pred: string, score: double>")(F.col("text")))
    return out.withColumns({"lang_pred": F.when(known, F.col("_skein_language.lang_pred")).otherwise(UNKNOWN), "score": F.when(known, F.col("_skein_language.score")).otherwise(0.0)}).drop("_skein_language")
