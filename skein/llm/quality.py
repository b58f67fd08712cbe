"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, cut at PASSAGE bytes). Every passage is encoded: shares of character classes,
word lengths and repetitions pass a dense layer. Gated attention weighs the passages; its weights are learnt from
document labels alone. The weighted passage representation gives the document's probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import byte_view, labelled_sample, map_arrow, slices, within_bytes, SpanHash

PASSAGE = 512
ACCEPT = 0.7

# Character classes: letters of either case, digits, spaces, other controls, non-ASCII bytes, and each ASCII sign by itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[128:] = 1, 2, 3, 4, 5
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
CLASSES = 6 + len(_SIGNS)
FEATURES = CLASSES + 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all rows, and the row of each; a row without passages has none."""
    data, offsets = byte_view(texts)
    if not len(data):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    row_starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts = np.unique(np.concatenate([row_starts, np.flatnonzero(data[:-1] == 10) + 1]))
    sizes = np.diff(np.append(starts, len(data)))
    parts = -(-sizes // PASSAGE)
    starts = np.repeat(starts, parts) + PASSAGE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.append(starts[1:], len(data))
    many, length = len(starts), (ends - starts).astype(np.float64)
    of_byte = np.repeat(np.arange(many), ends - starts)
    counts = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=many * CLASSES).reshape(many, CLASSES)
    # words by white space; where one repeats the one before, or the one before that
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[True], space])
    word_starts = np.flatnonzero(~space & (before[:-1] | edge[:-1]))
    after = np.concatenate([space, [True]])
    word_ends = np.flatnonzero(~np.concatenate([[True], space]) & (after | edge))
    owner = of_byte[word_starts]
    h = SpanHash(data).of(word_starts, word_ends)
    once, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    once[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    twice[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])
    words = np.bincount(owner, minlength=many)
    per_word = lambda x: np.bincount(owner, weights=x, minlength=many) / np.maximum(1, words)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    # lines that their document repeats
    line = SpanHash(data).of(starts, ends)
    _, place, seen = np.unique(np.stack([rows.astype(np.uint64), line]), axis=1, return_inverse=True, return_counts=True)
    x = np.column_stack(
        [
            counts / length[:, None],
            per_word(once),
            per_word(twice),
            per_word((word_ends - word_starts).astype(float)) / 10,
            words / length,
            np.log1p(length) / 6,
            (seen[place.ravel()] > 1) & (length > 20),
            per_word(~_is_letter(data[word_ends - 1])) if len(h) else np.zeros(many),
        ]
    )
    return x.astype(np.float32), rows


def _is_letter(b: np.ndarray) -> np.ndarray:
    return (_CLASS[b] == 1) | (_CLASS[b] == 2) | (_CLASS[b] == 5)


@dataclass
class AttentionModel:
    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.maximum((x - self.mean) / self.spread @ p["w"] + p["b"], 0)
        v, u = np.tanh(z @ p["v"]), 1 / (1 + np.exp(-z @ p["u"]))
        a = (v * u) @ p["a"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a = a / np.repeat(np.add.reduceat(a, starts), sizes)
        bag = np.add.reduceat(z * a[:, None], starts, axis=0)
        return {"z": z, "v": v, "u": u, "a": a, "bag": bag, "logit": bag @ p["c"] + p["d"]}

    def train(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.01) -> None:
        """Adam on cross-entropy of document labels; both labels weigh alike."""
        p, step = self.p, 0
        first, second = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
        at = np.concatenate([[0], np.cumsum(sizes)])
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), 128):
                some = order[k : k + 128]
                own, n = np.concatenate([x[at[i] : at[i + 1]] for i in some]), sizes[some]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                f = self._forward(own, starts, n)
                g = (1 / (1 + np.exp(-f["logit"])) - y[some]) * weight[some] / len(some)
                grad = {"c": f["bag"].T @ g, "d": g.sum(keepdims=True)}
                back = np.repeat(g[:, None] * p["c"], n, axis=0)  # of each passage's share of its bag
                dz = back * f["a"][:, None]
                da = (back * f["z"]).sum(axis=1)
                da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), n))
                gate = f["v"] * f["u"]
                grad["a"] = gate.T @ da
                dgate = da[:, None] * p["a"]
                dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
                grad["v"], grad["u"] = f["z"].T @ dv, f["z"].T @ du
                dz = (dz + dv @ p["v"].T + du @ p["u"].T) * (f["z"] > 0)
                grad["w"], grad["b"] = ((own - self.mean) / self.spread).T @ dz, dz.sum(axis=0)
                step += 1
                for name, value in p.items():
                    d = grad[name] + 1e-4 * value
                    first[name] += 0.1 * (d - first[name])
                    second[name] += 0.001 * (d * d - second[name])
                    value -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each row, the start of its best-weighted passage's place among its passages, and that weight."""
        x, rows = passages(texts)
        out = np.full(len(texts), 1 / (1 + np.exp(-float(self.p["d"][0]))))  # an empty bag: the bias alone
        top, weight = np.full(len(texts), -1), np.zeros(len(texts))
        if len(x):
            some, starts, sizes = np.unique(rows, return_index=True, return_counts=True)
            f = self._forward(x, starts, sizes)
            out[some] = 1 / (1 + np.exp(-np.clip(f["logit"], -40, 40)))
            weight[some] = np.maximum.reduceat(f["a"], starts)
            best = np.flatnonzero(f["a"] == np.repeat(weight[some], sizes))[::-1]
            top[rows[best]] = best - np.repeat(starts, sizes)[best]
        return out, top, weight


def trained(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = 6_000, most_bytes: int = 32 << 20, hidden: int = 24, gates: int = 8, seed: int = 11) -> AttentionModel | None:
    """A model fitted on whole labelled documents: about `most` of them at most, with about so many bytes of text in all; None without both labels.

    Only the passages' features of that bounded sample come to the driver.
    """
    whole = labelled_sample(docs, labels, "quality", held_out, most).persist()
    sample = within_bytes(whole, most_bytes)

    def features(batch: pa.RecordBatch) -> dict:
        x, rows = passages(batch.column("text"))
        counts = np.bincount(rows, minlength=batch.num_rows)
        own = [x[a:b].tobytes() for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y").cast(pa.int64()), "x": pa.array(own, pa.binary())}

    got = map_arrow(sample, features, "doc_id long, y long, x binary").toPandas().sort_values(["doc_id", "x"])
    whole.unpersist()
    got = got[got["x"].map(len) > 0]
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    sizes = got["x"].map(len).to_numpy() // (4 * FEATURES)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
    rng = np.random.default_rng(seed)
    shape = {"w": (FEATURES, hidden), "v": (hidden, gates), "u": (hidden, gates), "a": (gates,), "c": (hidden,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"b": np.zeros(hidden), "d": np.zeros(1)}
    model = AttentionModel(x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-2, p)
    model.train(x, sizes, y, int(np.clip(40_000 / len(y), 8, 60)), rng)
    return model


def quality(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """docs with score, predicted (1 from ACCEPT), top_passage (place of the passage with most weight, -1 if none) and its weight.

    Null and empty texts have no passage and get the model's bias as score; without a model all scores are 0. Rows are
    independent, so ties and repeated rows change nothing; columns of those names are replaced.
    """
    names = ["score", "predicted", "top_passage", "top_weight"]
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "top_passage": F.lit(-1).cast("long"), "top_weight": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        parts = [sent.value.scores(part) for part in slices(texts)] or [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["score", "top_passage", "top_weight"])

    out = docs.withColumn("_skein_quality", F.arrow_udf(scored, "struct<score: double, top_passage: bigint, top_weight: double>")(F.coalesce("text", F.lit(""))))
    part = lambda name: F.col(f"_skein_quality.{name}")
    return out.withColumns({"score": part("score"), "predicted": (part("score") >= ACCEPT).cast("int"), "top_passage": part("top_passage"), "top_weight": part("top_weight")}).drop("_skein_quality")
