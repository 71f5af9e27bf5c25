"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (windows of PASSAGE bytes of its UTF-8 text). Every passage is encoded
(byte and byte-pair histograms through a learned tanh layer), gated attention weighs the passages of a
bag, and a logistic head scores the weighted mean. Only document labels are used to learn.

Learning reads at most ``max_bags`` labelled documents, those with the least seeded hash of their id,
and at most ``max_passages`` evenly spaced passages of each; scoring reads all passages of all texts.

Defined results: null text scores as the empty text, which is one passage without bytes; repeated rows get
equal scores; labels that contradict each other for one doc_id are not learnt from; labelled documents whose hashes
tie are taken in order of id; very long texts are scored whole, in blocks; with no labels, or of one class only, every
score is the share of label 1 (0.5 without any); a column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import held_out, slices

PASSAGE = 1024
PAIRS = 256
#: Bytes encoded at once, so that long texts and large batches stay within a worker's memory.
BLOCK = 1 << 20
WIDTH = 256 + PAIRS + 3
THRESHOLD = 0.7


def _histograms(data: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """Byte and hashed byte-pair counts of the n passages that bag numbers."""
    one = np.bincount(bag * 256 + data, minlength=n * 256).reshape(n, 256)
    pair = (data[:-1].astype(np.uint32) * 31 + data[1:].astype(np.uint32) * 7) % PAIRS
    same = bag[:-1] == bag[1:]
    two = np.bincount(bag[:-1][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
    return np.concatenate([one, two], axis=1).astype(np.float32)


def _features(text: bytes) -> Iterator[np.ndarray]:
    """Feature rows of a text's passages, in blocks."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.count(b" ") + text.count(b"\n") + 1
    extra = np.array([1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(len(text)) / 10, len(text) / words / 10], np.float32)
    for at in range(0, max(1, len(text)), BLOCK):
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        n = max(1, -(-len(data) // PASSAGE))
        counts = _histograms(data, np.arange(len(data)) // PASSAGE, n)
        counts[:, :256] /= np.maximum(1, counts[:, :256].sum(1, keepdims=True))
        counts[:, 256:] /= np.maximum(1, counts[:, 256:].sum(1, keepdims=True))
        yield np.concatenate([np.sqrt(counts), np.broadcast_to(extra, (n, 3))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over encoded passages; fields are small arrays, shipped with the tasks."""

    def __init__(self, mean, scale, weights, prior=None):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh((x - self.mean) / self.scale @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]

    def score(self, text: bytes) -> float:
        """Softmax attention and head over a text of any length, with the encoded passages summed block by block."""
        if self.prior is not None:
            return self.prior
        top, total, z = -np.inf, 0.0, np.zeros(len(self.weights["c"]))
        for x in _features(text):
            h, e = self.encode(x)
            new = max(top, float(e.max()))
            keep, p = np.exp(top - new), np.exp(e - new)
            top, total, z = new, total * keep + float(p.sum()), z * keep + p @ h
        return float(_sigmoid(z / total @ self.weights["c"] + self.weights["d"]))


def learn(bags: list[np.ndarray], y: np.ndarray, *, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit by Adam on the cross-entropy of bag labels."""
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return Model(None, None, None, float(y.mean()) if len(y) else 0.5)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.01
    start = np.cumsum([0, *map(len, bags)])
    every = (every - mean) / scale
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(())}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            cut = np.cumsum([0, *(start[i + 1] - start[i] for i in own)])[:-1]
            of = np.repeat(np.arange(len(own)), np.diff([*cut, len(rows)]))
            x = every[rows]
            h = np.tanh(x @ p["W"] + p["b"])
            left, right = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            e = (left * right) @ p["a"]
            e = np.exp(e - np.maximum.reduceat(e, cut)[of])
            share = e / np.add.reduceat(e, cut)[of]
            z = np.add.reduceat(share[:, None] * h, cut)
            dz = (_sigmoid(z @ p["c"] + p["d"]) - y[own]) / len(own)
            g = {"c": z.T @ dz, "d": dz.sum()}
            back = dz[:, None] * p["c"]
            dshare = (h * back[of]).sum(1)
            de = share * (dshare - np.add.reduceat(share * dshare, cut)[of])
            g["a"] = (left * right).T @ de
            dleft, dright = de[:, None] * p["a"] * right * (1 - left**2), de[:, None] * p["a"] * left * right * (1 - right)
            g["V"], g["U"] = h.T @ dleft, h.T @ dright
            dh = (share[:, None] * back[of] + dleft @ p["V"].T + dright @ p["U"].T) * (1 - h**2)
            g["W"], g["b"] = x.T @ dh, dh.sum(0)
            t += 1
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: x.astype(np.float32) for k, x in p.items()})


def train(docs: DataFrame, labels: DataFrame, *, max_bags: int = 3000, max_passages: int = 16, seed: int = 7) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("__lo"), F.max("quality").alias("__hi"))
        .where("__lo = __hi").select(F.col("doc_id").alias("__id"), (F.col("__lo") > 0).cast("double").alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_bags)
    )

    def passages(batches):
        for b in slices(batches):
            out = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                x = np.concatenate(list(_features(text or b"")))
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).astype(int)]
                out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["id", "y", "x"])

    # ids is bounded by max_bags rows of two numbers, so it may be broadcast; of repeated ids one text counts, so the
    # rows that come back have that bound too.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y").mapInArrow(passages, "id long, y double, x binary")
        .groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").orderBy("id").collect()
    )
    bags = [np.frombuffer(bytes(r["x"]), np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    return learn(bags, np.array([r["y"] for r in rows]), seed=seed)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the score of every whole text; one pass, no shuffle."""
    at = docs.columns.index(text_col)
    schema = docs.drop(score_col).withColumn(score_col, F.lit(0.0)).schema
    names = [c for c in docs.columns if c != score_col]

    def scored(batches):
        for b in slices(batches):
            s = [round(model.score(x or b""), 6) for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in names), pa.array(s, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(scored, schema)
