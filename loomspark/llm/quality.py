"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled_sample

#: Labelled rows that are drawn to learn from, at most (see labelled_sample).
SAMPLE_ROWS = 3000
#: Chunks of a text that are held at a time.
PIECE = 4096
EPOCHS, BATCH, RATE = 6, 32, 0.01
DIM, STEP, FILTERS, HALF = 8, 8, 24, 16


class Network:
    """Filters of 16 bytes at every 8th byte, max-pooled over overlapping chunks of 256 bytes (at every 128th); the
    mean and the maximum of the chunks' values are combined into one probability."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.first = r.normal(0, 1 / np.sqrt(2 * STEP * DIM), (STEP * DIM, FILTERS)).astype(np.float32)
        self.second = r.normal(0, 1 / np.sqrt(2 * STEP * DIM), (STEP * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.base = np.zeros(1, np.float32)

    NAMES = ("embed", "first", "second", "bias", "out", "base")

    @staticmethod
    def blocks(text: bytes) -> np.ndarray:
        """The text's bytes in steps of 8, zero-padded, with one step more than there are filter places; the places
        fill whole half-chunks, of which there are two at least."""
        halves = max(2, -(-len(text) // (STEP * HALF)))
        return np.frombuffer(text.ljust((halves * HALF + 1) * STEP, b"\0"), np.uint8).reshape(-1, STEP)

    def forward(self, codes: np.ndarray, keep: bool = False):
        """Features of one text's blocks; with keep, what the backward pass needs too."""
        x = self.embed[codes].reshape(len(codes), STEP * DIM)
        conv = x[:-1] @ self.first + x[1:] @ self.second + self.bias
        by_half = conv.reshape(-1, HALF, FILTERS)
        halves = np.maximum(by_half.max(1), 0)
        chunks = np.maximum(halves[:-1], halves[1:])
        features = np.concatenate([chunks.mean(0), chunks.max(0)])
        return (features, x, by_half, halves, chunks) if keep else features

    def logit(self, features: np.ndarray) -> float:
        return float(features @ self.out + self.base[0])

    def score(self, text: str) -> float:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.features(text.encode("utf-8", "replace"))), -30, 30)))

    def passes(self, text: bytes):
        """The text's blocks, in pieces of PIECE chunks at most, each with its forward pass; two neighbours share the
        half-chunk between them, so each chunk is in one piece."""
        codes = self.blocks(text)
        halves = (len(codes) - 1) // HALF
        for at in range(0, halves - 1, PIECE):
            piece = codes[at * HALF : min(at + PIECE + 1, halves) * HALF + 1]
            yield piece, self.forward(piece, keep=True)

    @staticmethod
    def pooled(passes) -> tuple[np.ndarray, int, np.ndarray]:
        """Features of a whole text from its passes, its number of chunks, and in which of them each filter is
        largest (the first of equals)."""
        total, most, where, n = np.zeros(FILTERS), np.full(FILTERS, -1.0), np.zeros(FILTERS, np.int64), 0
        for _, (*_, chunks) in passes:
            best = chunks.argmax(0)
            value = chunks[best, np.arange(FILTERS)]
            where = np.where(value > most, best + n, where)
            total, most, n = total + chunks.sum(0), np.maximum(most, value), n + len(chunks)
        return np.concatenate([total / n, most]), n, where

    def features(self, text: bytes) -> np.ndarray:
        """Of any length in bounded memory."""
        return self.pooled(self.passes(text))[0]

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over whole texts. The passes of a long one aren't kept, but made again."""
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for text, y in zip(texts, labels):
            kept = list(self.passes(text)) if len(text) <= PIECE * HALF * STEP else None
            features, n, where = self.pooled(kept or self.passes(text))
            d = (1 / (1 + np.exp(-np.clip(self.logit(features), -30, 30))) - y) / len(texts)
            g["out"] += d * features
            g["base"] += d
            before = 0
            for codes, (_, x, by_half, halves, chunks) in kept or self.passes(text):
                d_chunks = np.broadcast_to(d * self.out[:FILTERS] / n, chunks.shape).copy()
                mine = np.flatnonzero((where >= before) & (where < before + len(chunks)))
                d_chunks[where[mine] - before, mine] += d * self.out[FILTERS + mine]
                before += len(chunks)
                self._backward(g, codes, x, by_half, halves, d_chunks)
        return g

    def _backward(self, g: dict[str, np.ndarray], codes: np.ndarray, x: np.ndarray, by_half: np.ndarray, halves: np.ndarray, d_chunks: np.ndarray) -> None:
        left = halves[:-1] >= halves[1:]
        d_halves = np.zeros_like(halves)
        d_halves[:-1] += d_chunks * left
        d_halves[1:] += d_chunks * ~left
        d_halves *= halves > 0
        place = by_half.argmax(1)
        d_conv = np.zeros_like(by_half)
        np.put_along_axis(d_conv, place[:, None, :], d_halves[:, None, :], 1)
        d_conv = d_conv.reshape(-1, FILTERS)
        g["bias"] += d_halves.sum(0)
        g["first"] += x[:-1].T @ d_conv
        g["second"] += x[1:].T @ d_conv
        d_x = np.zeros_like(x)
        d_x[:-1] += d_conv @ self.first.T
        d_x[1:] += d_conv @ self.second.T
        d_bytes, flat = d_x.reshape(-1, DIM), codes.reshape(-1)
        for k in range(DIM):
            g["embed"][:, k] += np.bincount(flat, d_bytes[:, k], 256)

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 0) -> "Network":
        """Adam on the log loss. The rarer label is drawn more often, up to a quarter of each epoch; the base is
        then corrected for that."""
        if not len(texts) or labels.min() == labels.max():
            self.base[0] = np.log((labels.sum() + 0.5) / ((1 - labels).sum() + 0.5)) if len(texts) else 0.0
            return self
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in self.NAMES} for _ in range(2))
        share = labels.mean()
        drawn = np.clip(share, 0.25, 0.75)
        p = np.where(labels > 0, drawn / labels.sum(), (1 - drawn) / (1 - labels).sum())
        steps = EPOCHS * -(-len(texts) // BATCH)
        steps = max(steps, 150)
        for step in range(1, steps + 1):
            batch = r.choice(len(texts), BATCH, p=p)
            g = self.gradients([texts[i] for i in batch], labels[batch])
            rate = RATE * (1 - step / (steps + 1))
            for k in self.NAMES:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
        self.base += np.float32(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, seed: int = 0) -> Network:
    """A network trained on the whole texts of a bounded sample of the labelled documents (doc_id, text); with labels
    of one kind only it answers with their rate, without any with 0.5."""
    sample = labelled_sample(docs, labels, label, rows)
    return Network(seed).train([t.encode("utf-8", "replace") for _, t, _ in sample], np.array([y for _, _, y in sample], np.float64), seed)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs with `score`, the probability of label 1, from every byte of every text (a null text counts as empty,
    which is scored like any other); a column of this name is replaced, all others stay, and all rows: equal texts
    have equal scores, repeated rows stay repeated, an empty table stays empty. A text of any length is read in
    pieces of PIECE chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([float(model.score(t or "")) for t in texts], dtype="float64")

    return docs.drop("score").withColumn("score", of("text"))
