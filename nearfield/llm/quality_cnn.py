"""Quality classifier (operator 5): a byte-level convolutional network in numpy.

A filter looks at ``width`` successive bytes; since bytes are one-hot, its response is a sum of ``width`` table rows. The
windows at all positions are laid in overlapping chunks (neighbours share ``width - 1`` bytes) that cover the whole text.
Each filter is max-pooled within a chunk; the largest, the mean and the smallest of a filter's chunk maxima go, after a
ReLU, into one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import release, training_rows

CHUNK = 192
_BLOCK = 256 * CHUNK


@dataclass
class Net:
    """``tables``: (width, 256, filters); ``bias``: (filters,); ``out``: (3 * filters,); ``rest``: the output's bias."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    rest: float

    @property
    def width(self) -> int:
        return len(self.tables)

    def padded(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data.ljust(self.width, b"\0"), np.uint8)

    def chunk_starts(self, size: int) -> np.ndarray:
        """The first window of each chunk of a text of ``size`` bytes; the last chunk takes the remainder."""
        return np.arange(max(1, (size - self.width + 1) // CHUNK)) * CHUNK

    def responses(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - self.width + 1
        out = self.tables[0].take(x[:n], axis=0)
        for k in range(1, self.width):
            out += self.tables[k].take(x[k : k + n], axis=0)
        return out

    def maxima(self, data: bytes) -> np.ndarray:
        """The largest response of each filter in each chunk of a whole text, some chunks at a time."""
        x = self.padded(data)
        starts, windows, parts = self.chunk_starts(len(x)), len(x) - self.width + 1, []
        for k in range(0, len(starts), _BLOCK // CHUNK):
            own = starts[k : k + _BLOCK // CHUNK]
            end = starts[k + _BLOCK // CHUNK] if k + _BLOCK // CHUNK < len(starts) else windows
            parts.append(np.maximum.reduceat(self.responses(x[own[0] : end + self.width - 1]), own - own[0], axis=0))
        return np.concatenate(parts) + self.bias

    def score(self, text: str | None) -> float:
        """The probability of label 1 for a whole text; null counts as empty."""
        m = self.maxima((text or "").encode())
        z = np.concatenate([m.max(axis=0), m.mean(axis=0), m.min(axis=0)])
        return float(1 / (1 + np.exp(-np.clip(np.maximum(z, 0) @ self.out + self.rest, -60, 60))))


def fit(texts: list[str], labels: list[int], filters: int = 16, width: int = 6, epochs: int = 12, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Net:
    """Adam on the logistic loss; gradients flow to the windows that won their chunk. Without both labels the score is
    the labels' mean (1/2 for none) throughout."""
    rng = np.random.default_rng(seed)
    net = Net(
        (rng.standard_normal((width, 256, filters)) * 0.3).astype(np.float32), np.zeros(filters, np.float32), (rng.standard_normal(3 * filters) * 0.1).astype(np.float32), 0.0
    )
    share = float(np.mean(labels)) if labels else 0.5
    if not 0 < share < 1:
        net.out[:] = 0
        net.rest = 0.0 if not labels else (6.0 if share else -6.0)
        return net
    net.rest = float(np.log(share / (1 - share)))
    data = [net.padded(t.encode()) for t in texts]
    y = np.array(labels, np.float64)
    params = [net.tables, net.bias, net.out, np.array([net.rest], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            picked = order[k : k + batch]
            grads = [np.zeros_like(p) for p in params]
            flat_at, flat_g = [], []
            for i in picked:
                x = data[i]
                if y[i] == 1 and rng.random() < 0.25:  # good text stays good when short: learn from cut-outs too
                    size = min(len(x), int(width * (64 ** rng.random())))
                    begin = int(rng.integers(0, len(x) - size + 1))
                    x = x[begin : begin + size]
                r = net.responses(x)
                starts = net.chunk_starts(len(x))
                m = np.maximum.reduceat(r, starts, axis=0)
                ends = np.append(starts[1:], len(r))
                at = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                m = m + net.bias
                hi, lo, col = m.argmax(axis=0), m.argmin(axis=0), np.arange(filters)
                z = np.concatenate([m[hi, col], m.mean(axis=0), m[lo, col]])
                a = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -60, 60)))
                g = (p - y[i]) / len(picked)
                grads[2] += g * a
                grads[3] += g
                gz = (g * params[2] * (z > 0)).reshape(3, filters)
                gm = np.repeat(gz[1:2] / len(m), len(m), axis=0)
                gm[hi, col] += gz[0]
                gm[lo, col] += gz[2]
                grads[1] += gm.sum(axis=0)
                for j in range(width):
                    flat_at.append(((j * 256 + x[at + j].astype(np.int64)) * filters + col).ravel())
                    flat_g.append(gm.ravel())
            grads[0] += np.bincount(np.concatenate(flat_at), np.concatenate(flat_g), grads[0].size).reshape(grads[0].shape).astype(np.float32)
            step += 1
            lr = rate * (1 - epoch / epochs) + rate / 20
            for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
                g = g + decay * p if p is not params[3] else g
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    net.rest = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 20_000) -> Net:
    """Fit on the driver, on at most ``max_rows`` labelled texts of at most ``max_chars`` characters (a bounded sample by
    hash of doc_id); rows whose ``crc32(doc_id) mod 3`` is 1 are never learned from."""
    rows = sorted(training_rows(docs, labels, "quality", max_rows, max_chars).collect())
    return fit([r.text for r in rows], [int(r.label) for r in rows])


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``, over the whole text. Null texts count as empty, null doc_ids
    and repeated rows stay, an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([net.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Net, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            keep = pa.array([net.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(keep)
        release()

    return docs.mapInArrow(run, schema)


def op5_quality_cnn(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scores(docs, net).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
