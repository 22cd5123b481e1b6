"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import training
from tidemark.llm.common import in_batches, texts_of

CHUNK, STRIDE = 512, 384  # bytes of a chunk and between the starts of two: chunks overlap and cover the document
WIDTH, FILTERS = 5, 8
LAGS = range(2, 33)  # distances at which a byte counts as repeating what went before
RUN = 8  # bytes that have to repeat
SYMBOLS = 513  # every byte, repeating or not, and padding
PAD = 512

TRAINING_ROWS = 1_500  # labelled rows of each class, at most
TRAINING_CHUNKS = 8  # chunks of a training document that the filters learn from, at most
STEPS, BATCH, RATE, DECAY = 700, 128, 0.02, 1e-4


def symbols(text: bytes) -> np.ndarray:
    """Input of the network: bytes, plus 256 where the eight bytes from here stood a short way before."""
    raw = np.frombuffer(text, np.uint8)
    out = raw.astype(np.uint16)
    if len(raw) > RUN:
        runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, RUN)).view(np.uint64).ravel()
        again = np.zeros(len(runs), bool)
        for lag in LAGS:
            if lag < len(runs):
                again[lag:] |= runs[lag:] == runs[:-lag]
        out[: len(runs)] += again.astype(np.uint16) * 256
    return out


def chunk_starts(size: int) -> range:
    return range(0, max(size - (CHUNK - STRIDE), 1), STRIDE)


@dataclass
class Network:
    """Filters (a table of weights per offset and symbol), a dense layer on their maxima, and how chunks make a probability."""

    filters: np.ndarray  # WIDTH x SYMBOLS x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    combine: np.ndarray  # of the mean and the least chunk logit, and a constant

    def maxima(self, streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses of all chunks of some documents, and the number of chunks of each."""
        gap = np.full(WIDTH, PAD, np.uint16)
        at, starts, ends, counts, joined = 0, [], [], [], []
        for s in streams:
            own = [(at + a, at + min(a + CHUNK, max(len(s), 1))) for a in chunk_starts(len(s))]
            starts += [a for a, _ in own]
            ends += [b for _, b in own]
            counts.append(len(own))
            joined += [s, gap]
            at += len(s) + WIDTH
        line = np.concatenate([*joined, gap])
        n = at + 1
        response = np.zeros((n, FILTERS), np.float32)
        for k in range(WIDTH):
            response += np.take(self.filters[k], line[k : k + n], axis=0)
        cuts = np.stack([starts, ends], 1).ravel()
        return np.maximum.reduceat(response, cuts, axis=0)[::2] + self.bias, np.array(counts)

    def features(self, streams: list[np.ndarray]) -> np.ndarray:
        """Mean and least chunk logit of every document."""
        best, counts = self.maxima(streams)
        logits = np.maximum(best, 0) @ self.dense + self.offset
        starts = np.cumsum(counts) - counts
        return np.stack([np.add.reduceat(logits, starts) / counts, np.minimum.reduceat(logits, starts)], 1)

    def scores(self, streams: list[np.ndarray]) -> np.ndarray:
        z = self.features(streams).astype(float) @ self.combine[:2] + self.combine[2]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(chunks: np.ndarray, labels: np.ndarray, docs: list[tuple[np.ndarray, int]], seed: int = 7) -> Network:
    """Learn the filters on chunks by gradient descent, then how to combine the chunks of a document."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
    w[:, PAD] = 0
    net = Network(w, np.zeros(FILTERS, np.float32), rng.normal(0, 0.5, FILTERS).astype(np.float32), 0.0, np.array([1.0, 0.0, 0.0]))
    if len(np.unique(labels)) < 2:
        net.combine = np.array([0.0, 0.0, 3.0 if len(labels) == 0 or labels[0] else -3.0])
        return net
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    params = [net.filters, net.bias, net.dense, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    span = chunks.shape[1] - WIDTH + 1
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        x, y = chunks[rows], labels[rows].astype(np.float32)
        z = np.zeros((len(rows), span, FILTERS), np.float32)
        for k in range(WIDTH):
            z += np.take(params[0][k], x[:, k : k + span], axis=0)
        top = z.argmax(axis=1)
        best = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + params[1]
        active = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ params[2] + params[3], -30, 30)))
        error = (p - y) / len(rows)
        back = error[:, None] * params[2][None, :] * (best > 0)
        grads = [DECAY * params[0], back.sum(0), active.T @ error + DECAY * params[2], error.sum(keepdims=True)]
        every = np.arange(FILTERS)[None, :]
        for k in range(WIDTH):
            np.add.at(grads[0][k], (x[np.arange(len(rows))[:, None], top + k], np.broadcast_to(every, top.shape)), back)
        grads[0][:, PAD] = 0
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for q, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.offset = float(params[3][0])
    net.combine = _combine(np.concatenate([net.features([s]) for s, _ in docs]), np.array([y for _, y in docs], float))
    return net


def _combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    design, theta = np.column_stack([x, np.ones(len(x))]).astype(float), np.zeros(3)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = 1e-3 * len(y) * np.diag([1.0, 1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + ridge @ theta
        theta = theta - np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, grad)
    return theta


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, chunks: int = TRAINING_CHUNKS) -> Network:
    """A network from at most ``rows`` labelled documents of each class, none of them held out.

    At most ``chunks`` evenly spaced chunks of each reach the driver, which
    bounds what it holds; scoring always covers whole documents.
    """
    chosen = training.sample(docs, labels, "quality", rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = []
            for text in texts_of(part, "text"):
                stream = symbols(text)
                starts = np.array(chunk_starts(len(stream)))
                picked = starts[np.unique(np.linspace(0, len(starts) - 1, min(chunks, len(starts))).astype(int))]
                padded = np.full((len(picked), CHUNK), PAD, np.uint16)
                for row, a in zip(padded, picked):
                    piece = stream[a : a + CHUNK]
                    row[: len(piece)] = piece
                cells.append(padded.tobytes())
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("label"), pa.array(cells, pa.binary())], ["doc_id", "label", "cells"])

    got = in_batches(chosen.withColumn("doc_id", F.col("doc_id").cast("long")), cut, "doc_id long, label int, cells binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.cells)))
    if not got:
        return fit(np.zeros((0, CHUNK), np.uint16), np.zeros(0), [])
    tables = [np.frombuffer(r.cells, np.uint16).reshape(-1, CHUNK) for r in got]
    marks = np.concatenate([np.full(len(t), r.label) for t, r in zip(tables, got)])
    wholes = []
    for t, r in zip(tables, got):
        flat = np.concatenate([row[row != PAD] for row in t])
        wholes.append((flat, r.label))
    return fit(np.concatenate(tables), marks, wholes)


def score_quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of good quality, 0 to 1, one row per input row.

    Null and empty texts get the score of a single padded chunk. Whole texts
    are scored; ids may be null or repeat; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.record_batch([part.column("doc_id"), pa.array(_score(texts_of(part, "text"), network))], ["doc_id", "score"])

    return in_batches(slim, run, "doc_id long, score double")


def _score(texts: list[bytes], network: Network) -> np.ndarray:
    """Scores, some hundred thousand bytes at a time."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(symbols(text))
        size += len(text)
        if size > 200_000:
            out.append(network.scores(group))
            group, size = [], 0
    if group:
        out.append(network.scores(group))
    return np.concatenate(out) if out else np.zeros(0)


def keep_good(docs: DataFrame, network: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns unchanged."""
    kind = docs.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(_score(texts_of(part, text_col), network) >= least))

    return docs.mapInArrow(run, kind)
