"""Quality score by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters over
embedded bytes are max-pooled in each chunk; a small layer scores the chunk; mean and maximum over
all chunks make one probability. Chunks overlap by more than a filter's width, so every place of
the document is seen whole by some chunk.

The network is fitted by back-propagation on the driver from a bounded sample of labelled rows:
SAMPLE documents, half of each label where there are enough, chosen by a hash of doc_id, and at
most SAMPLE_CHUNKS chunks of each. Scoring reads every byte of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import ready, texts

CHUNK, STEP, WIDTH, STRIDE, DEPTH, FILTERS, HIDDEN = 256, 224, 8, 2, 8, 32, 16
SAMPLE, SAMPLE_CHUNKS, EPOCHS, BATCH, RATE, SEED = 4000, 8, 6, 32, 0.01, 7
#: Chunks that are convolved at once.
GROUP = 256


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks as rows; the last ends where the document does. Short texts are padded with zeros."""
    n = len(data)
    if n <= CHUNK:
        return np.frombuffer(data.ljust(CHUNK, b"\0"), np.uint8)[None, :]
    starts = np.r_[np.arange(0, n - CHUNK, STEP), n - CHUNK]
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), CHUNK)[starts]


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "emb": f(256, DEPTH, scale=0.5), "w1": f(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5), "b1": f(FILTERS, scale=0.0),
            "w2": f(FILTERS, HIDDEN, scale=FILTERS**-0.5), "b2": f(HIDDEN, scale=0.0), "w3": f(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "b3": f(1, scale=0.0),
        }
        self.constant: float | None = None

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each chunk, and where it is."""
        e = np.ascontiguousarray(self.p["emb"][x])
        c, n, d = e.shape
        at = np.lib.stride_tricks.as_strided(e, (c, (n - WIDTH) // STRIDE + 1, WIDTH * d), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
        z = (at.reshape(-1, WIDTH * d) @ self.p["w1"]).reshape(c, -1, FILTERS)
        where = z.argmax(axis=1) if self.training else np.empty((0, 0), np.int64)
        return z.max(axis=1) + self.p["b1"], where

    training = False

    def chunk_features(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self._pooled(x[k : k + GROUP])[0], 0) for k in range(0, len(x), GROUP)]
        return np.tanh(np.concatenate(out) @ self.p["w2"] + self.p["b2"])

    def score(self, found: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.constant is not None:
            return np.full(len(found), self.constant)
        out = np.empty(len(found))
        parts = [chunks(x) for x in found]
        k = 0
        while k < len(parts):
            last, n = k, 0
            while last < len(parts) and (n == 0 or n + len(parts[last]) <= 16 * GROUP):
                n += len(parts[last])
                last += 1
            h = self.chunk_features(np.concatenate(parts[k:last]))
            firsts = np.r_[0, np.cumsum([len(x) for x in parts[k:last]])[:-1]]
            mean = np.add.reduceat(h, firsts) / np.array([[len(x)] for x in parts[k:last]], np.float32)
            pooled = np.concatenate([mean, np.maximum.reduceat(h, firsts)], axis=1)
            out[k:last] = 1 / (1 + np.exp(-(pooled @ self.p["w3"] + self.p["b3"]).astype(np.float64)))
            k = last
        return out

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; x: chunks of all documents, sizes: how many each has."""
        p, firsts, doc = self.p, np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
        self.training = True
        z, where = self._pooled(x)
        self.training = False
        a = np.maximum(z, 0)
        h = np.tanh(a @ p["w2"] + p["b2"])
        top = np.maximum.reduceat(h, firsts)
        pooled = np.concatenate([np.add.reduceat(h, firsts) / sizes[:, None], top], axis=1)
        err = ((1 / (1 + np.exp(-(pooled @ p["w3"] + p["b3"]))) - y) / len(y)).astype(np.float32)
        g = {"w3": pooled.T @ err, "b3": err.sum(keepdims=True)}
        d = err[:, None] * p["w3"]
        dh = d[doc, :HIDDEN] / sizes[doc, None] + d[doc, HIDDEN:] * (h == top[doc])
        dh = (dh * (1 - h * h)).astype(np.float32)
        g |= {"w2": a.T @ dh, "b2": dh.sum(axis=0)}
        dz = (dh @ p["w2"].T) * (z > 0)
        g["b1"] = dz.sum(axis=0)
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)
        b = x[np.arange(len(x))[:, None, None], at]
        g["w1"] = np.einsum("cf,cfk->kf", dz, p["emb"][b].reshape(len(x), FILTERS, -1), optimize=True)
        de = (dz[:, :, None] * p["w1"].T).reshape(-1, DEPTH)
        flat = b.reshape(-1)
        g["emb"] = np.stack([np.bincount(flat, de[:, j], 256) for j in range(DEPTH)], axis=1).astype(np.float32)
        return g

    def fit(self, rows: list[tuple[np.ndarray, int]]) -> Net:
        """rows: chunks of a document and its label. Without both labels the score is constant."""
        y = np.array([label for _, label in rows], np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        r, m, v, t = np.random.default_rng(SEED), {}, {}, 0
        steps = EPOCHS * -(-len(rows) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(rows))
            for k in range(0, len(rows), BATCH):
                some = order[k : k + BATCH]
                g = self.gradient(np.concatenate([rows[i][0] for i in some]), np.array([len(rows[i][0]) for i in some], np.float32).astype(np.int64), y[some])
                t += 1
                rate = RATE * (1 - 0.95 * t / steps)
                for name, d in g.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, each: int = SAMPLE_CHUNKS) -> list[tuple[np.ndarray, int]]:
    """Chunks and labels of a bounded sample of the labelled rows that may be learnt from.

    size: rows, half of each label, by a hash of doc_id. each: chunks of a row, drawn from its whole
    text, as the driver holds them all; scores read all chunks. Without labels the sample is empty.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    mixed = F.xxhash64("doc_id", F.lit(SEED))
    ids = known.where("quality = 0").orderBy(mixed, "doc_id").limit(size // 2).union(known.where("quality = 1").orderBy(mixed, "doc_id").limit(size // 2))
    wanted = {i: q for i, q in ids.collect()}  # at most size rows
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")), "doc_id", "left_semi")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, out = part.column("doc_id").to_pylist(), []
            for i, text in zip(ids, texts(part), strict=True):
                x = chunks(text.encode())
                take = np.sort(np.random.default_rng(zlib.crc32(str(i).encode())).permutation(len(x))[:each])
                out.append(x[take].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "x"])

    # a doc_id that rows repeat counts once
    found = some.mapInArrow(cut, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    return [(np.frombuffer(bytes(x), np.uint8).reshape(-1, CHUNK), wanted[i]) for i, x in sorted((r.doc_id, r.x) for r in found)]


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, each: int = SAMPLE_CHUNKS) -> Net:
    """A net fitted on the driver to a bounded sample, see sampled()."""
    ready(docs.sparkSession)
    return Net().fit(sampled(docs, labels, size, each))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts, one row per row.

    Null texts score as empty ones; a null doc_id is not held out; repeated rows give repeated rows;
    other columns are not read. A net that saw no two labels gives one constant score.
    """
    ready(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = net.score([x.encode() for x in texts(part)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: Net) -> DataFrame:
    """The documents that the net predicts to be good, with all their columns, without a shuffle.

    Null and empty texts score as score() has them; null doc_ids and repeated rows are judged by their
    text; a text of any length is scored in chunks, all of them. An empty table stays empty.
    """
    ready(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(net.score([x.encode() for x in texts(part)]) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
