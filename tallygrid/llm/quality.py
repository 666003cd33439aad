"""Quality by random-indexing word vectors, pooled for each document, and a two-layer network in numpy.

Tokens are runs of letters and digits, and runs of punctuation, hashed to WORDS buckets. Every bucket has a fixed sparse
random index vector of +1 and -1 (Sahlgren 2005). A bucket's context vector is the sum of the index vectors of the tokens
up to REACH places before and after it, over ALL documents: each task adds up its own WORDS x WIDTH integers, Spark adds
the tasks' rows by bucket, exactly and in any order. What comes back is a table of fixed size.

A document is the mean of its tokens' unit vectors (context beside index), with the log of its length and its share of
distinct tokens. A two-layer network (tanh, Adam) learns the label from SAMPLE labelled rows at most; one in five of them
is set aside to fit one temperature, by which the logits are divided so that scores are probabilities.

Rows: null and empty texts pool to a zero vector and get its score. Without labels every score is 0.5. Null and repeated
doc_ids are scored row by row; null ones are never learnt from. Without documents all context vectors are zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import bound_batches, fold_table, pieces, read, text_bytes, word_hashes
from tallygrid.llm.learning import SAMPLE, labelled, remainder
from tallygrid.llm.toxicity import segments

BITS, WIDTH, NONZERO, REACH, HIDDEN, THRESHOLD = 16, 32, 4, 2, 32, 0.3
WORDS = 1 << BITS
SCORE = "quality"
_TABLE = fold_table(b" \t\n\x0b\x0c\r")
#: 0 blank, 1 letters and digits, 2 other ASCII.
_KINDS = np.array([0 if c == 32 else 1 if c > 127 or chr(c).isalnum() else 2 for c in range(256)], dtype=np.int8)


def index_vectors(seed: int = 2005) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS, WIDTH), dtype=np.int8)
    places = rng.permuted(np.tile(np.arange(WIDTH), (WORDS, 1)), axis=1)[:, :NONZERO]
    out[np.arange(WORDS)[:, None], places] = rng.choice(np.array([-1, 1], dtype=np.int8), (WORDS, NONZERO))
    return out


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = word_hashes(texts, _TABLE, kinds=_KINDS)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32), at


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), np.zeros((WORDS, WIDTH), dtype=np.int64)
    seen = np.zeros(WORDS, dtype=bool)
    for batch in batches:
        for a, b in pieces(batch.column(0)):
            ids, at = tokens(text_bytes(batch.column(0).slice(a, b - a)).to_pylist())
            if not len(ids):
                continue
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            around, own = np.zeros((len(ids), WIDTH), dtype=np.int8), index[ids]
            for k in range(1, REACH + 1):
                same = (row[k:] == row[:-k])[:, None]
                around[k:] += own[:-k] * same
                around[:-k] += own[k:] * same
            order = np.argsort(ids, kind="stable")
            used, first = np.unique(ids[order], return_index=True)
            total[used] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
            seen[used] = True
    used = np.flatnonzero(seen)
    cols = [pa.array(used, pa.int32()), *(pa.array(total[used, k], pa.int64()) for k in range(WIDTH))]
    yield pa.record_batch(cols, names=["word", *(f"d{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS x 2*WIDTH: unit context vectors of all documents, beside unit index vectors."""
    bound_batches(docs.sparkSession)
    dims = [f"d{k}" for k in range(WIDTH)]
    parts = docs.select("text").mapInArrow(_contexts, "word int, " + ", ".join(f"{d} long" for d in dims))
    rows = parts.groupBy("word").agg(*(F.sum(d).alias(d) for d in dims)).orderBy("word").toArrow()
    context = np.zeros((WORDS, WIDTH))
    context[rows.column("word").to_numpy()] = np.column_stack([rows.column(d).to_numpy() for d in dims]) if rows.num_rows else 0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([unit(context), unit(index_vectors().astype(float))]).astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    ids, at = tokens(texts)
    own, n = vectors[ids], np.diff(at)
    size = np.maximum(1, n)[:, None]
    distinct = np.diff(np.searchsorted(np.unique((np.repeat(np.arange(len(n)), n) << BITS) | ids), np.arange(len(n) + 1) << BITS))
    return np.hstack([segments(own, at) / size, np.log1p(n)[:, None] / 10, (distinct / size[:, 0])[:, None]])


class Network:
    """Two layers, and the temperature that its logits are divided by."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2, self.temperature = np.zeros(HIDDEN), 0.0, 1.0
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if aside.all() or not aside.any():
            aside[:] = np.arange(len(y)) % 5 == 0
        train, held = np.flatnonzero(~aside), np.flatnonzero(aside)
        if not len(train):
            return self
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        names = ("w1", "b1", "w2", "b2")
        moments, step = {k: [0.0, 0.0] for k in names}, 0
        for _ in range(epochs):
            order = rng.permutation(train)
            for k in range(0, len(order), batch):
                rows, step = order[k : k + batch], step + 1
                z = (x[rows] - self.mean) / self.scale
                h = np.tanh(z @ self.w1 + self.b1)
                miss = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[rows]) / len(rows)
                back = np.outer(miss, self.w2) * (1 - h**2)
                for name, g in zip(names, (z.T @ back + 1e-4 * self.w1, back.sum(axis=0), h.T @ miss + 1e-4 * self.w2, miss.sum()), strict=True):
                    m = moments[name]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
                    setattr(self, name, getattr(self, name) - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        logits, truth = (self.logits(x[held]), y[held]) if len(held) else (self.logits(x[train]), y[train])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _pool(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pool_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                x = pooled(text_bytes(part.column(1)).to_pylist(), shared.value)
                yield pa.record_batch([part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    return pool_batches


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, rows: int = SAMPLE) -> Network:
    spark = docs.sparkSession
    sample = labelled(docs, labels, "quality", rows).mapInArrow(_pool(spark.sparkContext.broadcast(vectors)), "y int, x binary").toArrow()
    out = Network(vectors.shape[1] + 2)
    if not sample.num_rows:
        return out
    x = np.array([np.frombuffer(r) for r in sample.column("x").to_pylist()])
    return out.fit(x, sample.column("y").to_numpy().astype(np.float64))


def _scorer(shared, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for a, b in pieces(batch.column(text_at)):
                part = batch.slice(a, b - a)
                found = network.scores(pooled(text_bytes(part.column(text_at)).to_pylist(), vectors))
                yield pa.record_batch([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, SCORE])

    return score_batches


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """docs with a column `quality`, from 0 to 1; one of that name is replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(SCORE)
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast((vectors, network)), docs.columns.index("text")), T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    found = score(docs.select("doc_id", "text"), vectors, train(docs, read(spark, sf_dir, "labels"), vectors))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
