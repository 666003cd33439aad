"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (A-Z lowered) and their PREFIX-byte beginnings, hashed to BUCKETS. The model is
    bias + sum(w[t]) + 1/2 * sum_f((sum(v[t, f]))**2 - sum(v[t, f]**2)),
over the terms t of a text: linear weights, and RANK factors a term whose inner products weigh pairs of terms that
occur together, such as an insult and a group that it is aimed at. (Rendle 2010.) It is fitted by AdaGrad on logistic
loss, with numpy, on SAMPLE labelled rows at most; the weights that aren't zero are broadcast. All whole texts are scored in
one narrow pass.

Terms that get a weight are those that tell by themselves and those that tell in a pair. Pairs are looked at among all terms
that one row in a hundred or more has, in blocks of BLOCK by BLOCK terms, a task for each pair of GROUPS groups of blocks. The
sample stays on the executors: the driver gets counts of terms, then the sample's rows with the terms that get a weight.

Rows: null and empty texts have no terms and get the model's bias, very long ones are scored whole. Null and repeated doc_ids
are scored row by row; null ones are never learnt from. Without any label, as with empty tables, the score is 0.5 less a
hair, so that nothing is rejected. A column of docs named like the score is replaced, others stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import ALNUM, bound_batches, pieces, read, text_bytes, word_hashes
from tallygrid.llm.learning import SAMPLE, labelled, remainder

BITS, RANK, PREFIX, THRESHOLD = 18, 8, 5, 0.5
#: Standard errors of what tells by itself, and of what tells in pairs; terms of a block whose pairs are looked at together.
SCREEN, PAIR, BLOCK = 4.0, 6.0, 512
#: Groups of blocks, more if one would have over WIDE terms; each goes to as many tasks as there are groups.
GROUPS, WIDE = 5, 1 << 15
#: How much more a toxic row weighs in the loss than another, as a missed one costs more.
WEIGHT = 4.0
BUCKETS = 1 << BITS
SCORE = "toxicity"


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text, one text after another, and len(texts)+1 offsets."""
    words, at, starts = word_hashes(texts, ALNUM, PREFIX)
    row = np.repeat(np.arange(len(texts)), np.diff(at)) << BITS
    shift = np.uint64(64 - BITS)
    both = np.concatenate([row | (words >> shift).astype(np.int64), row | ((starts * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)])
    both = np.unique(both)
    return both & (BUCKETS - 1), np.searchsorted(both, np.arange(len(texts) + 1) << BITS)


def segments(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between offsets; 0 for empty ranges."""
    sums = np.zeros((len(at) - 1, *x.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        sums[full] = np.add.reduceat(x, at[:-1][full], axis=0)
    return sums


def screen(d1: np.ndarray, d0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Terms whose share of the n1 toxic and the n0 other rows (d1 and d0 rows have them) differs by SCREEN standard errors."""
    n1, n0 = max(1.0, n1), max(1.0, n0)
    share = (d1 + d0) / (n1 + n0)
    return (d1 + d0 >= 3) & (np.abs(d1 / n1 - d0 / n0) >= SCREEN * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12))


def counted_terms(d: np.ndarray, n: float) -> np.ndarray:
    """Terms in one to 99 of a hundred rows: those whose pairs are looked at, however many there are."""
    return np.flatnonzero((d >= 0.01 * n) & (d <= 0.99 * n) & (d > 0))


def by_class(t: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows' terms and offsets with the toxic rows first, and their number."""
    order = np.argsort(y <= 0, kind="stable")
    sizes = np.diff(at)[order]
    ends = np.cumsum(sizes)
    own = t[np.repeat(at[:-1][order] - (ends - sizes), sizes) + np.arange(len(t))] if len(t) else t
    return own, np.concatenate([[0], ends]), int((y > 0).sum())


def paired(t: np.ndarray, at: np.ndarray, n1: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the terms a and b that interact, one of a with one of b: pairs whose log odds ratio in the first n1 rows, the
    toxic ones, differs from that in the others by PAIR standard errors. Such terms may have no share that tells by itself."""
    places = []
    for own in (a, b):
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[own] = np.arange(len(own))
        places.append(place)
    odds = []
    for first, last in ((0, n1), (n1, len(at) - 1)):
        both, ones = np.zeros((len(a), len(b))), [np.zeros(len(a)), np.zeros(len(b))]
        for k in range(first, last, 1024):
            stop = min(k + 1024, last)
            terms, row, x = t[at[k] : at[stop]], np.repeat(np.arange(stop - k), np.diff(at[k : stop + 1])), []
            for place, one in zip(places, ones, strict=True):
                p = place[terms]
                held = np.zeros((stop - k, len(one)), dtype=np.float32)
                held[row[p >= 0], p[p >= 0]] = 1
                one += held.sum(axis=0)
                x.append(held)
            both += x[0].T @ x[1]
        n, one, other = last - first, ones[0][:, None], ones[1][None, :]
        cells = [both, one - both, other - both, n - one - other + both]
        odds.append((np.log((cells[0] + 0.5) * (cells[3] + 0.5) / ((cells[1] + 0.5) * (cells[2] + 0.5))), sum(1 / (c + 0.5) for c in cells)))
    gap = np.abs(odds[0][0] - odds[1][0]) / np.sqrt(odds[0][1] + odds[1][1])
    gap[a[:, None] == b[None, :]] = 0
    hit = gap >= PAIR
    return np.concatenate([a[hit.any(axis=1)], b[hit.any(axis=0)]])


def parts(terms: np.ndarray) -> list[np.ndarray]:
    return [terms[k : k + BLOCK] for k in range(0, len(terms), BLOCK)]


def blocks(terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of terms in a pair of blocks of BLOCK terms."""
    own = parts(terms)
    return [(x, y) for k, x in enumerate(own) for y in own[k:]]


def all_paired(t: np.ndarray, at: np.ndarray, y: np.ndarray, terms: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """The interacting terms of all pairs of `terms`: block by block here, or with a session in tasks."""
    if spark is None:
        rows = by_class(t.astype(np.int32), at, y)
        found = [paired(*rows, a, b) for a, b in blocks(terms)]
        return np.unique(np.concatenate([*found, terms[:0]])).astype(np.int64)
    return paired_in_tasks(spark.createDataFrame(pa.table({"y": pa.array(y > 0).cast(pa.int32()), "t": packed(t, at)})), terms)


def packed(t: np.ndarray, at: np.ndarray, kind: type = np.int32) -> pa.Array:
    """Each row's terms as integers of one size."""
    t = t.astype(kind)
    return pa.array([t[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def unpacked(table: pa.RecordBatch | pa.Table, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, terms and offsets of rows (y, t)."""
    own = [np.frombuffer(x, dtype=kind) for x in table.column(1).to_pylist()]
    return table.column(0).to_numpy(zero_copy_only=False), np.concatenate([*own, np.empty(0, kind)]), np.cumsum([0, *map(len, own)])


def paired_in_tasks(rows: DataFrame, terms: np.ndarray) -> np.ndarray:
    """The interacting terms of all pairs of `terms` in rows (y, t). A pair of groups of terms is a task's; it gets all rows
    with their terms of the two groups, two bytes each."""
    if not len(terms):
        return terms
    size = BLOCK * math.ceil(min(len(terms) / GROUPS, WIDE) / BLOCK)
    groups = [terms[k : k + size] for k in range(0, len(terms), size)]
    pairs = [(a, b) for a in range(len(groups)) for b in range(a, len(groups))]
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[np.concatenate(shared.value)] = np.arange(sum(map(len, shared.value)))
        for batch in batches:
            y, t, at = unpacked(batch)
            own, out = place[t], []
            group = np.where(own < 0, -1, own // size)
            for a, b in pairs:
                keep = (group == a) | (group == b)
                sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[at]).astype(np.int32)
                out.append(((own[keep] - size * np.where(group[keep] == a, a, b - 1)).astype(np.uint16).tobytes(), sizes.tobytes()))
            n = len(out)
            cols = [pa.array(range(n), pa.int32()), pa.array([(y > 0).astype(np.int8).tobytes()] * n, pa.binary()), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))]
            yield pa.record_batch(cols, names=["pair", "y", "t", "sizes"])

    def look(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = (shared.value[k] for k in pairs[key[0].as_py()])
        y, t, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=d) for c, d in (("y", np.int8), ("t", np.uint16), ("sizes", np.int32)))
        both = (a if a is b else np.concatenate([np.pad(a, (0, size - len(a))), b])).astype(np.int32)
        own = by_class(both[t], np.concatenate([[0], np.cumsum(sizes)]), y)
        jobs = blocks(a) if a is b else [(v, w) for v in parts(a) for w in parts(b)]
        return pa.table({"term": np.unique(np.concatenate([paired(*own, *x) for x in jobs])).astype(np.int64)})

    dealt = rows.mapInArrow(deal, "pair int, y binary, t binary, sizes binary").repartition(4 * len(pairs), "pair")
    found = dealt.groupBy("pair").applyInArrow(look, "term long").distinct().toArrow()  # BUCKETS rows at most
    shared.destroy()
    return np.sort(found.column("term").to_numpy())


class Machine:
    def __init__(self, rank: int = RANK, seed: int = 7):
        self.bias, self.w, self.v = 0.0, np.zeros(BUCKETS, dtype=np.float32), np.empty((BUCKETS, rank), dtype=np.float32)
        rng = np.random.default_rng(seed)
        for k in range(0, BUCKETS, 1 << 14):
            self.v[k : k + (1 << 14)] = rng.normal(0, 0.01, (1 << 14, rank))

    def __getstate__(self) -> tuple:
        """The terms that have weights, and those."""
        own = np.flatnonzero((self.w != 0) | self.v.any(axis=1))
        return self.bias, own, self.w[own], self.v[own]

    def __setstate__(self, state: tuple) -> None:
        self.bias, own, w, v = state
        self.w, self.v = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, v.shape[1]), dtype=np.float32)
        self.w[own], self.v[own] = w, v

    def margin(self, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.v[t]
        total = segments(own, at)
        pairs = 0.5 * ((total**2).sum(axis=1) - segments((own**2).sum(axis=1), at))
        return self.bias + segments(self.w[t], at) + pairs, total

    def scores(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(t, at)[0], -30, 30)))

    def fit(self, t: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 0.1, decay: float = 2e-4, weight: float = WEIGHT, seed: int = 11, pairs: np.ndarray | None = None) -> Machine:
        """Only terms that tell by themselves (`screen`) or with another one (`paired`) get weights; the rest stay at zero, so
        that the many neutral terms of a long text can't outweigh a few telling ones. pairs: those that interact, if known."""
        rng, n = np.random.default_rng(seed), len(y)
        toxic, n1 = np.repeat(y > 0, np.diff(at)), float((y > 0).sum())
        d1, d0 = np.bincount(t[toxic], minlength=BUCKETS), np.bincount(t[~toxic], minlength=BUCKETS)
        seen = screen(d1, d0, n1, n - n1)
        pairs = all_paired(t, at, y, counted_terms(d1 + d0, n)) if pairs is None else pairs
        self.v[pairs] *= 10
        seen[pairs] = True
        self.v[~seen] = 0
        self.bias = float(np.log((weight * y.sum() + 0.5) / (n - y.sum() + 0.5)))
        gw, gv = np.full(BUCKETS, 1e-2, dtype=np.float32), np.full(self.v.shape, 1e-2, dtype=np.float32)
        for _ in range(epochs):
            order = rng.permutation(n)
            for k in range(0, n, batch):
                rows = order[k : k + batch]
                own = np.concatenate([t[at[r] : at[r + 1]] for r in rows])
                sizes = at[rows + 1] - at[rows]
                keep, which = seen[own], np.repeat(np.arange(len(rows)), sizes)
                own, which = own[keep], which[keep]
                off = np.searchsorted(which, np.arange(len(rows) + 1))
                margin, total = self.margin(own, off)
                miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) * np.where(y[rows] > 0, weight, 1) / len(rows)
                used, back = np.unique(own, return_inverse=True)
                dw = np.bincount(back, weights=miss[which], minlength=len(used)).astype(np.float32) + decay * self.w[used]
                dv = miss[which][:, None] * (total[which] - self.v[own])
                order_v = np.argsort(back, kind="stable")
                dv = np.add.reduceat(dv[order_v], np.searchsorted(back[order_v], np.arange(len(used))), axis=0) + decay * self.v[used] if len(used) else dv
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
                self.bias -= rate * 0.1 * float(miss.sum())
        return self


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            yield pa.record_batch([part.column(2), packed(*terms(text_bytes(part.column(1)).to_pylist()))], names=["y", "t"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that have a term, and (bucket BUCKETS) rows of each class."""
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for y, t, at in map(unpacked, batches):
        for k in (0, 1):
            counts[k] += np.bincount(t[np.repeat(y == k, np.diff(at))], minlength=BUCKETS + 1)
            counts[k, BUCKETS] += np.count_nonzero(y == k)
    own = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(own, pa.int32()), pa.array(counts[0, own]), pa.array(counts[1, own])], names=["term", "d0", "d1"])


def _only(shared, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows with the wanted terms only, as their places among those."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            _, t, at = unpacked(batch)
            own = place[t]
            yield pa.record_batch([batch.column(0), packed(own[own >= 0], np.concatenate([[0], np.cumsum(own >= 0)])[at], kind)], names=["y", "t"])

    return send


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """The machine of the labelled sample. Its rows are kept on the executors as packed terms, and come to the driver with
    those terms only that get a weight: a count of BUCKETS rows at most and the pairs found in tasks have picked them."""
    spark = docs.sparkSession
    bound_batches(spark)
    sample = labelled(docs, labels, "toxic", rows).mapInArrow(_pack, "y int, t binary").persist()
    counts = sample.mapInArrow(_term_counts, "term int, d0 long, d1 long").groupBy("term").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).toArrow()
    d = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for k in (0, 1):
        d[k, counts.column("term").to_numpy()] = counts.column(f"d{k}").to_numpy()
    n0, n1 = d[:, BUCKETS].tolist()
    d = d[:, :BUCKETS]
    pairs = paired_in_tasks(sample, counted_terms(d.sum(axis=0), n0 + n1))
    wanted = np.union1d(np.flatnonzero(screen(d[1], d[0], n1, n0)), pairs)
    shared, kind = spark.sparkContext.broadcast(wanted), np.uint16 if len(wanted) <= 1 << 16 else np.int32
    y, t, at = unpacked(sample.mapInArrow(_only(shared, kind), "y int, t binary").toArrow(), kind)
    shared.destroy()
    sample.unpersist()
    if not len(y):
        out = Machine()
        out.bias, out.v = -1e-6, np.zeros_like(out.v)
        return out
    return Machine().fit(wanted[t].astype(np.int32), at, y.astype(np.float64), pairs=pairs)


def _scorer(shared, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(text_at)):
                part = batch.slice(a, b - a)
                found = shared.value.scores(*terms(text_bytes(part.column(text_at)).to_pylist()))
                yield pa.record_batch([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, SCORE])

    return score_batches


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """docs with a column `toxicity`, from 0 to 1; one of that name is replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(SCORE)
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model), docs.columns.index("text")), T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def reject_toxic(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with its columns, without rows that score `threshold` or more."""
    return score(docs, model).where(F.col(SCORE) < threshold).drop(SCORE)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
