"""Language-model scores by a weighted backoff automaton.

Tokens are words [^\\x20\\x09-\\x0D]+ (A-Z lowered) and one end for each text. Counts come from ALL training texts:

* Words and n-grams, one order after another: every word, and every n-gram that occurs LEAST times, is kept at every
  size of the corpus. A word's key is its hash, that of an n-gram the hash of the keys of its first and of its last
  n - 1 words. Tasks hand on sorted counts cut into ranges of keys (buckets), which Spark brings together and adds up.
* From the counts N, V and, for every word, the base probability (c + 0.1) / (N + 0.1 * (V + 1)), known or not.

The automaton: kept contexts h are states. With S(h), the sum of the counts of the n-grams kept under h,
    P(w | h) = (c(h, w) + (MU + c(h) - S(h)) * P(w | h')) / (c(h) + MU),
h' being h without its first word and c(h, w) 0 where it isn't kept. So an arc weighs log10 P(w | h), the failure arc
log10 of (MU + c(h) - S(h)) / (c(h) + MU), and every state's probabilities add up to 1: what isn't kept goes to h'.
`Automaton` is that graph, gathered for a small model. The corpus is scored from the same counts without gathering them:

* Texts are taken in blocks of BLOCK bytes. A block asks for the distinct words and n-grams in it, as sorted keys cut
  by bucket; each bucket meets the counts (c, S) of its keys and answers in the keys' order; the answers
  meet the texts of the block, and each text is read from left to right with its counts at hand.
* What only saves work is bounded: words and n-grams with HOT of the training tokens or more (at most 1 / HOT of them an
  order) are broadcast with their counts, so that no key is asked for by more blocks than that; and a sieve of SIEVE
  bits for each order, set for kept keys, lets most places without a kept n-gram go unasked. As it fills up, more are
  asked for and have the count 0.

Keys have 64 bits: below 6e9 different words and n-grams less than one pair is expected to share a key.

Rows: null and empty texts are one end token. Null and repeated doc_ids are scored row by row. Without training texts N
and V are 0 and every token's probability is 1. The texts are read twice, to ask and to score; if they come in other
blocks the second time (a source that isn't the same when it is read again), scoring stops with an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import SPACED, bound_batches, ensure_checkpoint_dir, pieces, read, text_bytes, word_hashes, words_of
from tallygrid.llm.learning import remainder

ORDER, MU, EXTRA = 3, 20.0, 0.1
HOT, LEAST = 5e-7, 2
#: Bits of the sieve of an order, at most: 16 MB. There are 1 to 2 for each four bytes of text until then.
SIEVE = 1 << 27
#: Words or n-grams that a task holds before it hands their counts on.
HELD = 500_000
#: Bytes of the texts of a block, and of training texts for each bucket: they bound what a task holds at once.
BLOCK, BUCKET = 8 << 20, 6 << 20
END = b" "


END_KEY = np.uint64(0x5851F42D4C957F2D)


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts, each text's end after its words, and the place of each end."""
    keys, at = word_hashes(texts, SPACED)
    ends = at[1:] + np.arange(len(texts))
    out = np.full(len(keys) + len(texts), END_KEY)
    own = np.ones(len(out), dtype=bool)
    own[ends] = False
    out[own] = keys
    return out, ends


def _xxh(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    left = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (np.zeros(len(value), dtype=np.uint64) + seed + p5 + np.uint64(8)) ^ (left(value * p2, 31) * p1)
    h = left(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams, as xxHash64 chained over both keys."""
    return _xxh(last, _xxh(first, np.uint64(42)))


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Bits of the keys in a sieve of `size` bits, a power of 2: their first bits, so that a range of keys has a range of bits."""
    return (keys >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slots(keys, 8 * len(sieve))
    return (sieve[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _sieve(kept: DataFrame, size: int) -> np.ndarray:
    """Bits of the kept keys, packed: each bucket has those of its range."""
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in kept.select("at", "bits").toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[r["at"] : r["at"] + len(own)] |= own
    return out


def _orders(keys: np.ndarray, ends: np.ndarray, sieves: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each order from 2: first places, keys of the first and of the last words, and own keys, of n-grams whose parts pass the sieves. No context holds an end."""
    inside = np.ones(len(keys), dtype=bool)
    inside[ends] = False
    place = np.arange(len(keys))
    for sieve in sieves:
        ok = _passes(sieve, keys)
        place, keys = place[ok], keys[ok]
        at = np.flatnonzero(np.diff(place) == 1)
        at = at[inside[place[at]]]
        ctx, low = keys[at], keys[at + 1]
        place, keys = place[at], _joined(ctx, low)
        yield place, ctx, low, keys


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of the sorted x begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _packed(x: np.ndarray) -> bytes:
    """Eight-byte numbers, byte by byte: small numbers and sorted keys then compress. Bytes that are 0 in all of them are left out; the first byte says how many are there."""
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = max([k + 1 for k in range(8) if planes[k].any()], default=1)
    return bytes([used]) + planes[:used].tobytes()


def _unpacked(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in column]
    parts = [x[1:].reshape(int(x[0]), -1) for x in parts]
    out = np.zeros((sum(x.shape[1] for x in parts), 8), dtype=np.uint8)
    at = 0
    for x in parts:
        out[at : at + x.shape[1], : len(x)] = x.T
        at += x.shape[1]
    return out.view(kind).ravel()


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted keys that fall into each bucket."""
    own = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(own)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
        if b > a:
            yield int(own[a]), slice(a, b)


def _dealt(keys: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Sorted keys and what belongs to them, a row for each bucket."""
    parts = list(_by_bucket(keys, buckets))
    columns = {"keys": keys, **columns}
    return pa.record_batch([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([_packed(x[at]) for _, at in parts], pa.binary()) for x in columns.values())], names=["bucket", *columns])


def _summed(keys: np.ndarray, c: np.ndarray | None = None, ctx: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their counts (without c, one for each time) and contexts (without ctx, none)."""
    by = np.argsort(keys)
    keys = keys[by]
    at = _runs(keys)
    total = np.diff(at, append=len(keys)) if c is None else np.add.reduceat(c[by], at) if len(at) else c[:0]
    return keys[at], total, keys[:0] if ctx is None else ctx[by[at]]


def _count(shared, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, by bucket, of n-grams one word longer than there are sieves of shorter ones; without sieves, of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, c, ctx = _summed(keys, None, ctx)
            return _dealt(keys, {"c": c, "ctx": ctx}, buckets)

        for batch in batches:
            for a, b in pieces(batch.column(0)):
                keys, ends = _tokens(text_bytes(batch.column(0).slice(a, b - a)).to_pylist())
                ctx = np.zeros(len(keys), dtype=np.uint64)
                if sieves:
                    *_, (_, ctx, _, keys) = _orders(keys, ends, sieves)
                held.append((keys, ctx))
                if sum(len(x) for x, _ in held) > HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    return count


def _keep(least: int, size: int) -> Callable[[pa.Table], pa.Table]:
    """The keys of one bucket that occur `least` times, with the bits of those that occur LEAST times."""

    def keep(parts: pa.Table) -> pa.Table:
        keys, c, ctx = _summed(*(_unpacked(parts.column(x), kind) for x, kind in (("keys", np.uint64), ("c", np.int64), ("ctx", np.uint64))))
        keys, c, ctx = (x[c >= least] for x in (keys, c, ctx))
        slot = _slots(keys[c >= LEAST], size)
        at = int(slot[0] >> 3) if len(slot) else 0
        bits = np.zeros(8 * (int(slot[-1] >> 3) + 1 - at) if len(slot) else 0, dtype=np.uint8)
        bits[slot - 8 * at] = 1
        return pa.table(
            [parts.column("bucket").slice(0, 1), *(pa.array([_packed(x)], pa.binary()) for x in (keys, c, ctx)), pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(c.sum())], pa.int64())],
            names=["bucket", "keys", "c", "ctx", "at", "bits", "n_keys", "n"],
        )

    return keep


def _sum_up(parts: pa.Table) -> pa.Table:
    keys, c, _ = _summed(_unpacked(parts.column("keys"), np.uint64), _unpacked(parts.column("c")))
    return pa.table([parts.column("bucket").slice(0, 1), pa.array([_packed(keys)], pa.binary()), pa.array([_packed(c)], pa.binary())], names=["bucket", "keys", "c"])


def _name(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, low, word) of the words, and of the n-grams (word null) whose parts pass the sieves; low is the key without the first word."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                texts = text_bytes(batch.column(0).slice(a, b - a)).to_pylist()
                words = [w for text in texts for w in [*words_of(text, SPACED), END]]
                keys, ends = _tokens(texts)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], names=["key", "low", "word"])
                for _, _, low, own in _orders(keys, ends, shared.value):
                    yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(low.view(np.int64)), pa.nulls(len(own), pa.string())], names=["key", "low", "word"])

    return name


class Automaton:
    """States with arcs {word: (next state, log10 probability)}, failure arcs and their log10 weights; state 0 is the root.

    A view of a small model, gathered on the driver; the corpus is scored without it, to the same values.
    """

    def __init__(self, words: list, levels: list[list], n: int, v: int):
        """words: word, key, c; levels: arcs (ctx, low, key, c) of each order from 2. Keys are only names here."""
        p, count = {r["key"]: (r["c"] + EXTRA) / (n + EXTRA * (v + 1)) for r in words}, {r["key"]: r["c"] for r in words}
        self.base, self.unseen = {r["word"].encode(): math.log10(p[r["key"]]) for r in words}, math.log10(EXTRA / (n + EXTRA * (v + 1)))
        state = {h: k + 1 for k, h in enumerate(dict.fromkeys(r["ctx"] for arcs in levels for r in arcs))}
        self.arcs: list[dict[bytes, tuple[int, float]]] = [{} for _ in range(len(state) + 1)]
        self.fail, self.back = [0] * (len(state) + 1), [0.0] * (len(state) + 1)
        last, suffix = {r["key"]: r["word"].encode() for r in words}, {}

        def longest(key: int | None) -> int:
            while key is not None and key not in state:
                key = suffix.get(key)
            return 0 if key is None else state[key]

        for arcs in levels:
            for r in arcs:
                last[r["key"]], suffix[r["key"]], count[r["key"]] = last[r["low"]], r["low"], r["c"]
        self.arcs[0] = {r["word"].encode(): (longest(r["key"]), math.log10(p[r["key"]])) for r in words}
        for arcs in levels:
            kept: Counter = Counter()
            for r in arcs:
                kept[r["ctx"]] += r["c"]
            for h, s in kept.items():
                self.fail[state[h]], self.back[state[h]] = longest(suffix.get(h)), math.log10((MU + count[h] - s) / (MU + count[h]))
            for r in arcs:
                h = r["ctx"]
                p[r["key"]] = (r["c"] + (MU + count[h] - kept[h]) * p[r["low"]]) / (count[h] + MU)
                self.arcs[state[h]][last[r["key"]]] = (longest(r["key"]), math.log10(p[r["key"]]))

    def read(self, text: bytes | None) -> float:
        """log10 probability of a text: one traversal from left to right."""
        state, total = 0, 0.0
        for w in [*words_of(text, SPACED), END]:
            while state and w not in self.arcs[state]:
                state, total = self.fail[state], total + self.back[state]
            state, p = self.arcs[state].get(w, (0, self.unseen))
            total += p
        return total


class Model:
    """Counts of the training texts. kept has a table for each order from 1: (bucket, keys, c, ctx), packed, ctx being the
    keys of the contexts. n and v: tokens, and different ones."""

    def __init__(self, text: DataFrame, buckets: int, n: int, v: int, kept: list[DataFrame], sieves: list[np.ndarray]):
        self.text, self.buckets, self.n, self.v, self.kept, self.sieves = text, buckets, n, v, kept, sieves

    @cached_property
    def under(self) -> DataFrame:
        """(bucket, keys, c), packed: for each context the sum of the counts kept under it."""
        buckets = self.buckets

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    keys, c, _ = _summed(_unpacked(batch.column(0).slice(k, 1), np.uint64), _unpacked(batch.column(1).slice(k, 1)))
                    yield _dealt(keys, {"c": c}, buckets)

        own = self.kept[0].select("ctx", "c").where("false")
        for k in self.kept[1:]:
            own = own.unionByName(k.select("ctx", "c"))
        return _stored(own.mapInArrow(contexts, "bucket int, keys binary, c binary").groupBy("bucket").applyInArrow(_sum_up, "bucket int, keys binary, c binary"))

    @cached_property
    def often(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What has HOT of the training tokens, at most 1 / HOT keys an order: sorted keys, counts, and the sums kept under them."""
        least = HOT * self.n
        found = [_only(k, lambda _, c: c >= least) for k in self.kept]
        keys, c, _ = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        shared = self.text.sparkSession.sparkContext.broadcast(keys)
        contexts, s = _only(self.under, lambda own, _: _at(shared.value, own) >= 0)
        under = np.zeros(len(keys), dtype=np.int64)
        under[_at(keys, contexts)] = s
        return keys, c, under

    @cached_property
    def automaton(self) -> Automaton:
        shared = self.text.sparkSession.sparkContext.broadcast(self.sieves[:-1])
        names = self.text.mapInArrow(_name(shared), "key long, low long, word string").distinct().collect()
        words, low = {r["key"]: r["word"] for r in names if r["word"] is not None}, {r["key"]: r["low"] for r in names}
        levels = []
        for k in self.kept:
            keys, c, ctx = (_unpacked(pa.array([bytes(r[x]) for r in rows], pa.binary())).tolist() for rows in [k.collect()] for x in ("keys", "c", "ctx"))
            levels.append([{"key": a, "c": n, "ctx": h, "low": low[a], "word": words.get(a)} for a, n, h in zip(keys, c, ctx, strict=True)])
        return Automaton(levels[0], levels[1:], self.n, self.v)


def _only(packed: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of a packed table that `keep` picks, on the driver."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, c = _unpacked(batch.column(0), np.uint64), _unpacked(batch.column(1))
            ok = keep(keys, c)
            yield pa.record_batch([pa.array([_packed(x[ok])], pa.binary()) for x in (keys, c)], names=["keys", "c"])

    found = packed.select("keys", "c").mapInArrow(pick, "keys binary, c binary").toArrow()
    return _unpacked(found.column("keys"), np.uint64), _unpacked(found.column("c"))


def _stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder: a third of the bytes of a checkpoint. Its shuffle files go at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/lm-{uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fit(training: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of `training` (column text)."""
    spark = training.sparkSession
    bound_batches(spark)
    text = training.select("text")
    size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, bits = max(1, math.ceil(size / BUCKET)), min(SIEVE, max(1 << 15, 1 << (size // 4).bit_length()))
    kept: list[DataFrame] = []
    sieves: list[np.ndarray] = []
    n = v = 0
    for k in range(order):
        shared = spark.sparkContext.broadcast(list(sieves))
        parts = text.mapInArrow(_count(shared, buckets), "bucket int, keys binary, c binary, ctx binary").groupBy("bucket")
        kept.append(_stored(parts.applyInArrow(_keep(LEAST if k else 1, bits), "bucket int, keys binary, c binary, ctx binary, at int, bits binary, n_keys long, n long")))
        shared.destroy()
        if not k:
            n, v = kept[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
        sieves.append(_sieve(kept[-1], bits))
    return Model(text, buckets, n, v, [k.select("bucket", "keys", "c", "ctx") for k in kept], sieves)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (doc_id, text) of a partition with the number of their block: it changes where BLOCK bytes of texts have gone by."""
    from pyspark import TaskContext

    first, gone = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = (gone + np.cumsum(sizes) - sizes) // BLOCK
        gone += int(sizes.sum())
        edges = (np.flatnonzero(np.diff(own)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
            if b > a:
                yield first + int(own[a]), batch.slice(a, b - a)


def _places(texts: list[bytes | None], sieves: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of the texts' ends, and for each order the last places and keys of words and of n-grams that pass the sieves."""
    keys, ends = _tokens(texts)
    out = [(np.arange(len(keys)), keys)]
    for k, ((place, _, _, own), sieve) in enumerate(zip(_orders(keys, ends, sieves[:-1]), sieves[1:], strict=True), 1):
        ok = _passes(sieve, own)
        out.append((place[ok] + k, own[ok]))
    return ends, out


def _at(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted `known`, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    own = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *keys]))
    return own[_runs(own)]


def _to_ask(text: pa.Array, known: np.ndarray, sieves: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each piece of the texts, the distinct keys that are not in `known`."""
    for a, b in pieces(text):
        keys = _distinct([x for _, x in _places(text_bytes(text.slice(a, b - a)).to_pylist(), sieves)[1]])
        yield keys[_at(known, keys) < 0]


def _ask(shared, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the texts of each block have to look up: sorted keys, by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, _, _), sieves = shared.value
        held: list[np.ndarray] = []
        block = None

        def asked() -> pa.RecordBatch:
            own = _dealt(_distinct(held), {}, buckets)
            return own.append_column("block", pa.array(np.full(own.num_rows, block)))

        for own, batch in _blocks(batches):
            if held and own != block:
                yield asked()
                held = []
            block = own
            held += _to_ask(batch.column(1), known, sieves)
        if held:
            yield asked()

    return ask


def _answer(asked: pa.Table, cells: pa.Table) -> pa.Table:
    """Counts of the asked keys of one bucket, and the sums kept under them, in the keys' order, with a check of the keys."""
    tables = []
    for kind in (0, 1):
        own = cells.filter(pc.equal(cells.column("kind"), kind))
        keys = _unpacked(own.column("keys"), np.uint64)
        by = np.argsort(keys)
        tables.append((keys[by], np.append(_unpacked(own.column("c"))[by], 0)))
    checks, answers = [], []
    for k in range(asked.num_rows):
        own = _unpacked(asked.column("keys").slice(k, 1), np.uint64)
        checks.append(int(np.bitwise_xor.reduce(own).view(np.int64)))
        answers.append([_packed(c[_at(keys, own)]) for keys, c in tables])
    return pa.table([asked.column("block"), asked.column("bucket"), pa.array(checks, pa.int64()), *(pa.array([a[k] for a in answers], pa.binary()) for k in (0, 1))], names=["block", "bucket", "check", "c", "s"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch in _blocks(batches):
        yield pa.record_batch([pa.array(np.full(batch.num_rows, block)), *batch.columns], names=["block", "doc_id", "text"])


def _read(texts: list[bytes | None], tables: list[tuple[np.ndarray, ...]], sieves: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base and score of each text. tables: sorted keys, counts and sums kept under them."""
    ends, orders = _places(texts, sieves)
    size = int(ends[-1]) + 1
    inside = np.ones(size, dtype=bool)
    inside[ends] = False
    c, s, p = np.zeros(size), np.zeros(size), None
    for place, keys in orders:
        by = np.argsort(keys)
        first = _runs(keys[by])
        distinct, own = keys[by[first]], np.zeros((2, len(first)))
        for known, *values in tables:
            at = _at(known, distinct)
            own[:, at >= 0] = [x[at[at >= 0]] for x in values]
        before_c, before_s = (np.concatenate([[0.0], (x * inside)[:-1]]) for x in (c, s))
        c, s = np.zeros(size), np.zeros(size)
        c[place[by]], s[place[by]] = np.repeat(own, np.diff(first, append=len(by)), axis=1)
        if p is None:
            p = (c + EXTRA) / (n + EXTRA * (v + 1))
            seen, base = c > 0, np.log10(p)
        else:
            p = (c + (MU + before_c - before_s) * p) / (MU + before_c)
    start = np.concatenate([[0], ends[:-1] + 1])
    return np.diff(ends, prepend=-1), *(np.add.reduceat(x, start) for x in (seen.astype(np.int64), base, np.log10(p)))


def _reader(shared, buckets: int, n: int, v: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of the texts of one block."""

    def read_block(rows: pa.Table, answers: pa.Table) -> pa.Table:
        (known, *often), sieves = shared.value
        texts = [x for x in rows.column("text").chunks if len(x)]
        asked = _distinct([x for text in texts for x in _to_ask(text, known, sieves)])
        answers = answers.sort_by("bucket")
        checks = [(b, int(np.bitwise_xor.reduce(asked[x]).view(np.int64))) for b, x in _by_bucket(asked, buckets)]
        if checks != list(zip(answers.column("bucket").to_pylist(), answers.column("check").to_pylist(), strict=True)):
            raise RuntimeError("the texts came in other blocks than before: write them out before they are scored")
        tables = [(asked, *(_unpacked(answers.column(x)) for x in ("c", "s"))), (known, *often)]
        found = [_read(text_bytes(text.slice(a, b - a)).to_pylist(), tables, sieves, n, v) for text in texts for a, b in pieces(text)]
        sums = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table([rows.column("doc_id"), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return read_block


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.often, model.sieves))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = rows.mapInArrow(_ask(shared, model.buckets), "bucket int, keys binary, block long")
    cells = model.under.select("bucket", F.lit(1).alias("kind"), "keys", "c")
    for k in model.kept:
        cells = cells.unionByName(k.select("bucket", F.lit(0).alias("kind"), "keys", "c"))
    answers = _stored(asked.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(_answer, "block long, bucket int, check long, c binary, s binary"))
    blocks = rows.mapInArrow(_label, "block long, doc_id long, text string")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reader(shared, model.buckets, model.n, model.v), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 10) != 0))
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
