"""Document fingerprints by prefix polynomial hashes.

A text's prefix array holds, for every i, sum(c[j] * B**j for j < i) modulo a prime, c being its code points, under two
bases. Two looks into the arrays and one multiplication compare any two spans, whatever their places; binary search over
them finds the longest common extension from two places, forwards or backwards.

The likeness of two fingerprints is (common prefix + common suffix + shared) / longer length, at most 1. Prefix and suffix
come by binary search. Of what lies between them, shared counts the code points inside spans of SPAN that stand anywhere
between the other's prefix and suffix too, in the text that has fewer of them: several edits and moved passages leave the
rest alike, without a limit on their number. The string form is the length, the hash of the whole text and the hashes of GRID prefixes at multiples of a power of two,
so that stored fingerprints still show how far two texts agree (`common_prefix`).

Each document meets the next in ascending doc_id as neighbours in a sorted stream: ids are cut into ranges at ids of a
bounded sample, so the first row of each range is known beforehand and is sent to the range before it as well.
Rows without an id are cut into ranges of their own by a hash of their texts. Ranges hold about RANGE_ROWS rows, up to
RANGES of them. Texts are shuffled once; a task holds two texts at a time.

Rows: null texts count as empty. A null doc_id comes before all others. Rows that share a doc_id, or have none, follow each
other in the order of a hash of their texts. A single row is its own next document. Empty texts are like each other and unlike all else.
Very long texts are hashed whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import bound_batches, pieces, read

PRIME, BASES, GRID, SPAN, RANGE_ROWS, RANGES, SAMPLED = (1 << 31) - 1, (1_000_003, 724_655_953), 32, 32, 1000, 100_000, 20
_INVERSES = {base: pow(base, -1, PRIME) for base in BASES}
_P = np.uint64(PRIME)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), PRIME)) % _P])
        if len(have) <= 1 << 21:
            _TABLES[base] = have
    return have


class PrefixHashes:
    """Prefix arrays of a sequence of code points."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays, self.n = arrays, len(arrays[0]) - 1
        self.all_spans: np.ndarray | None = None

    @staticmethod
    def of(codes: np.ndarray) -> PrefixHashes:
        return PrefixHashes([np.zeros(1, dtype=np.uint64)] * 2).edited(0, codes)

    def edited(self, keep: int, tail: np.ndarray) -> PrefixHashes:
        """Those of the first `keep` code points followed by `tail`; only the tail is worked on."""
        out = []
        for base, own in zip(BASES, self.arrays, strict=True):
            terms = (tail + np.uint64(1)) * _powers(base, keep + len(tail))[keep : keep + len(tail)] % _P
            out.append(np.concatenate([own[: keep + 1], (own[keep] + np.cumsum(terms, dtype=np.uint64)) % _P]))
        return PrefixHashes(out)

    def equal(self, i: int, other: PrefixHashes, j: int, n: int) -> bool:
        """Whether the spans of n from i and j on are equal; the one that stands earlier is shifted to the other's place."""
        for base, own, its in zip(BASES, self.arrays, other.arrays, strict=True):
            a, b = int(own[i + n]) - int(own[i]), int(its[j + n]) - int(its[j])
            if i != j:
                a, b = (a * pow(base, j - i, PRIME), b) if i < j else (a, b * pow(base, i - j, PRIME))
            if (a - b) % PRIME:
                return False
        return True

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Longest n with equal spans of n from i and j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, i: int, other: PrefixHashes, j: int) -> int:
        """Longest n with equal spans of n up to i and j."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def spans(self, start: int, stop: int) -> np.ndarray:
        """Hashes of all spans of SPAN from start to stop, whatever their places."""
        n, both = max(0, stop - start - SPAN + 1), []
        if self.all_spans is not None:
            return self.all_spans[start : start + n]
        if 2 * n > self.n and n <= self.n - SPAN:
            self.all_spans = self.spans(0, self.n)
            return self.all_spans[start : start + n]
        for base, own in zip(BASES, self.arrays, strict=True):
            both.append((own[start + SPAN : start + SPAN + n] + _P - own[start : start + n]) * _powers(_INVERSES[base], start + n)[start : start + n] % _P)
        return both[0] << np.uint64(31) | both[1]

    def likeness(self, other: PrefixHashes) -> float:
        longest, shortest = max(self.n, other.n), min(self.n, other.n)
        if not longest:
            return 1.0
        first = self.extension(0, other, 0)
        last = min(self.extension_back(self.n, other, other.n), shortest - first)
        shared = _shared(self.spans(first, self.n - last), other.spans(first, other.n - last)) if shortest - first - last >= SPAN else 0
        return (first + last + shared) / longest

    def step(self) -> int:
        return 1 << max(0, (-(-self.n // GRID) - 1).bit_length())

    def text(self) -> str:
        step = self.step()
        mixed = (self.arrays[0] << np.uint64(31) | self.arrays[1])[[self.n, *range(step, self.n + 1, step)]]
        grid = (mixed[1:] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(">u4")
        return f"{self.n}:{int(mixed[0]):016x}:{grid.tobytes().hex()}"


def _shared(own: np.ndarray, its: np.ndarray) -> int:
    """Code points inside the spans that both have, in the one that has fewer of them."""
    both = np.sort(np.concatenate([own, its]))
    twice = np.unique(both[1:][both[1:] == both[:-1]])
    if not len(twice):
        return 0
    hits = np.isin(own, twice), np.isin(its, twice)
    common = np.intersect1d(own[hits[0]], its[hits[1]])
    return min(_covered(np.flatnonzero(hit)[np.isin(spans[hit], common)]) for spans, hit in zip((own, its), hits, strict=True))


def _covered(places: np.ndarray) -> int:
    """Code points inside the spans from these places on."""
    return int(np.minimum(np.diff(places, append=places[-1] + SPAN), SPAN).sum()) if len(places) else 0


def common_prefix(a: str, b: str) -> int:
    """Code points, as far as their grids tell, that two fingerprint strings share from the start."""
    (na, ha, ga), (nb, hb, gb) = a.split(":"), b.split(":")
    if (na, ha) == (nb, hb):
        return int(na)
    steps = [1 << max(0, (-(-int(n) // GRID) - 1).bit_length()) for n in (na, nb)]
    step, grids = max(steps), []
    for own, g in zip(steps, (ga, gb), strict=True):
        every = step // own
        grids.append([g[8 * k : 8 * k + 8] for k in range(every - 1, len(g) // 8, every)])
    low, high = 0, min(map(len, grids))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if grids[0][mid - 1] == grids[1][mid - 1] else (low, mid - 1)
    return low * step


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, guest, id, tie): own rows first, then the first row of the next range as a guest."""
    at, doc, text, own, codes = None, None, "", None, None
    for batch in batches:
        for a, b in pieces(batch.column(3)):
            cols = [batch.column(k).slice(a, b - a).to_pylist() for k in range(4)]
            out: list[tuple] = []
            for where, guest, next_doc, next_text in zip(*cols, strict=True):
                if guest and at is None:
                    continue  # the range's last row has met its next document
                next_text = next_text or ""
                next_codes = _codes(next_text)
                next_own = PrefixHashes.of(next_codes)
                if at is not None and at == where:
                    take = own.n // 4
                    changed = text[: own.n - take] + next_text[:take]
                    other = own.edited(own.n - take, next_codes[:take])
                    out.append((doc, own.n, hashlib.sha256(changed.encode()).hexdigest(), own.text(), other.text(), own.likeness(other), own.likeness(next_own)))
                at, doc, text, own, codes = (None,) * 5 if guest else (where, next_doc, next_text, next_own, next_codes)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _placer(shared) -> Callable:
    """Twice the number of a key's range, and 1 more for the first key of a range; keys of rows without an id come first."""

    def place(known, key):
        out, known, key = np.zeros(len(key), dtype=np.int64), known.to_numpy(), key.to_numpy()
        for kind, (first, starts) in shared.value.items():
            own = known == kind
            at = np.searchsorted(starts, key[own], side="right") - 1
            out[own] = 2 * (first + at) + (starts[at] == key[own])
        return pd.Series(out)

    return F.pandas_udf(place, "long", F.PandasUDFType.SCALAR)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("known", F.col("doc_id").isNotNull()).withColumn("key", F.when(F.col("known"), F.col("doc_id")).otherwise(F.xxhash64("text")))


def _starts(docs: DataFrame) -> dict[bool, tuple[int, np.ndarray]]:
    """For rows without an id and for those with one: the number of their first range, and the first key of each range.

    A range starts at a key of a sample of SAMPLED keys a range, picked by a hash of the key, the first one at the smallest
    key. Only the sample comes together.
    """
    docs = _keyed(docs)
    n, known, low, other = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.min(F.when(~F.col("known"), F.col("key")))).first()
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    share = min(1 << 40, -(-(SAMPLED * ranges << 40) // max(1, n)))
    out: dict[bool, tuple[int, np.ndarray]] = {}
    first = 0
    for kind, rows, least in ((False, n - known, other), (True, known, low)):
        if rows:
            own = docs.where(F.col("known") == kind).select("key").where(F.xxhash64(F.lit(SAMPLED), "key").bitwiseAND(F.lit((1 << 40) - 1)) < share)
            sample = np.sort(own.distinct().toArrow().column("key").to_numpy())  # 8 * SAMPLED * RANGES bytes at most
            marks = np.linspace(0, len(sample), max(1, round(ranges * rows / n)), endpoint=False).astype(np.int64)[1:]
            starts = np.unique(np.concatenate([np.array([least], dtype=np.int64), sample[marks] if len(sample) else sample]))
            out[kind] = (first, starts)
            first += len(starts)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    starts = _starts(docs)
    place, last = _placer(spark.sparkContext.broadcast(starts)), max((first + len(own) for first, own in starts.values()), default=1) - 1
    rows = docs.withColumn("place", place("known", "key")).withColumn("at", F.expr("place div 2"))
    before = F.when(F.col("at") == 0, last).otherwise(F.col("at") - 1)
    rows = rows.select("doc_id", "text", F.posexplode(F.when(F.col("place") % 2 == 1, F.array("at", before)).otherwise(F.array("at"))).alias("guest", "range"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartition("range").sortWithinPartitions("range", "guest", "doc_id", "tie")
    return rows.select("range", "guest", "doc_id", "text").mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
