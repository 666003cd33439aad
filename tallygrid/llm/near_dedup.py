"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set holds the distinct five-word shingles of its whole text (words [^\\x20\\x09-\\x0D]+, A-Z lowered); with
fewer words the whole sequence is the one shingle. Two documents are linked when 100 * |intersection| >= 75 * |union|.

How the work is kept bounded, without dropping any link:

* Documents with equal sets are one class, so copies never meet in pairs.
* One-permutation hashing sorts the 64-bit shingle hashes once; the top bits are the bin, the first hash in a bin its
  minimum. Empty bins copy a bin picked by a fixed random probe sequence (optimal densification, Shrivastava 2017).
* BANDS bands of ROWS_PER_BAND bins make buckets. At similarity 0.75 a pair shares none of the 32 buckets with
  probability 5e-6; sets of three or four shingles fill few bins and miss more often.
* In every bucket only a star is tested: each member against the smallest member. Sets are compared in full. Nearly every
  link falls inside the components that these stars give.
* A bucket whose members are all in one component has nothing left to add. For the others a second step looks at pairs
  across components, in blocks of at most 2 * BLOCK members: a pair is taken in the first bucket it shares, if its sizes
  allow the similarity and if the minima of SKETCH bins, one byte each, agree as often as a similarity of 0.75 makes them
  do, less SIGMAS standard deviations (filled bins sample the union without replacement). No pair leaves the block: members
  that have one such partner get their texts, once a block, full sets are compared there by looking up who holds a shingle,
  and one link for each two components that become one goes on. Look-alikes that aren't linked put out nothing.
* Copies, stars and blocks are spread over tasks; no group is held whole in one task or on the driver.

Rows: a null or empty text has an empty set, is its own component and is linked with nothing. A null doc_id takes the
component of its copies, if any, and is kept otherwise. Rows that share a doc_id count as one node. Very long texts are
shingled whole. An empty table gives no rows; other columns are ignored, and `deduplicate` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import SPACED, bound_batches, cut, mix, ngrams, pieces, read, text_bytes, word_hashes
from tallygrid.operators.components import connected_components

WORDS, BINS, ROWS_PER_BAND, LEAST, OF = 5, 128, 4, 75, 100
BANDS = BINS // ROWS_PER_BAND
#: Bins of a sketch, standard deviations that it is trusted less; members of a block and shingles of all of them, at most.
SKETCH, SIGMAS, BLOCK, SHINGLES = 512, 5, 4096, 1 << 21
#: So many ids, some 16 MB, are broadcast at most, to shuffle the texts of their documents only.
FEW = 1 << 20
_PROBES = np.random.default_rng(20170806).integers(0, BINS, (4096, BINS))


def shingles(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    hashes, at = word_hashes(texts, SPACED)
    grams = ngrams(hashes, WORDS)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        else:
            yield ngrams(hashes[a:b], int(b - a)) if b > a else hashes[:0]


def signature(own: np.ndarray, bins: int) -> np.ndarray:
    """One minimum for each bin of a sorted set; an empty bin copies that of the first filled bin in its probe sequence."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    place = np.arange(bins, dtype=np.uint64)
    first = np.searchsorted(own, place << shift)
    low = own[np.minimum(first, len(own) - 1)]
    filled = (first < len(own)) & ((low >> shift) == place)
    gaps = empty = np.flatnonzero(~filled)
    source, tries = np.arange(bins), 16
    while len(empty):
        probes = _PROBES[:tries, empty] & (bins - 1)
        hit = filled[probes]
        found = hit.any(axis=0)
        source[empty[found]] = probes[hit.argmax(axis=0)[found], np.flatnonzero(found)]
        if tries == len(_PROBES):
            source[empty[~found]] = np.flatnonzero(filled)[0]
            break
        empty, tries = empty[~found], min(tries * 8, len(_PROBES))
    low[gaps] = low[source[gaps]]
    return low


def bands(own: np.ndarray) -> np.ndarray:
    rows = signature(own, BINS).reshape(BANDS, ROWS_PER_BAND)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS_PER_BAND):
        out = mix(out ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
    return out.view(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """One byte for each of SKETCH bins of the set: 0 if the bin is empty, else made from its minimum."""
    shift = np.uint64(64 - SKETCH.bit_length() + 1)
    bins, first = np.unique(own >> shift, return_index=True)
    out = np.zeros(SKETCH, dtype=np.uint8)
    out[bins.astype(np.int64)] = 1 + mix(own[first]) % np.uint64(255)
    return out.tobytes()


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            sets = list(shingles(text_bytes(part.column(1)).to_pylist()))
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()), pa.array([bands(x) if len(x) else None for x in sets], pa.list_(pa.int64())), pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by star and centre first; a star that goes on in the next batch keeps its centre's set."""
    star, low, centre = None, None, None
    for batch in batches:
        for a, b in pieces(batch.column(5)):
            part = batch.slice(a, b - a)
            c, salt, member, rep, key, text = (part.column(k) for k in range(6))
            out: list[tuple[int, int, int, int]] = []
            for s, m, r, k, own in zip(zip(c.to_pylist(), salt.to_pylist(), strict=True), member.to_pylist(), rep.to_pylist(), key.to_pylist(), shingles(text_bytes(text).to_pylist()), strict=True):
                if set_key(own) != k:
                    continue  # another text under the same doc_id
                if not m:
                    star, low, centre = s, r, own
                elif s == star and r != low:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    out.append((r, low, both, len(own) + len(centre) - both))
            cols = list(zip(*dict.fromkeys(out), strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=["a", "b", "n_both", "n_all"])


def compare(docs: DataFrame, pairs: DataFrame, star: int = 2000) -> DataFrame:
    """(a, b, n_both, n_all): full sets of a and of its centre b, for every pair (a, a_key, b, b_key); keys name the sets.

    Texts of the documents that take part are sent once for each star they are in, members spread over parts of `star`
    members with the centre repeated in each, and are read as a sorted stream: no group is held in memory.
    """
    pairs = pairs.withColumn("c", F.xxhash64("b", "b_key"))  # the star: one id may stand on several texts
    parts = pairs.groupBy("c").agg(F.min("b").alias("b"), F.min("b_key").alias("b_key"), F.ceil(F.count("*") / star).cast("int").alias("parts"))
    members = pairs.join(parts.select("c", "parts").hint("merge"), "c").select("c", F.expr("cast(pmod(xxhash64(a), parts) as int)").alias("salt"), F.lit(True).alias("member"), F.col("a").alias("rep"), F.col("a_key").alias("set_key"))
    centres = parts.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("b").alias("rep"), F.col("b_key").alias("set_key"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    rows = members.unionByName(centres).hint("merge").join(texts, "rep").select("c", "salt", "member", "rep", "set_key", "text")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "member")
    return rows.mapInArrow(_compare, "a long, b long, n_both long, n_all long")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a block that may be linked with one of another component. Rows come sorted by (bucket, i, j); a group has
    2 * BLOCK rows at most."""
    held: list = []
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def members(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[5], r[6]))
        bucket, (i, j) = np.int64(rows[0][0]), rows[0][1:3]
        block, comp, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        own = np.array([r[7] for r in rows], dtype=np.int64)
        sk = np.frombuffer(b"".join(r[8] for r in rows), dtype=np.uint8).reshape(len(rows), SKETCH)
        hit = np.zeros(len(rows), dtype=bool)
        for x in range(len(rows) - 1):
            stop = np.searchsorted(n, n[x] * OF // LEAST, side="right")
            y = np.arange(x + 1, max(stop, x + 1))
            y = y[comp[y] != comp[x]] if i == j else y[(comp[y] != comp[x]) & (block[y] != block[x])]
            if not len(y):
                continue
            same = own[y] == own[x]
            y = y[own[x][same.argmax(axis=1)] == bucket]
            filled = ((sk[y] != 0) | (sk[x] != 0)).sum(axis=1)
            agree = ((sk[y] == sk[x]) & (sk[x] != 0)).sum(axis=1)
            union = np.maximum((n[x] + n[y]) * OF / (OF + LEAST), filled)
            slack = SIGMAS * np.sqrt(0.1875 / filled * (1 - filled / union)) + 2 / filled
            y = y[agree / filled >= LEAST / OF - slack]
            hit[y] = True
            hit[x] |= len(y) > 0
        out = [(*r[:5], r[6], r[9]) for r, h in zip(rows, hit, strict=True) if h]
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.record_batch([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["bucket", "i", "j", "block", "comp", "rep", "set_key"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield members(held)
                held = []
            held.append(row)
    if held:
        yield members(held)


def spanning_links(sets: list[np.ndarray], block: np.ndarray, comp: np.ndarray, rep: np.ndarray, between: bool) -> list[tuple[int, int]]:
    """Links between members of different components by their full sets; of two components that become one only one link.

    Which sets hold a shingle is looked up for all of a member's shingles at once, which gives its intersections with all
    others. Members of the largest component are only looked at from the others' side. between: of two blocks only.
    """
    sizes = np.array([len(x) for x in sets])
    ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[ids] > 1
    ids, owner = ids[shared], owner[shared]
    order = np.argsort(ids, kind="stable")
    holders, start = owner[order], np.searchsorted(ids[order], np.arange(len(counts) + 1))
    mine = np.searchsorted(owner, np.arange(len(sets) + 1))
    values, n_each = np.unique(comp, return_counts=True)
    largest = values[n_each.argmax()]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(comp != largest).tolist():
        own = ids[mine[x] : mine[x + 1]]
        each = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if len(own) else own
        both = np.bincount(holders[at], minlength=len(sets))
        linked = (OF * both >= LEAST * (sizes[x] + sizes - both)) & (comp != comp[x])
        if between:
            linked &= block != block[x]
        for y in np.flatnonzero(linked).tolist():
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b:
                root[a] = b
                out.append((int(max(rep[x], rep[y])), int(min(rep[x], rep[y]))))
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members that `_across` has named, with their texts, sorted by (bucket, i, j). A group's sets are held,
    SHINGLES of each of its blocks at most or one member, not its texts."""
    key, held = None, []

    def links() -> pa.RecordBatch:
        block, comp, rep = (np.array([r[k] for r in held]) for k in range(3))
        out = list(zip(*spanning_links([r[3] for r in held], block, comp, rep, key[1] != key[2]), strict=True)) or [[], []]
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    for batch in batches:
        for a, b in pieces(batch.column(7)):
            part = batch.slice(a, b - a)
            for *row, own in zip(*(part.column(k).to_pylist() for k in range(7)), shingles(text_bytes(part.column(7)).to_pylist()), strict=True):
                if set_key(own) != row[6]:
                    continue  # another text under the same doc_id
                if key != tuple(row[:3]):
                    if held:
                        yield links()
                    key, held = tuple(row[:3]), []
                held.append((*row[3:6], own))
    if held:
        yield links()


def across(docs: DataFrame, buckets: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that are in two components so far.

    Sketches tell which members of a block may be linked at all. Only those get their texts, once a block, and their full
    sets are compared there; what leaves a block is one link for each two components that it joins.
    """
    now = buckets.join(found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    parts = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("n_all") / SHINGLES)).cast("int")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("n_all")).where("lo < hi").select("bucket", parts.alias("g"))
    rows = now.drop("n").join(mixed.hint("merge"), "bucket").join(nodes.select("rep", "n", "bands", "sketch", "set_key").hint("merge"), "rep")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(rep), g) as int)")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "n", "rep", "bands", "sketch", "set_key")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    named = cut(rows.mapInArrow(_across, "bucket long, i int, j int, block int, comp long, rep long, set_key binary"))
    if named.isEmpty():
        return named.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    texts, ids = docs.select(F.col("doc_id").alias("rep"), "text"), named.select("rep").distinct()
    if ids.count() <= FEW:
        texts = texts.join(F.broadcast(ids), "rep", "left_semi")
    rows = named.hint("merge").join(texts, "rep").select("bucket", "i", "j", "block", "comp", "rep", "set_key", "text")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_link, "a long, b long").distinct()


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(docs.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch binary"))
    nodes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    rows = nodes.select("rep", "set_key", "n", F.explode("bands").alias("bucket"))
    low = rows.groupBy("bucket").agg(F.min(F.struct("rep", "set_key")).alias("low"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("low.rep").alias("b"), F.col("low.set_key").alias("b_key"))
    buckets = cut(rows.join(low.hint("merge"), "bucket"))
    pairs = buckets.where("rep <> b").select(F.col("rep").alias("a"), F.col("set_key").alias("a_key"), "b", "b_key").distinct()
    links = cut(compare(docs, pairs)).where(f"{OF} * n_both >= {LEAST} * n_all").select("a", "b")
    found = connected_components(links)
    extra = cut(across(docs, buckets.drop("b", "b_key", "set_key"), nodes, found))
    if not extra.isEmpty():
        stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = connected_components(stars.unionByName(extra))
    classes = nodes.select("set_key", F.col("rep").alias("node")).join(found.hint("merge"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key")
    full = out.where("set_key is not null").join(classes.hint("merge"), "set_key", "left")  # empty sets meet nothing, nor each other
    empty = out.where("set_key is null").withColumn("component", F.lit(None).cast("long"))
    out = full.unionByName(empty).select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...)."""
    return classified(docs).drop("text_hash")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, with its columns: of each component the row of the smallest doc_id; of repeated rows one."""
    kept = classified(docs).where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_hash")).distinct()
    own = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64("text")})
    own = own.join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    first = F.row_number().over(W.partitionBy("_id", "_hash").orderBy("text"))
    return own.withColumn("_copy", first).where("_copy = 1").select(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
