"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over windows of every document.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lowered, of whole texts. A window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window. Window hashes of all places of a document are looked up in a
bitmap and then in the sorted hash set; what is found is verified word by word, so a hash never decides.

The benchmark is broadcast in blocks of at most block_bytes of text, each scanned in a narrow pass of its own over the
documents that adds to the spans found before. A block is arrays over one text of its words: for 16 MB of text some 3 million
windows and 110 MB. Items that are longer than half a block are cut into overlapping pieces first. What a pass found is
written before the next one begins, so that one block is in memory at a time. Nothing is shuffled.

Rows: null and empty texts have no words and no hits, very long ones are scanned whole. Documents are scanned row by row,
whether their doc_id is null or repeated. Items with a null item_id are left out; items that share an
item_id count once. An empty benchmark gives no hits. Columns that clash with those added are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import ALNUM, PIECE, bound_batches, cut, ngrams, pieces, read, text_bytes, word_hashes, words_of

WINDOW, BLOCK_BYTES = 10, 16 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = ("n_words", "spans", "items")


class Known(NamedTuple):
    """Distinct windows of one length, sorted by hash: where their words stand in the block's text, and which items have each."""

    hashes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    post: np.ndarray
    items: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)


def _word_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (outside) of the words of a text that has one blank between words."""
    blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]).astype(np.int64), np.concatenate([blanks, [len(text)]]).astype(np.int64)


class Windows:
    """The distinct windows of a block of items, as arrays over one text of all its words: some 30 bytes a window and the
    words once, however long the windows are. One bitmap stands before the sorted hashes of each length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, bits: int = 22):
        self.mask, self.bitmap, self.by_length = np.uint64((1 << bits) - 1), np.zeros(1 << bits, dtype=bool), {}
        own = [(i, b" ".join(words_of(t, ALNUM))) for i, t in items]
        own = [(i, t) for i, t in own if t]
        self.ids, self.text = [i for i, _ in own], b" ".join(t for _, t in own)
        if not own:
            return
        first, last = _word_ends(self.text)
        hashes, at, held = [], [0], 0
        for k in range(len(own) + 1):  # hashes of bounded pieces, as hashing takes some 40 bytes a byte of text
            if k == len(own) or held and held + len(own[k][1]) > PIECE:
                hashed, offsets = word_hashes([t for _, t in own[len(at) - 1 : k]], ALNUM)
                hashes.append(hashed)
                at += (at[-1] + offsets[1:]).tolist()
                held = 0
            held += len(own[k][1]) if k < len(own) else 0
        hashes, at = np.concatenate(hashes), np.array(at)
        lengths = np.minimum(np.diff(at), window)
        for n in np.unique(lengths).tolist():
            grams = ngrams(hashes, n)
            which = np.flatnonzero(lengths == n)
            counts = np.diff(at)[which] - n + 1
            item = np.repeat(which, counts).astype(np.int32)
            word = np.repeat(at[which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            order = np.lexsort((word, grams[word]))
            item, word = item[order], word[order]
            h, start, size = grams[word], first[word], last[word + n - 1] - first[word]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            for k in np.flatnonzero(~new).tolist():  # repeated windows, and now and then another one with the same hash
                new[k] = self.text[start[k] : start[k] + size[k]] != self.text[start[k - 1] : start[k - 1] + size[k - 1]]
            at_new = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            pairs = np.unique(group.astype(np.int64) << 32 | item)
            post = np.searchsorted(pairs >> 32, np.arange(len(at_new) + 1)).astype(np.int32)
            self.by_length[n] = Known(h[at_new], start[at_new].astype(np.int32), size[at_new].astype(np.int32), post, (pairs & 0xFFFFFFFF).astype(np.int32))
            self.bitmap[h & self.mask] = True

    def find(self, texts: list[bytes | None]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Word counts of the texts; for those with hits, by row, merged word spans and item ids."""
        hashes, at = word_hashes(texts, ALNUM)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        split: dict[int, tuple[bytes, np.ndarray, np.ndarray]] = {}
        for n, known in self.by_length.items():
            grams = ngrams(hashes, n)
            at_word = np.flatnonzero(self.bitmap[grams & self.mask])
            low = np.searchsorted(known.hashes, grams[at_word], side="left")
            high = np.searchsorted(known.hashes, grams[at_word], side="right")
            rows = np.searchsorted(at, at_word, side="right") - 1
            keep = (high > low) & (at_word + n <= at[rows + 1])
            for w, row, a, b in zip(at_word[keep].tolist(), rows[keep].tolist(), low[keep].tolist(), high[keep].tolist(), strict=True):
                if row not in split:
                    own = b" ".join(words_of(texts[row], ALNUM))
                    split[row] = own, *_word_ends(own)
                own, starts, ends = split[row]
                first = w - int(at[row])
                here = own[starts[first] : ends[first + n - 1]]
                for k in range(a, b):  # windows of one hash: nearly always one
                    if self.text[known.start[k] : known.start[k] + known.size[k]] == here:
                        items[row].update(self.ids[x] for x in known.items[known.post[k] : known.post[k + 1]])
                        spans[row].append((first, first + n))
        return np.diff(at), {r: merge(s) for r, s in spans.items()}, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(shared, text_at: int, before: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for a, b in pieces(batch.column(text_at)):
                part = batch.slice(a, b - a)
                n_words, spans, items = windows.find(text_bytes(part.column(text_at)).to_pylist())
                kept = part.columns
                if before:
                    kept, old = kept[:-3], [c.to_pylist() for c in kept[-2:]]
                    for r, (s, i) in enumerate(zip(*old, strict=True)):
                        if s:
                            spans[r] = merge([*zip(s[::2], s[1::2], strict=True), *spans.get(r, [])])
                            items[r] = {*i, *items.get(r, ())}
                rows = range(part.num_rows)
                flat = [[x for s in spans.get(r, ()) for x in s] for r in rows]
                yield pa.record_batch(
                    [*kept, pa.array(n_words, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string()))],
                    names=[*part.schema.names[: len(kept)], *FOUND],
                )

    return scan_batches


def bounded_items(items: DataFrame, window: int, most: int) -> DataFrame:
    """Items (item_id, text), those above `most` bytes in pieces that overlap by window - 1 words, so that each window stands
    in one of them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)).to_pylist(), strict=True):
                words, first = words_of(text, ALNUM), 0
                while first == 0 or first + window <= len(words):
                    stop, held = first, 0
                    while stop < len(words) and (held < most or stop < first + window):
                        held += len(words[stop]) + 1
                        stop += 1
                    yield pa.record_batch([pa.array([item_id], pa.string()), pa.array([b" ".join(words[first:stop])], pa.binary()).cast(pa.string())], names=["item_id", "text"])
                    first = max(first + 1, stop - window + 1)

    short = F.octet_length("text") <= most
    return items.where(short).unionByName(items.where(~short).mapInArrow(split, "item_id string, text string"))


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most block_bytes of text, one on the driver at a time; one block, maybe empty, at least."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / block_bytes))
    rows: list[tuple[str, bytes]] = []
    held = 0
    for r in items.repartition(parts, "item_id", "text").toLocalIterator():  # a partition at a time
        text = r.text.encode()
        if rows and held + len(text) > block_bytes:
            yield rows
            rows, held = [], 0
        rows.append((r.item_id, text))
        held += len(text)
    yield rows


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (word numbers: start, end, start, end, ...) and items (ids with a window in the text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(*FOUND)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("n_words long, spans array<int>, items array<string>").fields)
    out, shared = docs, None
    for rows in item_blocks(bounded_items(items, window, max(block_bytes // 2, 1)), block_bytes):
        if shared is not None:  # what the last block found is written before the next one is sent
            out = cut(out)
            shared.destroy()
        before = shared is not None
        shared = spark.sparkContext.broadcast(Windows(rows, window))
        out = out.mapInArrow(_scanner(shared, docs.columns.index("text"), before), schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without what stands from the first to the last word of each span."""
    at, out, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs, with its columns, without what the benchmark holds: remove is 'documents' (every row that has a hit goes)
    or 'spans' (rows stay, the words that are hit go)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    found, text_at = scan(docs, benchmark), docs.drop(*FOUND).columns.index("text")
    if remove == "documents":
        return found.where(F.size("spans") == 0).drop(*FOUND)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if not s else cut_spans(x, s) for x, s in zip(text_bytes(batch.column(text_at)).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            cols = batch.columns[:-3]
            cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch(cols, names=batch.schema.names[:-3])

    return found.mapInArrow(clean, T.StructType(found.schema.fields[:-3]))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Windows of items and of documents as joined words; a window that occurs marks its words.
ORACLE = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN win USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
