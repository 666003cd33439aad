"""Ranked lexical search of every document for a table of items, by bag deduplication.

Only the items' words matter to a score, and the document's length through m. So a document becomes the vector of its
counts of item words, together with m; documents with equal vectors and equal m form a class, found by hash and verified by
comparing the vectors themselves. A class is scored once, and its best members, by ascending doc_id, stand for it.

* The words of the items are broadcast in blocks of at most BLOCK_TERMS words; the items of further blocks are searched in
  passes of their own over the documents.
* A document's vector is packed with the numbers of its words; texts are read once a block and never shuffled.
* At most k members of a class can be among an item's k best, so classes keep their k smallest doc_ids: Spark limits each
  task's rows before the shuffle, and a class that holds a third of all documents costs k rows a task.
* Scores are sums over the classes' words of what the word adds, spread to the items that hold it. They stay below 2**53, so
  sums of doubles are exact. A task hands on its k best classes of each item: no document outside them can be among the k
  best, as each of k better classes has a member that comes first.

Rows: documents with a null text or no words count nowhere; documents that share a doc_id are ranked one by one, null ids
last. Items that share an item_id are one item with the words of all; items without words have no rows. Empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import ALNUM, bound_batches, cut, pieces, read, text_bytes, words_of

#: Rows of the result for each item, words of a block of items (some 150 bytes each in a worker), postings scored at once.
K, BLOCK_TERMS, POSTINGS = 10, 1 << 18, 1 << 22
#: Weights of length against the mean length in m: m = 100 - LENGTH + LENGTH * n / mean.
LENGTH = 90


@dataclass
class Index:
    """The items of a block: number of each word, and for each word the items that hold it, as places in item_ids."""

    item_ids: list
    terms: dict[bytes, int]
    start: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(rows: list[tuple[object, set[bytes]]]) -> Index:
        terms: dict[bytes, int] = {}
        pairs = sorted((terms.setdefault(w, len(terms)), k) for k, (_, words) in enumerate(rows) for w in sorted(words))
        held = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return Index([x for x, _ in rows], terms, np.searchsorted(held[:, 0], np.arange(len(terms) + 1)), held[:, 1])


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): the distinct words of all rows of an item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(words_of(x, ALNUM))) for x in text_bytes(batch.column(1)).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.binary()))], names=["item_id", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").where("text is not null").mapInArrow(split, f"item_id {kind}, words array<binary>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")).where("size(words) > 0")


def blocks(items: DataFrame, terms: int = BLOCK_TERMS) -> Iterator[Index]:
    """The items in blocks of at most `terms` words, at least one item each, one block on the driver at a time."""
    found = cut(item_words(items))
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / terms)) if total > terms else 1
    rows: list[tuple[object, set[bytes]]] = []
    held = 0
    for k in range(parts):
        for r in found.where(F.expr(f"pmod(xxhash64(item_id), {parts}) = {k}")).collect():
            if rows and held + len(r.words) > terms:
                yield Index.of(rows)
                rows, held = [], 0
            rows.append((r.item_id, {bytes(x) for x in r.words}))
            held += len(r.words)
    if rows:
        yield Index.of(rows)


def _counter(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.terms.get
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                lengths, vectors = [], []
                for text in text_bytes(batch.column(1).slice(a, b - a)).to_pylist():
                    words = words_of(text, ALNUM)
                    known = np.array([x for x in map(number, words) if x is not None], dtype=np.uint32)
                    terms, counts = np.unique(known, return_counts=True)
                    lengths.append(len(words))
                    vectors.append(terms.tobytes() + counts.astype(np.uint32).tobytes())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(lengths, pa.int64()), pa.array(vectors, pa.binary())], names=["doc_id", "n", "vector"])

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count of documents for each word number."""
    seen = np.zeros(0, dtype=np.int64)
    for batch in batches:
        own = [np.frombuffer(v, dtype=np.uint32)[: len(v) // 8] for v in batch.column(0).to_pylist()]
        if own:
            found = np.bincount(np.concatenate(own), minlength=len(seen))
            found[: len(seen)] += seen
            seen = found
    terms = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(terms, pa.int64()), pa.array(seen[terms], pa.int64())], names=["term", "df"])


def _scorer(shared, weights: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes (m, vector, members) to the k best (item, score, members) of each item that the task has met."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        n_items, fan = len(index.item_ids), np.diff(index.start)
        best: dict[int, list[tuple[int, float, list]]] = {}

        def add(rows: list[tuple[int, np.ndarray, np.ndarray, list]]) -> None:
            term = np.concatenate([t for _, t, _, _ in rows]).astype(np.int64)
            tf = np.concatenate([c for _, _, c, _ in rows]).astype(np.int64)
            row = np.repeat(np.arange(len(rows)), [len(t) for _, t, _, _ in rows])
            m = np.array([x for x, _, _, _ in rows], dtype=np.int64)[row]
            adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            each = fan[term]
            at = np.repeat(index.start[term] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            key, slot = np.unique(np.repeat(row, each) * n_items + index.items[at], return_inverse=True)
            scores = np.bincount(slot, weights=np.repeat(adds, each).astype(np.float64)).astype(np.int64)
            row, item = key // n_items, key % n_items
            first = np.array([math.inf if x[3][0] is None else x[3][0] for x in rows])[row]
            order = np.lexsort((first, -scores, item))
            item, scores, row = item[order], scores[order], row[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            top = (rank < k) & (scores > 0)
            for i, s, r in zip(item[top].tolist(), scores[top].tolist(), row[top].tolist(), strict=True):
                best.setdefault(i, []).append((-s, math.inf if rows[r][3][0] is None else rows[r][3][0], rows[r][3]))
            for i in np.unique(item[top]).tolist():
                best[i] = sorted(best[i], key=lambda x: x[:2])[:k]

        held, postings = [], 0
        for batch in batches:
            for m, v, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(v, dtype=np.uint32)
                terms, counts = own[: len(own) // 2], own[len(own) // 2 :]
                held.append((m, terms, counts, members))
                postings += int(fan[terms].sum())
                if postings >= POSTINGS:
                    add(held)
                    held, postings = [], 0
        if held:
            add(held)
        found = [(i, -s, members) for i, rows in best.items() for s, _, members in rows]
        cols = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["item", "score", "members"])

    return score


def _search_block(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """(item, score, doc_id, rank) of one block; item is a place in its item_ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    vectors = cut(docs.mapInArrow(_counter(shared), "doc_id long, n long, vector binary"))
    n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(index.terms), dtype=np.int64)
    counts = vectors.where("length(vector) > 0").select("vector").mapInArrow(_frequencies, "term long, df long")
    for r in counts.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # one row a word of the block at most
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    held = vectors.where("length(vector) > 0").withColumn("m", F.expr(f"{100 - LENGTH} + ({LENGTH} * n * {n_docs}L) div {n_words or 1}L"))
    held = held.select("doc_id", "m", "vector", F.xxhash64("m", "vector").alias("h"))
    same = W.partitionBy("h", "m", "vector").orderBy(F.col("doc_id").asc_nulls_last())
    members = held.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    classes = members.groupBy("h", "m", "vector").agg(ids.alias("members")).select("m", "vector", "members")
    found = classes.mapInArrow(_scorer(shared, weights, k), "item long, score long, members array<long>")
    first = F.col("members")[0].asc_nulls_last()
    found = found.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), first))).where(F.col("place") <= k)
    found = found.select("item", "score", F.explode("members").alias("doc_id"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, of documents (doc_id, text) and items (item_id, text)."""
    if k < 1:
        raise ValueError("k is 1 at least")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    schema, out = f"item_id {kind}, rank int, doc_id long, score long", None
    for index in blocks(items, block_terms):
        found = _search_block(docs, index, k)
        names = spark.createDataFrame(list(enumerate(index.item_ids)), f"item long, item_id {kind}")
        found = cut(found.join(names.hint("merge"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_words FROM dw WHERE len(w) > 0),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw) GROUP BY doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, st GROUP BY term, n_docs),
sc AS (
  SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM tf JOIN df USING (term) JOIN it USING (term), st GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
