"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a compact table, broadcast: how many tokens each of the corpus's most frequent words makes. Frequent words
come from one sketch of fixed size for each task over all documents; sketches are merged FAN at a time, level by level, so
that no task reads more than FAN of them. The table holds TOP words at most, and it decides only how fast a length is found, never which length.
Tier two is a cache in each worker: pre-tokens that the table lacks are encoded once, in a batch, by the tokenizer's
own library. It is emptied when it holds CACHE pre-tokens, so memory is bounded.

Byte-level BPE files (.json) are cut into pre-tokens by their published pattern, special strings first, as the library
does by default; a pre-token's length doesn't depend on its neighbours. For every other tokenizer (.json with another
pre-tokenizer, SentencePiece .model) whole texts go to the library.

Rows: a null text counts as empty: 0 bytes, 0 tokens. No row is dropped or merged; null and repeated doc_ids are counted
row by row. Without documents there are no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import bound_batches, pieces, read

TOP, TRACKED, CACHE, LIMIT = 5000, 50_000, 400_000, 512
#: Sketches that are merged at a time.
FAN = 16
#: Fixed value: the byte-level pre-token pattern, with the white space that Unicode lists (the regex module's \s also takes U+001C to U+001F).
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


class Counter:
    """Counts tokens of texts for one tokenizer file; `frequent` is the first tier."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.frequent = frequent or {}
        self.known, self.cut = dict(self.frequent), None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if byte_level(spec):
            special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
            self.cut = regex.compile("|".join([*map(regex.escape, special), PATTERN]))
            self.plain = regex.compile(PATTERN)
            self.special = special

    def pre_tokens(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            out: list[str] = []
            for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
                out += [part] if part in self.special else self.plain.findall(part)
            return out
        return self.plain.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        if self.cut is None:
            return self.encode(texts)
        split = [self.pre_tokens(x) for x in texts]
        known = self.known
        new = list({t for x in split for t in x} - known.keys())
        if new:
            if len(known) + len(new) > CACHE:
                known = self.known = dict(self.frequent)
                new = list({t for x in split for t in x} - known.keys())
            known.update(zip(new, self.encode(new), strict=True))
        return [sum(map(known.__getitem__, x)) for x in split]


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Tier one: lengths of the pre-tokens in the TOP most frequent blank-separated words."""
    counter = Counter(path)
    if counter.cut is None:
        return {}
    tasks = docs.select("text").rdd.getNumPartitions()
    words = docs.select(F.spark_partition_id().alias("task"), F.explode(F.split("text", " ")).alias("word"))
    sketches = words.groupBy("task").agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("sketch"))
    while True:  # grouped in the last level too, so that no words give no row
        tasks = -(-tasks // FAN)
        sketches = sketches.groupBy(F.expr(f"task div {FAN}").alias("task")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
        if tasks <= 1:
            break
    best = sketches.select(F.expr(f"approx_top_k_estimate(sketch, {TOP})").alias("top")).first()
    top = best.top if best else []
    found = list({t for row in top if row.item for x in (row.item, f" {row.item}") for t in counter.plain.findall(x)})
    return dict(zip(found, counter.encode(found), strict=True))


def _count(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in pieces(text):
                part = text.slice(a, b - a)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pc.binary_length(part).cast(pa.int64()), pa.array(counter.count(part.to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count_batches


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; path: a tokenizer file that every worker can read."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((path, frequent_lengths(docs, path)))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(shared), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
