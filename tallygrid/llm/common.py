"""What the text operators share: Arrow batches in bounded pieces, word boundaries and word hashes by array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallygrid.operators.components import cut, ensure_checkpoint_dir
from tallygrid.shipping import ship

__all__ = ["PIECE", "ROWS", "bound_batches", "cut", "ensure_checkpoint_dir", "fold_table", "mix", "ngrams", "pieces", "read", "text_bytes", "word_hashes", "words_of"]

#: Rows of an Arrow batch sent to a Python worker, and bytes of text that it then takes in hand at once. A text that is longer is a piece of its own.
ROWS, PIECE = 256, 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ROWS rows, as texts may be long; a smaller setting of the session stays. Workers get the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def fold_table(separators: bytes | None = None) -> bytes:
    """Byte table: A-Z lowered, separators become a blank. Without an argument every ASCII byte but 0-9 and letters separates."""
    out = bytearray(range(256))
    for c in range(128):
        if separators is not None and c in separators or separators is None and not chr(c).isalnum():
            out[c] = 32
        elif 65 <= c <= 90:
            out[c] = c + 32
    return bytes(out)


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and words [^\x20\x09-\x0D]+, both with A-Z lowered.
ALNUM, SPACED = fold_table(), fold_table(b" \t\n\x0b\x0c\r")


def words_of(text: bytes | None, table: bytes) -> list[bytes]:
    """The words of a text. Only blanks, and bytes that the table makes blanks, separate; with SPACED and ALNUM no other ASCII white space is left."""
    return [] if text is None else text.translate(table).split()


def text_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).cast(pa.binary())


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `most` bytes of text at most, one row at least."""
    sizes, start, held = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (Steele, Lea and Flood 2014); spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the length of a piece."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, PIECE + 1)
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if size <= PIECE + 1:
        _POWERS[base] = out
    return out[:n]


def word_hashes(texts: list[bytes | None], table: bytes, prefix: int = 0, kinds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of the texts, one after another, and len(texts)+1 offsets of each text's words.

    With prefix also hashes of the words' first `prefix` bytes. With kinds, a number for each byte value and 0 for
    blanks, a word also ends where the kind changes.

    A word's hash is a polynomial over a random value for each byte, modulo 2**64, then mixed: prefix sums give it for
    all words at once. Equal words have equal hashes in every process.
    """
    buf = np.frombuffer(b" ".join(x.translate(table) if x else b"" for x in texts) + b" ", dtype=np.uint8)
    kind = (buf != 32).view(np.int8) if kinds is None else kinds[buf]
    edge = np.diff(kind, prepend=np.int8(0)) != 0
    start = np.flatnonzero(edge & (kind != 0))
    end = np.flatnonzero(edge[1:] & (kind[:-1] != 0)) + 1
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=sums[1:])
    back = powers(_INVERSE, len(buf))[start]
    hashed = lambda stop: mix((sums[stop] - sums[start]) * back + (stop - start).astype(np.uint64))
    at = np.searchsorted(start, np.cumsum([0] + [len(x or b"") + 1 for x in texts]))
    return (hashed(end), at, hashed(np.minimum(end, start + prefix))) if prefix else (hashed(end), at)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; places near the end that lack words are left out."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.full(len(hashes) - n + 1, n * 0x632BE59BD9B4E019 % (1 << 64), dtype=np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)
