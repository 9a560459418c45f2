"""What the training-data operators share: Arrow maps over whole texts, and word splitting.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; ``bytes.split()`` cuts at exactly these, so texts travel as
UTF-8 binary columns and are never decoded where bytes suffice. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_dir, small_batches, table, written

U64 = np.uint64


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text as UTF-8 binary); null texts become empty. Every other column of ``docs`` is left out."""
    small_batches(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text"),
    )


def text_hash(text: Column) -> Column:
    """64 bits of a text, a null one as an empty one: what tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"").cast("binary")))


def tie() -> Column:
    return text_hash(F.col("text")).alias("tie")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; ``fn`` yields batches of ``schema``."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def rows_by_text(fn: Callable[[bytes], tuple], names: list[tuple[str, pa.DataType]]) -> Callable:
    """A batch function that adds ``fn(text)``'s values to each doc_id."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [fn(x.as_py()) for x in batch.column(1)]
        columns = [batch.column(0)] + [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id"] + [n for n, _ in names])

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), elementwise."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: A word's hash adds up a number for each byte, times the byte's place's power of STEP, an odd number.
STEP, CHUNK = 0x9E3779B97F4A7C15, 1 << 18
with np.errstate(over="ignore"):
    _BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    _UP = np.multiply.accumulate(np.r_[U64(1), np.full(CHUNK, STEP, U64)])
    _DOWN = np.multiply.accumulate(np.r_[U64(1), np.full(CHUNK, pow(STEP, -1, 1 << 64), U64)])
_INSIDE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, by sums over the bytes that are worked on CHUNK at a time: a word's sum is that up to its
    end less that up to its start, divided by the start's power."""
    every = np.frombuffer(data, np.uint8)
    sums: list[np.ndarray] = []
    places: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    total, up, down, inside = U64(0), U64(1), U64(1), False
    with np.errstate(over="ignore"):
        for at in range(0, len(every), CHUNK):
            part = every[at : at + CHUNK]
            in_word = _INSIDE[part]
            edge = np.flatnonzero(in_word != np.r_[inside, in_word[:-1]])
            upto = np.cumsum(_BYTE[part] * _UP[: len(part)]) * up + total
            sums.append(np.where(edge > 0, upto[edge - 1], total))
            roots.append(_DOWN[edge] * down)
            places.append(edge + at)
            total, up, down, inside = upto[-1], up * _UP[CHUNK], down * _DOWN[CHUNK], bool(in_word[-1])
        if inside:
            sums.append(np.array([total], U64))
            roots.append(np.zeros(1, U64))
            places.append(np.array([len(every)]))
        if not sums:
            return np.zeros(0, U64)
        s, p, r = np.concatenate(sums), np.concatenate(places), np.concatenate(roots)
        return mixed((s[1::2] - s[::2]) * r[::2] + (p[1::2] - p[::2]).astype(U64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; fewer words make one run of all; no words make none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, U64)
    for k in range(size):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
    return out


__all__ = ["U64", "map_arrow", "mixed", "rows_by_text", "shared_dir", "shingle_hashes", "small_batches", "table", "text_hash", "texts", "tie", "word_hashes", "written"]
