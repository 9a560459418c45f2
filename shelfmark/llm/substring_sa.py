"""Substring deduplication by a sampled suffix array.

Suffixes that start at positions sampled by content (see windows.py) are range-partitioned by their leading bytes at sampled
splitters. Each range sorts its suffixes, 50 bytes of each and then the bytes before it, by multikey quicksort, and takes
the common prefixes of neighbours; a second order, of what stands before the suffixes, gives the common endings. Only where
both together are as long as 50 bytes can a string repeat: these strings, which lie at the borders of repeats, are sorted
too. Suffixes that agree with the border of their range far enough are compared across it.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Null and empty texts and
texts of under 50 bytes lose nothing. A null doc_id comes after all others; rows with one doc_id are one document here, so
that they take nothing from each other. All comparisons are of the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import U64, mixed
from .windows import SPAN, Contexts, Kind, repeated_of, repeated_spans

WINDOW, GRAM = 50, 16


def grams(data: np.ndarray) -> np.ndarray:
    """A number for the 16 bytes from each position on."""
    x = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").reshape(-1)
    return mixed(x[:-8]) * U64(0x9E3779B97F4A7C15) ^ x[8:]


def shared_strings(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """The 50-byte strings around suffixes that a smaller doc_id has too, among those that common prefixes and endings leave."""
    row, before = c.windows(c.some, c.far[c.some], c.back[c.some])
    again = repeated_of(c, row, before)
    return row[again], before[again]


BYTES = Kind(WINDOW, GRAM, True, lambda data: np.frombuffer(data, np.uint8), grams, shared_strings, True)


def cut(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    if not spans:
        return data, 0, 0
    s = np.frombuffer(spans, SPAN)
    parts, at, gone = [], 0, 0
    for a, size in zip(s["at"].tolist(), s["size"].tolist(), strict=True):
        end = min(a + size, len(data))
        parts.append(data[at:a])
        gone += max(0, end - a)
        at = end
    return b"".join(parts) + data[at:], gone, len(s)


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``keep_text`` the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = data.as_py()
                left, gone, n = cut(data, spans.as_py())
                out.append((len(data), gone, n, hashlib.sha256(left).hexdigest(), left)[: 5 if keep_text else 4])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if keep_text else 4]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1])

    rows, found = repeated_spans(BYTES, docs)
    both = rows.join(found, ["doc", "tie"], "left").select("doc_id", "text", "list")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
