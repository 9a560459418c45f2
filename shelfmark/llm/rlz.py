"""Substring deduplication over words by relative Lempel-Ziv parsing.

Every document is cut into blocks at sampled words (see windows.py), and every block is indexed as a reference: by its words
from the anchor on, and by those before it. Blocks are parsed greedily from left to right against all others: at each place
the factor is the longest that any reference block goes on with. A factor of 35 words or more is a duplicate span; at its
boundary the parse goes on with the first window that it does not hold, so that windows across two factors are checked too.
A block that equals another as a whole is one factor. Where a range's border cuts a run of equal k-grams, windows on both
sides of it are compared by their words.

A word goes if a window of 35 words that covers it also starts anywhere else, in the same document or another. Null and empty
texts and texts of under 35 words lose nothing. A row that repeats another's doc_id and text is a place of its own. Words are
told apart by 48 bits of their hashes, so that two windows of which one word differs are held for equal once in 3e14 times.
Empty tables give no rows; texts of any length are read whole, and other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import U64, mixed, word_hashes
from .windows import SPAN, Contexts, Kind, agree, repeated_spans

WINDOW, GRAM = 35, 4
BITS = 48


def word_codes(data: bytes) -> np.ndarray:
    """A number of BITS bits for each word."""
    return word_hashes(data) & U64((1 << BITS) - 1)


def grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    out = words[:n]
    for k in range(1, GRAM):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[k : n + k])
    return out


def factors(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of a range's blocks: factors of a window's length at least, as (block, words before the anchor at its
    start, words from the anchor to its end, reference block).

    Blocks are parsed from left to right, all of them at once. Those with equal words from a place up to the anchor follow one
    another in the order of what stands before anchors; among them, in the order of what follows, the neighbour goes on alike
    for longest. Where that is a window or more, the factor holds every window up to its end, and the parse goes on at the
    first window across that end; else it goes on at the next word."""
    w, none = c.kind.window, np.zeros(0, np.int64)
    if len(c.some) < 2:
        return none, none, none, none
    rows = c.some[c.by_left(c.some)[0]]
    run, back = c.run[rows], c.back[rows]
    common = np.r_[0, agree(c.left[rows[1:]], c.left[rows[:-1]])]
    apart = np.r_[True, run[1:] != run[:-1]]
    place, found = back.copy(), []
    for before in range(int(back.max()), -1, -1):
        here = (back >= before) & (c.far[rows] >= w - before)
        due = here & (place >= before)
        if not due.any():
            continue
        group = np.cumsum(apart | (common < before))
        asked = np.zeros(group[-1] + 1, bool)
        asked[group[due]] = True
        at = np.flatnonzero(here & asked[group])
        at = at[np.lexsort((rows[at], group[at]))]
        x, g = rows[at], group[at]
        far = np.minimum(agree(c.right[x[1:]], c.right[x[:-1]]), np.minimum(c.n_right[x[1:]], c.n_right[x[:-1]]))
        far[g[1:] != g[:-1]] = 0
        ahead, behind = np.r_[0, far], np.r_[far, 0]
        longest = np.maximum(ahead, behind)
        reference = np.where(ahead >= behind, np.roll(x, 1), np.roll(x, -1))
        long = due[at] & (before + longest >= w)
        found.append((x[long], np.full(np.count_nonzero(long), before), longest[long], reference[long]))
        place[at[long]] = w - longest[long] - 1
    return tuple(np.concatenate(y) for y in zip((none,) * 4, *found, strict=True))


def parsed(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """The windows that factors hold."""
    block, before, far, _ = factors(c)
    count = before + far - c.kind.window + 1
    row = np.repeat(block, count)
    held = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - (c.kind.window - far), count)
    order = np.lexsort((held, row))
    return row[order], held[order]


WORDS = Kind(WINDOW, GRAM, False, word_codes, grams, parsed, False)


def cut(data: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the others joined by one space."""
    words = data.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    s = np.frombuffer(spans, SPAN)
    left, at = [], 0
    for a, size in zip(s["at"].tolist(), s["size"].tolist(), strict=True):
        left += words[at:a]
        at = a + size
    left += words[at:]
    return len(words), len(words) - len(left), b" ".join(left)


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and with ``keep_text`` the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column(1), batch.column(2), strict=True):
                n, gone, left = cut(data.as_py(), spans.as_py())
                out.append((n, gone, hashlib.sha256(left).hexdigest(), left)[: 4 if keep_text else 3])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 if keep_text else 3]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(kinds) + 1])

    rows, found = repeated_spans(WORDS, docs)
    both = rows.join(found, ["doc", "tie"], "left").select("doc_id", "text", "list")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * keep_text)
