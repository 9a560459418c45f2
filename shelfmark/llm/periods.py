"""Periodic runs: maximal stretches of words that repeat themselves, found by block convolution.

A run of period q is a stretch in which words q apart are equal, of at least LEAST words and two periods, that no neighbouring
word extends. At each dyadic scale b, a text is cut into blocks of b words. A run with 2b-1 <= q < 4b-1 is long enough to hold
a whole block together with its copy q words later, so that the sum of squared differences of the two is 0. These sums are
taken for all blocks of a batch and all distances of the scale at once by a number-theoretic transform modulo the prime 65537:
its sums stay below 2^53, so that matrix products of floats are exact. A sum that isn't 0 rules a distance out for certain; one
that is 0 seeds an extension on the words themselves, which finds the maximal stretch or drops what only the modulus made
equal. Blocks of more than CORE words are sought by their first CORE words, so that a transform's length is bounded for texts
of any length and each scale takes time in proportion to the text. A stretch that several distances give has the smallest of
them as its period.

Nulls: a null text has no words; a null doc_id counts as one of no digits where a rewriting asks for it. Empty texts have no
runs. Texts of any length are taken whole; a batch's memory follows its number of words (some 40 bytes each). Repeated rows
are treated alike, each for itself. An empty table gives no rows. Columns besides doc_id and text are left out, whatever their
names.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, texts

LEAST = 12
#: The prime 2^16 + 1, and a number whose powers are all its residues but 0.
PRIME, ROOT = 65537, 3
#: Words of the longest block that is convolved whole, and numbers that are transformed at once.
CORE, AT_ONCE = 256, 1 << 17
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues between -PRIME/2 and PRIME/2, exact for whole numbers below 2^53; 0 stands for multiples alone."""
    quotient = x * (1.0 / PRIME)
    np.rint(quotient, out=quotient)
    quotient *= PRIME
    return np.subtract(x, quotient, out=quotient)


def powers(root: int, rows: int, columns: int) -> np.ndarray:
    return reduced(np.array([[float(pow(root, i * j, PRIME)) for j in range(columns)] for i in range(rows)]))


class Transform:
    """The transform of a length that is a power of two, in two steps of matrix products over its two nearly equal factors;
    spectra stay in the order in which these leave them, as only products and the way back are asked of them."""

    def __init__(self, size: int):
        self.size = size
        self.first = 1 << (size.bit_length() - 1) // 2
        self.second = size // self.first
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        self.there, self.back = self.tables(root), self.tables(pow(root, -1, PRIME))
        self.scale = float(pow(size, -1, PRIME))

    def tables(self, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, second = self.first, self.second
        return powers(pow(root, second, PRIME), first, first), powers(root, first, second), powers(pow(root, first, PRIME), second, second)

    def forward(self, x: np.ndarray, tables: tuple) -> np.ndarray:
        """(count, size) numbers as (count, first, second) of their spectrum."""
        rows, twist, columns = tables
        x = reduced(rows @ x.reshape(-1, self.first, self.second))
        x = reduced(x * twist)
        return reduced(x @ columns)

    def correlated(self, blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """At t, each block times its window's numbers from t on, summed, as residues."""
        x = reduced(self.forward(blocks, self.back) * self.forward(windows, self.there))
        rows, twist, columns = self.back
        x = reduced(x @ columns)
        x = reduced(x * twist)
        return reduced(reduced(rows @ x).reshape(-1, self.size) * self.scale)


@functools.cache
def transform(size: int) -> Transform:
    return Transform(size)


def square_sums(x: np.ndarray, core: int) -> np.ndarray:
    """The squares of ``core`` numbers from each place on, summed, as residues."""
    squares = np.concatenate([[0.0], np.cumsum(reduced(x * x))])
    return reduced(squares[core:] - squares[:-core])


def zero_distances(x: np.ndarray, sums: np.ndarray, starts: np.ndarray, core: int, least: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``starts``, distance) of every block of ``core`` numbers whose squared differences from the numbers
    ``least`` to ``least + count - 1`` places later sum to a multiple of the prime. ``x`` goes on for long enough behind."""
    size = 1 << (core + count - 2).bit_length()
    engine = transform(size)
    places, distances = [], []
    for at in range(0, len(starts), max(AT_ONCE // size, 1)):
        own = starts[at : at + max(AT_ONCE // size, 1)]
        blocks = np.zeros((len(own), size))
        windows = np.zeros((len(own), size))
        blocks[:, :core] = x[own[:, None] + np.arange(core)]
        windows[:, : core + count - 1] = x[own[:, None] + (least + np.arange(core + count - 1))]
        cross = engine.correlated(blocks, windows)[:, :count]
        total = reduced(sums[own][:, None] + sums[own[:, None] + (least + np.arange(count))] - 2 * cross)
        block, distance = np.nonzero(total == 0)
        places.append(block + at)
        distances.append(distance + least)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def reach(ids: np.ndarray, left: np.ndarray, right: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many ids from ``left`` and ``right`` on are pairwise equal, at most ``room``; backwards with a step of -1. All pairs
    go on together, by stretches that double."""
    found = np.zeros(len(left), np.int64)
    active, length = np.flatnonzero(room > 0), 8
    while len(active):
        on = []
        for part in np.array_split(active, -(-len(active) * length // AT_ONCE)):
            at = found[part][:, None] + np.arange(length)
            limit = room[part][:, None]
            place = step * np.minimum(at, limit - 1)
            equal = (ids[left[part][:, None] + place] == ids[right[part][:, None] + place]) & (at < limit)
            whole = equal.all(axis=1)
            found[part] += np.where(whole, length, equal.argmin(axis=1))
            on.append(part[whole])
        active, length = np.concatenate(on), min(2 * length, 1 << 14)
    return found


def stretches(ids: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, distance: np.ndarray, core: int, block: int) -> list[np.ndarray]:
    """Rows (start, end, distance) of the maximal stretches that seeds lie in: each says that ``core`` ids at its place equal
    those at its distance. Of seeds in successive blocks only the first is extended, until all are covered."""
    found = []
    order = np.lexsort((place, distance))
    place, distance, low, high = place[order], distance[order], low[order], high[order]
    while len(place):
        head = np.r_[True, (distance[1:] != distance[:-1]) | (place[1:] != place[:-1] + block) | (low[1:] != low[:-1])]
        p, d = place[head], distance[head]
        start = p - reach(ids, p - 1, p - 1 + d, p - low[head], -1)
        end = p + reach(ids, p, p + d, high[head] - d - p, 1)
        own = np.cumsum(head) - 1
        good = end - p >= core  # not so where the modulus alone made them equal
        found.append(np.stack([start, end + d, d], axis=1)[good])
        left = ~head & ~(good[own] & (place + core <= end[own]))
        place, distance, low, high = place[left], distance[left], low[left], high[left]
    return found


def known(runs: np.ndarray, place: np.ndarray, distance: np.ndarray, core: int) -> np.ndarray:
    """Which seeds, in order of their place, lie with their copies in a run whose period divides their distance: all that they
    could give is that run."""
    out = np.zeros(len(place), bool)
    for start, end, period in runs.tolist():
        a, z = np.searchsorted(place, (start, end))
        out[a:z] |= (distance[a:z] % period == 0) & (place[a:z] + distance[a:z] + core <= end)
    return out


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of the texts that lie between ``bounds`` in ``ids``, by start, then period; of at
    least ``least`` words, which are 12 or more, so that short periods need no blocks of one word."""
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not sought")
    begins, ends = bounds[:-1], bounds[1:]
    x = reduced(np.concatenate([ids, np.zeros(5 * CORE, ids.dtype)]).astype(float))
    found, block = np.zeros((0, 3), np.int64), 2
    while True:
        shortest, longest = (1, 7) if block == 2 else (2 * block - 1, 4 * block - 1)
        wide = np.flatnonzero(ends - begins >= max(2 * shortest, least))
        if not len(wide):
            break
        first = -(-begins[wide] // block)
        counts = np.maximum(-(-(ends[wide] - shortest - block + 1) // block) - first, 0)
        text = np.repeat(wide, counts)
        starts = (np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(text))) * block
        core, seeds = min(block, CORE), []
        sums = square_sums(x, core)
        for at in range(shortest, longest, 2 * CORE):  # windows of a bounded length
            fits = np.flatnonzero(starts + at + core <= ends[text])
            for part in np.array_split(fits, -(-len(fits) // AT_ONCE)) if len(fits) else []:
                place, distance = zero_distances(x, sums, starts[part], core, at, min(longest - at, 2 * CORE))
                seeds.append((part[place], distance))
        if seeds:
            which, distance = (np.concatenate(y) for y in zip(*seeds, strict=True))
            place, owner = starts[which], text[which]
            kept = place + distance + core <= ends[owner]
            place, distance, owner = place[kept], distance[kept], owner[kept]
            order = np.argsort(place, kind="stable")
            place, distance, owner = place[order], distance[order], owner[order]
            new = ~known(found[found[:, 1] - found[:, 0] >= shortest + core], place, distance, core)
            more = stretches(ids, begins[owner[new]], ends[owner[new]], place[new], distance[new], core, block)
            found = settled(np.concatenate([found, *more]), least)
        block *= 2
    return found


def settled(rows: np.ndarray, least: int) -> np.ndarray:
    """The stretches that are long enough, each once, with its smallest period, by start, then period."""
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, 2 * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(text: bytes, numbers: defaultdict) -> np.ndarray:
    """Each word's number; the text is split PIECE bytes at a time."""
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


#: For each document, which of its words stand at its places (None: its own, in order).
Rewriting = Callable[[int | None, int], np.ndarray | None]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """In a tenth of all documents, by the CRC of their id: from a place on, the same words over and over."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def found(docs: DataFrame, least: int = LEAST, rewriting: Rewriting | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs as structs of start, length and period, by start, then period, and
    its words joined by single spaces without what a run repeats after its first period."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        each = [numbered(t.as_py(), numbers) for t in batch.column(1)]
        if rewriting is not None:
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                order = rewriting(doc_id, len(each[k]))
                each[k] = each[k] if order is None else each[k][order]
        words, sizes = list(numbers), [len(x) for x in each]
        bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        ids = np.concatenate(each)
        rows = runs_of(ids, bounds, least)
        begin, end, period = rows.T
        depth = np.zeros(len(ids) + 1, np.int32)
        np.add.at(depth, begin + period, 1)
        np.add.at(depth, end, -1)
        kept = np.cumsum(depth)[:-1] == 0
        collapsed = [b" ".join(map(words.__getitem__, x[k].tolist())) for x, k in zip(each, np.split(kept, bounds[1:-1]), strict=True)]
        own = np.searchsorted(bounds, begin, side="right") - 1
        offsets = np.searchsorted(own, np.arange(len(each) + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (begin - bounds[own], end - begin, period)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = map_arrow(texts(docs), run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(rows: DataFrame) -> DataFrame:
    """The number of runs, the longest of them (of equal ones the first, then that of the smallest period), and digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
