"""Contexts of sampled positions, dealt in sorted order: what the suffix array (op2) and the factor parse (op10) share.

Windows of bytes or words are far too many to shuffle one by one. Every window is given an anchor: the start of the k-gram
in it with the lowest hash (the first of equals). The anchor depends on the window's content alone, so equal windows have
equal anchors at equal offsets, and looking at anchors alone loses no window. Consecutive windows with one anchor make a
context: the tokens from the anchor on (at most a window) and those before it (at most a window less a k-gram), as far as
the context's own windows reach.

1. Each task makes the contexts of its documents, sorts them by their own tokens, settles those that equal another of its
   own, and deals the others by ranges of that order at sampled splitters.
2. Each range sorts its contexts. Equal ones settle all their windows at once. What two unlike contexts share is found by
   the operator's own method (``Kind.repeats``) from how far neighbours in sorted order agree.
3. A splitter never cuts a run of equal k-grams, unless the run alone fills a range. Contexts of such a run that agree with
   a splitter far enough to hold a window send these windows on, each range every distinct one once, and they are compared
   across ranges by their tokens.

Contexts take several times their text's bytes, so steps 1 to 3 are done in PASSES, each for its share of the k-grams: the
text is read once more for each, and only one share's contexts are on disk at a time. Rows through each shuffle follow the
input's size, a group of copies of any size travels as one row a batch, and nothing is paired; so does a run of one token or of
a short period within a document. Rows are told apart by their doc_id and 32 bits of a hash of their text; a null doc_id is
later than all others. Empty tables give no rows; texts of any length are cut into pieces that overlap by a window; columns
besides doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, mixed, texts, tie, written

#: Tokens that are worked on at once; longer documents are cut with an overlap of a window less one.
PIECE = 1 << 16
#: Bytes of contexts that a task sorts at once, bytes of text for each range of their order, and passes over the k-grams.
HELD, RANGE_BYTES, PASSES = 32 << 20, 6 << 20, 2
#: The doc_id that a null one counts as.
LAST = (1 << 63) - 1
#: Of a context: its document, its first window's place, whether others were the same, and how much further the places reach
#: that it stands for: those of a document's equal contexts that lie a window apart at most.
IDS = [("doc", "<i8"), ("tie", "<u4"), ("at", "<u4"), ("many", "<u1"), ("more", "<u4")]
SPAN = [("doc", "<i8"), ("tie", "<u4"), ("at", "<u4"), ("size", "<u4")]
PACKETS = "kind string, bucket int, packet binary"


@dataclass(frozen=True)
class Kind:
    """How documents become tokens (bytes, or numbers of 48 bits) and what repeats: with ``earlier`` a window of a smaller
    doc_id, else any other place. ``grams`` numbers the k-gram at each position; ``repeats``, the operator's method, gives the
    windows (row, tokens before the anchor) of unlike contexts that repeat."""

    window: int
    gram: int
    earlier: bool
    tokens: Callable[[bytes], np.ndarray]
    grams: Callable[[np.ndarray], np.ndarray]
    repeats: Callable[[Contexts], tuple[np.ndarray, np.ndarray]]
    bytewise: bool

    @property
    def left(self) -> int:
        return self.window - self.gram

    @property
    def width(self) -> int:
        """Tokens of a row: right side and its length, left side (nearest first) and its length; bytes filled to eights."""
        n = self.window + self.left + 2
        return -(-n // 8) * 8 if self.bytewise else n

    @property
    def columns(self) -> int:
        return self.width // 8 if self.bytewise else self.width

    @property
    def sent(self) -> int:
        """Bytes of a row in a packet."""
        return self.width if self.bytewise else 6 * self.width

    @property
    def token(self) -> type:
        return np.uint8 if self.bytewise else U64


# Sampled positions and their contexts


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sampled(kind: Kind, tokens: np.ndarray, bounds: np.ndarray, share: int | None) -> tuple[np.ndarray, ...]:
    """The contexts of the documents that ``bounds`` cuts ``tokens`` into: document, anchor, first and last window's start; of
    all k-grams, or of one share of them. Windows that would leave their document are no windows."""
    none = (np.zeros(0, np.int64),) * 4
    if len(tokens) < kind.window:
        return none
    order = mixed(kind.grams(tokens))
    low = U64((1 << 24) - 1)
    first = lowest((order & ~low) | np.arange(len(order), dtype=U64), kind.left + 1)
    anchor = (first & low).astype(np.int64)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    where = np.flatnonzero(np.arange(len(anchor)) + kind.window <= bounds[1:][doc])
    if not len(where):
        return none
    a, d = anchor[where], doc[where]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    found = d[starts], a[starts], where[starts], where[np.r_[starts[1:], len(where)] - 1]
    if share is None:
        return found
    own = (order[found[1]] & low) % U64(PASSES) == U64(share)
    return tuple(x[own] for x in found)


def rows_of(kind: Kind, tokens: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each context's row of tokens; what lies beyond its windows is 0."""
    right, left = end + kind.window - anchor, anchor - begin
    wide = np.concatenate([np.zeros(kind.left, tokens.dtype), tokens, np.zeros(kind.window, tokens.dtype)])
    out = np.zeros((len(anchor), kind.width), kind.token)
    ahead, behind = np.arange(kind.window), np.arange(kind.left)
    around = np.lib.stride_tricks.sliding_window_view(wide, kind.left + kind.window)[anchor]
    np.multiply(around[:, kind.left :], ahead < right[:, None], out=out[:, : kind.window])
    out[:, kind.window] = right
    np.multiply(around[:, kind.left - 1 :: -1], behind < left[:, None], out=out[:, kind.window + 1 : kind.window + 1 + kind.left])
    out[:, kind.window + 1 + kind.left] = left
    return out


def as_keys(kind: Kind, rows: np.ndarray) -> np.ndarray:
    """Rows of tokens as numbers to sort by: eight bytes make one that sorts as they do."""
    return rows.view(">u8").astype(U64) if kind.bytewise else rows


def as_rows(kind: Kind, keys: np.ndarray) -> np.ndarray:
    return keys.astype(">u8").view(np.uint8) if kind.bytewise else keys


def pieces(kind: Kind, docs: Iterable[np.ndarray]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Documents gathered into pieces of about PIECE tokens: (indexes, offsets in the documents, tokens)."""
    index, offset, parts, held = [], [], [], 0
    for i, t in enumerate(docs):
        for at in range(0, max(len(t) - kind.window + 1, 0), PIECE):
            part = t[at : at + PIECE + kind.window - 1]
            index.append(i)
            offset.append(at)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield index, offset, parts
                index, offset, parts, held = [], [], [], 0
    if parts:
        yield index, offset, parts


def records(kind: Kind, ids: np.ndarray, ties: np.ndarray, docs: Iterable[np.ndarray], share: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The contexts of a batch's documents, a piece at a time: keys, and IDS, of which ``at`` is the first window."""
    for index, offset, parts in pieces(kind, docs):
        tokens = np.concatenate(parts)
        starts = np.r_[0, np.cumsum([len(p) for p in parts])]
        d, anchor, begin, end = sampled(kind, tokens, starts, share)
        own = np.zeros(len(d), IDS)
        row = np.array(index)[d]
        own["doc"], own["tie"] = ids[row], ties[row]
        own["at"] = begin - starts[d] + np.array(offset)[d]
        yield as_keys(kind, rows_of(kind, tokens, anchor, begin, end)), own


def gathered(kind: Kind, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, ids = zip((np.zeros((0, kind.columns), U64), np.zeros(0, IDS)), *parts, strict=True)
    return np.concatenate(keys), np.concatenate(ids)


# Packets


def pack(r: np.ndarray) -> bytes:
    """Columns one after another, bytes of equal weight together, so that they compress."""
    planes = b"".join(np.ascontiguousarray(r[n]).view(np.uint8).reshape(len(r), -1).T.tobytes() for n in r.dtype.names)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype: list) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // np.dtype(dtype).itemsize
    r, at = np.zeros(n, dtype), 0
    for name, code in dtype:
        width = np.dtype(code).itemsize
        r[name] = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(code).reshape(n)
        at += n * width
    return r


def pack_rows(rows: np.ndarray, ids: np.ndarray) -> bytes:
    """Rows of tokens, of numbers the 6 bytes that they use, and their IDS."""
    sent = rows if rows.dtype == np.uint8 else np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8)[:, :, :6]
    own = pack(ids)
    return len(own).to_bytes(4, "little") + own + zstandard.ZstdCompressor(level=2).compress(np.ascontiguousarray(sent).tobytes())


def unpack_rows(data: bytes, bytewise: bool) -> tuple[np.ndarray, np.ndarray]:
    size = 4 + int.from_bytes(data[:4], "little")
    ids = unpack(data[4:size], IDS)
    sent = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[size:]), np.uint8).reshape(len(ids), -1)
    if bytewise:
        return sent, ids
    wide = np.zeros((len(ids), sent.shape[1] // 6, 8), np.uint8)
    wide[:, :, :6] = sent.reshape(len(ids), -1, 6)
    return wide.view(U64)[:, :, 0], ids


def packets(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["kind", "bucket", "packet"])


def deal(r: np.ndarray, bucket: np.ndarray, name: str) -> Iterator[tuple[str, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    r, bucket = r[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(r) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(r)] if len(r) else [], strict=True):
        yield name, int(bucket[a]), pack(r[a:b])


def by_document(s: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(s["doc"].astype(U64)) % U64(buckets)).astype(np.int64)


# Sorting


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: sort by the first column, then each run of equals by the next, while there are runs. Gives the
    order, and which rows equal the one before them in all columns."""
    order = np.argsort(np.ascontiguousarray(keys[:, 0]), kind="quicksort")
    same = np.zeros(len(order), bool)
    k = keys[order, 0]
    same[1:] = k[1:] == k[:-1]
    for column in range(1, keys.shape[1]):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        run = np.cumsum(~same)[rows]
        values = keys[order[rows], column]
        inner = np.lexsort((values, run))
        order[rows] = order[rows][inner]
        values = values[inner]
        same[rows[1:]] &= (values[1:] == values[:-1]) & (run[1:] == run[:-1])
    return order, same


def lower_bounds(keys: np.ndarray, rows: np.ndarray) -> list[int]:
    """How many of the sorted keys are less than each of ``rows``."""
    first = np.ascontiguousarray(keys[:, 0])
    found = []
    for row, low, high in zip(rows, np.searchsorted(first, rows[:, 0], "left").tolist(), np.searchsorted(first, rows[:, 0], "right").tolist(), strict=True):
        for k in range(1, len(row)):
            if low == high:
                break
            part = keys[low:high, k]
            low, high = low + int(np.searchsorted(part, row[k], "left")), low + int(np.searchsorted(part, row[k], "right"))
        found.append(low)
    return found


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading tokens each pair of rows has in common."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def neighbours(rows: np.ndarray) -> np.ndarray:
    """For rows in sorted order, how many leading tokens each shares with the nearer of the rows before and after it: as
    many as with any other row."""
    common = agree(rows[1:], rows[:-1]) if len(rows) > 1 else np.zeros(0, np.int64)
    return np.maximum(np.r_[0, common], np.r_[common, 0]) if len(rows) else common


def settled(kind: Kind, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts in order, the number of each one's run of equals, and which of them are repeats in all their windows."""
    order, same = multikey_order(keys)
    keys, ids, run = keys[order], ids[order], np.cumsum(~same) - 1
    if not len(ids):
        return keys, ids, run, same
    starts = np.flatnonzero(~same)
    if kind.earlier:
        return keys, ids, run, ids["doc"] > np.minimum.reduceat(ids["doc"], starts)[run]
    return keys, ids, run, ((np.bincount(run) > 1) | (np.maximum.reduceat(ids["many"], starts) > 0))[run]


# Spans


def merged(s: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document as one."""
    if not len(s):
        return s
    s = s[np.lexsort((s["at"], s["tie"], s["doc"]))]
    new = np.r_[True, (s["doc"][1:] != s["doc"][:-1]) | (s["tie"][1:] != s["tie"][:-1])]
    base = np.cumsum(new) << 33  # documents apart, so that one running maximum serves all
    end = np.maximum.accumulate(base + s["at"].astype(np.int64) + s["size"])
    first = np.flatnonzero(np.r_[True, base[1:] + s["at"][1:] > end[:-1]])
    out = s[first]
    out["size"] = end[np.r_[first[1:], len(s)] - 1] - base[first] - s["at"][first]
    return out


def spans(ids: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(ids), SPAN)
    out["doc"], out["tie"], out["at"], out["size"] = ids["doc"], ids["tie"], at, size + ids["more"].astype(np.int64)
    return merged(out)


def collapsed(kind: Kind, number: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the records to keep, sorted so that equal contexts share a number: one for each stretch of equal contexts of a
    document, no two neighbours of which are more than a window apart, so that whatever repeats in one repeats in all and
    covers them without a gap. A run of one byte or of a short period is a record, however long it is."""
    at = np.flatnonzero(keep)
    own = ids[at]
    order = np.lexsort((own["at"], own["tie"], own["doc"], number[at]))
    at, own = at[order], own[order]
    n, start, reach = number[at], own["at"].astype(np.int64), own["at"].astype(np.int64) + own["more"]
    new = np.r_[True, (n[1:] != n[:-1]) | (own["doc"][1:] != own["doc"][:-1]) | (own["tie"][1:] != own["tie"][:-1]) | (start[1:] - reach[:-1] > kind.window)][: len(at)]
    first = np.flatnonzero(new)
    out = own[first]
    if len(first):
        out["more"] = np.maximum.reduceat(reach, first) - start[first]
    order = np.argsort(at[first], kind="stable")
    return at[first][order], out[order]


def sides(kind: Kind, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each context has from its anchor on, and before it."""
    at = kind.window, kind.window + 1 + kind.left
    if kind.bytewise:
        return tuple(((keys[:, k // 8] >> U64(56 - 8 * (k % 8))) & U64(255)).astype(np.int64) for k in at)
    return tuple(keys[:, k].astype(np.int64) for k in at)


# A range's contexts


class Contexts:
    """Unlike contexts in sorted order with what is known of each: ``value`` is the least doc_id of its copies if earlier
    documents count, else whether it has several. A window is named by a context's row and by how many of its tokens lie
    before the anchor."""

    def __init__(self, kind: Kind, keys: np.ndarray, value: np.ndarray):
        rows = as_rows(kind, keys)
        w, g = kind.window, kind.gram
        self.kind, self.value = kind, value
        self.right, self.n_right = rows[:, :w], rows[:, w].astype(np.int64)
        self.left, self.n_left = rows[:, w + 1 : w + 1 + kind.left], rows[:, w + 1 + kind.left].astype(np.int64)
        self.far = np.minimum(neighbours(self.right), self.n_right)
        gram = self.right[:, :g]
        self.run = np.cumsum(np.r_[True, (gram[1:] != gram[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
        self.back = np.zeros(len(rows), np.int64)
        # Only contexts with room for a window in what they share with a neighbour can share one at all.
        some = np.flatnonzero(self.far + self.n_left >= w)
        if len(some):
            order, lengths = self.by_left(some)
            self.back[some[order]] = np.minimum(lengths, self.n_left[some[order]])
        self.some = some[self.far[some] + self.back[some] >= w]

    def by_left(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of rows by k-gram and then by what lies before it, and how far each agrees there with its neighbours."""
        left = np.zeros((len(some), -(-(1 + self.left.shape[1]) // 8) * 8 if self.kind.bytewise else self.left.shape[1]), self.kind.token)
        left[:, : self.left.shape[1]] = self.left[some]
        order, _ = multikey_order(np.column_stack([self.run[some].astype(U64), as_keys(self.kind, left)]))
        sorted_left, run = self.left[some][order], self.run[some][order]
        common = np.where(run[1:] == run[:-1], agree(sorted_left[1:], sorted_left[:-1]), 0)
        return order, np.maximum(np.r_[0, common], np.r_[common, 0])

    def windows(self, some: np.ndarray, far: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tokens before the anchor) of the windows of rows ``some`` that hold at most ``back`` tokens before and ``far``
        from the anchor on."""
        low = np.maximum(self.kind.window - far, 0)
        count = np.maximum(np.minimum(back, self.kind.left) - low + 1, 0)
        row = np.repeat(some, count)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count - low, count)

    def tokens(self, row: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The windows' own tokens, a row each."""
        whole = np.concatenate([self.left[row, ::-1], self.right[row]], axis=1)
        return whole[np.arange(len(row))[:, None], (self.kind.left - before)[:, None] + np.arange(self.kind.window)]


def numbered(kind: Kind, tokens: np.ndarray) -> np.ndarray:
    """A number for each window, equal for equal tokens, by multikey quicksort."""
    if kind.bytewise:
        wide = np.zeros((len(tokens), -(-kind.window // 8) * 8), np.uint8)
        wide[:, : kind.window] = tokens
        tokens = as_keys(kind, wide)
    order, same = multikey_order(tokens)
    number = np.zeros(len(tokens), np.int64)
    number[order] = np.cumsum(~same) - 1
    return number


#: Windows that are compared at once.
AT_ONCE = 200_000


def repeated_of(c: Contexts, row: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which of the windows are repeats among themselves. They are taken in shares by a hash of their tokens."""
    out = np.zeros(len(row), bool)
    if not len(row):
        return out
    if len(row) <= AT_ONCE:
        shares = [np.arange(len(row))]
    else:
        parts = range(0, len(row), AT_ONCE)
        share = np.concatenate([hashed(c.tokens(row[a : a + AT_ONCE], before[a : a + AT_ONCE])) for a in parts]) % U64(len(row) // AT_ONCE + 1)
        shares = [np.flatnonzero(share == k) for k in range(len(row) // AT_ONCE + 1)]
    for at in shares:
        if len(at):
            number, value = numbered(c.kind, c.tokens(row[at], before[at])), c.value[row[at]]
            if c.kind.earlier:
                least = np.full(number.max() + 1, LAST)
                np.minimum.at(least, number, value)
                out[at] = value > least[number]
            else:
                out[at] = (np.bincount(number, weights=1 + value) > 1)[number]
    return out


def hashed(tokens: np.ndarray) -> np.ndarray:
    h = np.zeros(len(tokens), U64)
    for k in range(tokens.shape[1]):
        h = h * U64(0x9E3779B97F4A7C15) + tokens[:, k]
    return mixed(h)


def edge_windows(c: Contexts, borders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, tokens before the anchor) of the windows that may stand in a neighbouring range too: those of contexts that
    agree with a splitter inside their run of k-grams as far as the window reaches."""
    far = np.zeros(len(c.n_right), np.int64)
    for b in borders:
        near = np.flatnonzero((c.right[:, : c.kind.gram] == b[: c.kind.gram]).all(axis=1))
        far[near] = np.maximum(far[near], np.minimum(agree(c.right[near], b[None, : c.kind.window]), c.n_right[near]))
    some = np.flatnonzero(far + c.n_left >= c.kind.window)
    return c.windows(some, far[some], c.n_left[some])


def in_range(kind: Kind, keys: np.ndarray, ids: np.ndarray, borders: list[np.ndarray], buckets: int) -> Iterator[tuple[str, int, bytes]]:
    """Step 2 for one range: packets of spans by document, and of windows for step 3 by their tokens."""
    keys, ids, run, gone = settled(kind, keys, ids)
    right, left = sides(kind, keys)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    value = np.minimum.reduceat(ids["doc"], starts) if kind.earlier else gone[starts].astype(np.int64)
    c = Contexts(kind, keys[starts], value)
    del keys
    s = spans(ids[gone], ids["at"][gone], (right + left)[gone])
    yield from deal(s, by_document(s, buckets), "span")
    # Every copy that is not settled yet has its context's windows.
    owners = np.flatnonzero(~gone)
    placed = Copies(ids, owners, np.searchsorted(run[owners], np.arange(len(starts) + 1)), starts, left)
    row, low, high = stretches(*kind.repeats(c))
    at, which = placed.of(row)
    s = spans(ids[at], ids["at"][at] + left[at] - high[which], kind.window + (high - low)[which])
    yield from deal(s, by_document(s, buckets), "span")
    row, before = edge_windows(c, borders)
    for a in range(0, len(row), AT_ONCE):
        tokens, own = edge_rows(c, placed, row[a : a + AT_ONCE], before[a : a + AT_ONCE])
        bucket = (hashed(tokens) % U64(buckets)).astype(np.int64)
        for k in np.unique(bucket):
            yield "edge", int(k), pack_rows(tokens[bucket == k], own[bucket == k])


def stretches(row: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, sorted by row and tokens before the anchor, as runs of neighbours: row, least and greatest such number."""
    if not len(row):
        return row, before, before
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (before[1:] != before[:-1] + 1)])
    return row[first], before[first], before[np.r_[first[1:], len(row)] - 1]


@dataclass
class Copies:
    """Where a range's contexts stand: ``ids`` of all its records in order; ``owners``, those not settled, of which context k
    has those from first[k] to first[k + 1]; and each context's first record."""

    ids: np.ndarray
    owners: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    left: np.ndarray

    def of(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unsettled records of each context in ``row``, and whose they are."""
        count = self.first[row + 1] - self.first[row]
        which = np.repeat(np.arange(len(row)), count)
        return self.owners[self.first[row][which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]], which


def edge_rows(c: Contexts, placed: Copies, row: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a range says of the windows: of equal ones those in the least document (all its places), or one, marked if there
    are several."""
    tokens = c.tokens(row, before)
    number = numbered(c.kind, tokens)
    if c.kind.earlier:
        least = np.full(number.max() + 1, LAST)
        np.minimum.at(least, number, c.value[row])
        send = np.flatnonzero(c.value[row] == least[number])
        at, which = placed.of(row[send])
    else:
        several = np.bincount(number, weights=1 + c.value[row]) > 1
        send = np.unique(number, return_index=True)[1]
        at, which = placed.starts[row[send]], np.arange(len(send))
    send = send[which]
    own = placed.ids[at]
    own["at"] += (placed.left[at] - before[send]).astype(np.uint32)
    if not c.kind.earlier:
        own["many"] = several[number[send]]
    return tokens[send], own


# The jobs


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def context_packets(kind: Kind, docs: DataFrame, splitters: np.ndarray, buckets: int, share: int) -> DataFrame:
    """Step 1: packets of contexts by range, and of the spans that a batch settles by itself by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        most, size = HELD // (8 * kind.columns), 0

        def flush() -> pa.RecordBatch:
            keys, ids, number, gone = settled(kind, *gathered(kind, held))
            held.clear()
            keep = ~gone
            if not kind.earlier:  # one of several equals stays, marked
                first = np.r_[True, number[1:] != number[:-1]]
                ids["many"] |= (gone & first).astype(np.uint8)
                keep |= first
            right, left = sides(kind, keys)
            s = spans(ids[gone], ids["at"][gone], (right + left)[gone])
            if kind.earlier:
                at, ids = collapsed(kind, number, ids, keep)
                keys = keys[at]
            else:
                keys, ids = keys[keep], ids[keep]
            cuts = [0, *lower_bounds(keys, splitters), len(ids)]
            rows = [("context", k, pack_rows(as_rows(kind, keys[a:b]), ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return packets([*rows, *deal(s, by_document(s, buckets), "span")])

        for batch in batches:
            doc, ties = columns_of(batch)
            for part in records(kind, doc, ties, (kind.tokens(x.as_py()) for x in batch.column(2)), share):
                held.append(part)
                size += len(part[1])
                if size >= most:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, PACKETS)


def range_packets(kind: Kind, dealt: DataFrame, splitters: np.ndarray, inside: np.ndarray, buckets: int) -> DataFrame:
    """Step 2: each range's spans and edge windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        number = -1
        for batch in batches:
            for name, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name == "span":
                    yield packets([(name, bucket, data)])
                else:
                    number = bucket
                    rows, ids = unpack_rows(data, kind.bytewise)
                    found.append((as_keys(kind, rows), ids))
        if found:
            borders = [as_rows(kind, splitters[k]) for k in (number - 1, number) if 0 <= k < len(splitters) and inside[k]]
            keys, ids = gathered(kind, found)
            found.clear()
            for packet in in_range(kind, keys, ids, borders, buckets):
                yield packets([packet])
        pa.default_memory_pool().release_unused()

    return dealt.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, PACKETS)


def edge_spans(kind: Kind, rows: DataFrame, buckets: int) -> DataFrame:
    """Step 3: windows of cut runs, compared across ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack_rows(x, kind.bytewise) for b in batches for x in b.column(1).to_pylist()]
        if not found:
            return
        tokens, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        number = numbered(kind, tokens)
        if kind.earlier:
            least = np.full(number.max() + 1, LAST)
            np.minimum.at(least, number, ids["doc"])
            again = ids["doc"] > least[number]
        else:
            again = (np.bincount(number, weights=1.0 + ids["many"]) > 1)[number]
        s = spans(ids[again], ids["at"][again], kind.window)
        for packet in deal(s, by_document(s, buckets), "span"):
            yield packets([packet])

    edges = rows.filter("kind = 'edge'").select("bucket", "packet")
    return edges.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, PACKETS)


def per_document(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc, tie, list binary): each document's spans from its packets, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(x, SPAN) for b in batches for x in b.column(0).to_pylist()]
        if not found:
            return
        r = merged(np.concatenate(found))
        cuts = np.flatnonzero(np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["tie"][1:] != r["tie"][:-1])])
        ends = np.r_[cuts[1:], len(r)]
        for at in range(0, len(cuts), 4096):
            a, z = cuts[at : at + 4096], ends[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc"][a]), pa.array(r["tie"][a].astype(np.int64)), pa.array([r[x:y].tobytes() for x, y in zip(a, z, strict=True)], pa.binary())], ["doc", "tie", "list"])

    spans_only = rows.filter("kind = 'span'").select("packet", "bucket").repartitionById(buckets, F.col("bucket").cast("int"))
    return spans_only.select("packet").mapInArrow(run, "doc long, tie long, list binary")


#: Sampled contexts for each range border, and documents that they come from.
PER_BORDER, SAMPLED_DOCS = 24, 1000


def sampled_splitters(kind: Kind, docs: DataFrame, count: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Range borders by distinct contexts of about SAMPLED_DOCS documents, or more where ranges are many, and which of them lie inside a run of one k-gram.
    A sampled text gives contexts of its first 64 KiB: that moves borders, which only sets how evenly ranges fill, and no
    result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ties = columns_of(batch)
            keys, _ = gathered(kind, records(kind, doc, ties, (kind.tokens(x.as_py()[:65536]) for x in batch.column(2))))
            keys = keys[:: len(keys) // (each * max(len(doc), 1)) + 1]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in keys], pa.binary())], ["row"])

    wanted = max(SAMPLED_DOCS, buckets // 8)
    share, each = max(1, count // wanted), PER_BORDER * buckets // wanted + 1
    found = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).mapInArrow(run, "row binary").distinct().toArrow().column(0).to_pylist()
    keys = np.frombuffer(b"".join(found), U64).reshape(-1, kind.columns)
    if not len(keys):
        return np.zeros((buckets - 1, kind.columns), U64), np.zeros(buckets - 1, bool)
    whole = as_rows(kind, keys[multikey_order(keys)[0]][(np.arange(1, buckets) * len(keys) / buckets).astype(int)])
    inside = np.r_[False, (whole[1:, : kind.gram] == whole[:-1, : kind.gram]).all(axis=1)][: len(whole)]
    whole[~inside, kind.gram :] = 0  # back to the start of its run
    return as_keys(kind, whole), inside


def repeated_spans(kind: Kind, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, doc, tie, text), and (doc, tie, list binary of SPAN): the tokens of each document that
    repeated windows cover; documents without any have no row there. Rows with one doc_id and one text share their spans;
    each of them counts as a place of its own."""
    docs = texts(documents).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
    count, size, ids = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_distinct("doc")).first()
    # Where every row has its own doc_id, nothing else is needed to tell rows apart.
    docs = docs.withColumn("tie", F.lit(0).cast("long") if ids == count else tie().bitwiseAND(F.lit((1 << 32) - 1)))
    read = docs.select("doc", "tie", "text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (RANGE_BYTES * PASSES) + 1)
    splitters, inside = sampled_splitters(kind, read, count, buckets)
    found = []
    for share in range(PASSES):
        dealt = context_packets(kind, read, splitters, buckets, share)
        first = written(range_packets(kind, dealt, splitters, inside, buckets), "ranges")
        # Written, so that no stage runs two Python maps, each with a worker of its own, at once.
        found += [first.filter("kind = 'span'"), written(edge_spans(kind, first, buckets), "edges")]
    return docs, per_document(functools.reduce(DataFrame.unionByName, found), buckets)
