"""Fill-in-middle transformation: a text is cut at two places into prefix, middle and suffix, which are put in another order
behind marks, so that a model learns to fill in the middle.

Places are counted in units: code points, or words with the whitespace after them. A Fenwick tree over blocks of BLOCK bytes
stores how many units and how many code points start in each; a cut is found by binary-lifting descent to its block and then
inside that block alone, so that a text is never decoded or split as a whole.

Nulls: a null text is an empty one, and a null doc_id has the digest of no digits. Empty texts stay plain and texts that hold a
mark do too. Texts of any length are taken whole, in memory of a few times one text; repeated rows are treated alike, each for
itself. An empty table gives no rows. Columns besides doc_id and text are left out, whatever their names. Bytes that are no
UTF-8 stay as they are: a code point starts at each byte that is no continuation byte, and at the first byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, texts

BLOCK = 1 << 12
#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])


def code_point_starts(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which of a block's bytes start a code point; ``before`` is the byte before the block, if there is one."""
    starts = (block & 0xC0) != 0x80
    if len(block) and not len(before):
        starts[0] = True
    return starts


def word_starts(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which of a block's bytes start a unit of one word and the whitespace after it; the text's first unit has what stands
    before its word too, and is found by ``Blocks``."""
    space = _SPACE[block]
    return ~space & np.r_[_SPACE[before[-1:]] if len(before) else True, space[:-1]]


UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"code_points": code_point_starts, "words": word_starts}


class Blocks:
    """A text's blocks under a Fenwick tree: entry i holds the counts of the ``i & -i`` blocks that end with block i."""

    def __init__(self, text: bytes, unit: str = "code_points", size: int = BLOCK):
        self.bytes, self.size, self.starts = np.frombuffer(text, np.uint8), size, UNITS[unit]
        self.count = -(-len(text) // size)
        counts = np.zeros((self.count + 1, 2), np.int64)
        for k in range(self.count):
            block, before = self.block(k)
            points = code_point_starts(block, before)
            counts[k + 1] = np.count_nonzero(points) if unit == "code_points" else np.count_nonzero(self.unit_starts(k)), np.count_nonzero(points)
        upto = counts.cumsum(axis=0)
        places = np.arange(self.count + 1)
        self.tree = upto - upto[places - (places & -places)]
        self.units, self.points = (int(x) for x in upto[-1])

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = k * self.size
        return self.bytes[at : at + self.size], self.bytes[max(at - 1, 0) : at]

    def unit_starts(self, k: int) -> np.ndarray:
        """Where units start in a block. The first unit starts at the text's first byte, also where that is whitespace: then
        the first word's own start is none."""
        starts = self.starts(*self.block(k))
        if self.starts is word_starts and _SPACE[self.bytes[0]]:
            if self.first_word // self.size == k:
                starts[self.first_word % self.size : self.first_word % self.size + 1] = False
            if k == 0:
                starts[0] = True
        return starts

    @functools.cached_property
    def first_word(self) -> int:
        """Where the first word starts; the text's length if there is none."""
        for at in range(0, len(self.bytes), self.size):
            found = np.flatnonzero(~_SPACE[self.bytes[at : at + self.size]])
            if len(found):
                return at + int(found[0])
        return len(self.bytes)

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which so many units end."""
        if units >= self.units:
            return len(self.bytes), self.points
        at, left, points, step = 0, units, 0, 1 << max(self.count.bit_length() - 1, 0)
        while step:  # the last block before which no more than ``units`` units start
            if at + step <= self.count and self.tree[at + step, 0] <= left:
                at += step
                left -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        inside = int(np.flatnonzero(self.unit_starts(at))[left])
        return at * self.size + inside, points + int(np.count_nonzero(code_point_starts(*self.block(at))[:inside]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(docs: DataFrame, unit: str = "code_points", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text with its n units in the order of its form. ``rate`` of
    100 texts are transformed, ``spm`` of 100 of them with the suffix first; the others, empty texts and texts that hold a mark
    are plain, without counts of characters."""
    p, s, m = (x.encode() for x in marks)

    def one(doc_id: int | None, text: bytes) -> tuple:
        h1, h2, h3, h4 = draws(doc_id, seed)
        blocks = Blocks(text, unit)
        n = blocks.units
        if not text or h3 % 100 >= rate or any(x in text for x in (p, s, m)):
            return n, "plain", None, None, text
        (a, a_chars), (z, z_chars) = map(blocks.cut, sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:z], text[z:]
        form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
        return n, form, a_chars, z_chars - a_chars, b"".join(parts)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [one(k.as_py(), t.as_py()) for k, t in zip(batch.column(0), batch.column(1), strict=True)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = map_arrow(texts(docs), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A mark stands once in an output that isn't plain, as the text holds none, and none
    begins inside another or where a text ends, as long as only its first character is ``<``."""
    p, s, m = (F.lit(x) for x in marks)
    after = lambda x, mark: F.split_part(x, mark, F.lit(2))
    before = lambda x, mark: F.split_part(x, mark, F.lit(1))

    def parts(x: Column) -> Column:
        psm = F.concat(before(after(x, p), s), after(x, m), before(after(x, s), m))
        spm = F.concat(before(after(x, p), m), after(x, m), before(after(x, s), p))
        return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(x)

    # Bytes that are no UTF-8 are split as characters of one byte each.
    single = F.encode(parts(F.decode(output.cast("binary"), "ISO-8859-1")), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(output), parts(output)).otherwise(single)


def digests(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Outputs and the texts rebuilt from them, as their SHA-256."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))
