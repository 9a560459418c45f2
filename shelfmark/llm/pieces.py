"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model has a whitespace marker after another character, merges never cross the start of a run of
markers, so a text's ids are the ids of its marked words in order. Each task segments a distinct marked word once through
the library, keeps it in a table, and joins ids back by position. A model without that property is run on whole texts.

Null and empty texts give the end id alone and decode to an empty text. Empty tables give no rows, texts of any length are
encoded whole, and rows that repeat another are encoded alike; other columns are kept or left out, whatever their names. The table forgets what was not asked for lately,
which costs time and changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import texts

MARK = "▁"
MARKS = " " + MARK
#: A run of markers with what follows up to the next run.
CHUNKS = re.compile("[ ▁]+[^ ▁]*")
#: Code points of the texts whose chunks are looked up together.
SLICE = 1_000_000


class ChunkTable:
    """The chunks seen lately and their ids, as text with a space before each: when half of ``limit`` is new, what was not asked
    for since the last time goes. A chunk of one marker is named by the word behind it, others by themselves; where a chunk
    does not decode to itself, the decoded text stands beside its ids."""

    def __init__(self, model_file: str, limit: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.limit = limit
        self.new: dict[str, str | tuple[str, str]] = {}
        self.old: dict[str, str | tuple[str, str]] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # The library's own normalization has to leave texts alone but for the markers and the one added in front.
        probe = "  ① ﬁ é\t\n　x  "
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.model.decode(self.model.encode(probe)) == probe
        self.lead = self.model.encode("a")
        self.begins = np.array([p.startswith(MARK) for p in pieces])
        self.written = [f" {i}" for i in range(len(pieces))]

    def fill(self, keys: set[str]) -> None:
        """Have all of ``keys`` in ``new``; words never seen are segmented as one text, in which a piece with a marker begins
        each, and are so cut apart again."""
        if len(self.new) > self.limit // 2:
            self.new, self.old = {}, self.new
        missing = [c for c in keys if c not in self.new]
        self.new.update((c, self.old[c]) for c in missing if c in self.old)
        unseen = [c for c in missing if c not in self.old]
        words = [c for c in unseen if c and c[0] not in MARKS]
        text = "a " + " ".join(words)
        ids = self.model.encode(text)
        starts = np.flatnonzero(self.begins[ids[len(self.lead) :]]) + len(self.lead) if words else []
        if len(starts) != len(words) or self.model.decode(ids) != text:
            words = []  # some word is not a chunk of its own, or does not decode to itself
        if words:
            named = self.written
            for word, a, z in zip(words, starts, [*starts[1:], len(ids)], strict=True):
                self.new[word] = "".join([named[i] for i in ids[a:z]])
        others = unseen if not words else [c for c in unseen if not c or c[0] in MARKS]
        # Encoded behind the letter "a" and its marker, so that no marker is added in front of the chunk itself.
        chunks = ["a" + (c if c and c[0] in MARKS else " " + c) for c in others]
        found = [x[len(self.lead) :] for x in self.model.encode(chunks, num_threads=1)] if chunks else []
        texts = self.model.decode([self.lead + x for x in found], num_threads=1) if chunks else []
        for c, x, t in zip(others, found, texts, strict=True):
            ids_text = "".join([self.written[i] for i in x])
            self.new[c] = ids_text if t[1:] == " " + c else (ids_text, t[1:])

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids in decimal joined by spaces, with the end id, and the text that they decode to."""
        if not self.splits:
            every = self.model.encode(texts, add_eos=True, num_threads=1)
            return [(" ".join(map(str, ids)), self.model.decode(ids)) for ids in every]
        # The library puts one marker in front of a text: it joins a leading run of spaces or starts the first word.
        split = [words_of(t) for t in texts]
        self.fill(set().union(*split))
        out, end, table = [], " " + str(self.model.eos_id()), self.new
        for t, keys in zip(texts, split, strict=True):
            try:
                out.append((("".join(map(table.__getitem__, keys)) + end)[1:], t.replace(MARK, " ")))
            except TypeError:  # a pair among them
                pairs = [(x, " " + c) if isinstance(x, str) else x for c in keys for x in (table[c],)]
                out.append((("".join([x[0] for x in pairs]) + end)[1:], "".join([x[1] for x in pairs])[1:]))
        return out


def words_of(text: str) -> list[str]:
    """The names of a text's chunks."""
    if not text:
        return []
    if text[0] not in MARKS and "  " not in text and MARK not in text:
        return text.split(" ")
    chunks = CHUNKS.findall(" " + text)
    return [c[1:] if len(c) == 1 or c[1] not in MARKS else c for c in chunks]


def sliced(texts: Iterator[str]) -> Iterator[list[str]]:
    """The texts in lists of about SLICE code points."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and of ``ids`` and ``decoded`` those that ``keep`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        for batch in batches:
            at = 0
            for part in sliced(x.as_py().decode("utf-8", "replace") for x in batch.column(1)):
                out: list[tuple] = []
                for ids, text in table.encode(part):
                    more = {"ids": lambda: np.fromstring(ids, np.int32, sep=" "), "decoded": lambda: text}  # noqa: B023
                    out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *(more[k]() for k in keep)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(x, k) for x, (_, k) in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])
                at += len(part)
        pa.default_memory_pool().release_unused()

    types = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((k, types[k][1]) for k in keep)]
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {types[k][0]}" for k in keep))
