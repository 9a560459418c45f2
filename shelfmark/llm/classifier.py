"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Training takes at most ``train_rows`` labelled rows (the first by a hash of doc_id, a documented bound), deals them to a few
shards, runs FTRL-proximal updates over each, and averages the shards' weights by bucket. Scoring adds up the weights of
every n-gram of a whole text as a sparse dot product: features are word 1- and 2-grams, each counted by its share of the
text, so that long texts do not saturate.

Empty tables give no rows, texts of any length are read whole, and other columns are left out, whatever their names.
A null or empty text has the intercept alone and gets its score. Without labelled rows every weight is 0 and every score
0.5. Rows of labels without a document, or with a null label, are left out; a document labelled twice counts twice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, mixed, texts, written

BITS = 18
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS, SHARDS, TRAIN_ROWS = 4, 4, 12_000
#: Runs of letters, digits and bytes of other alphabets, and runs of ASCII punctuation.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
#: Scales a text's n-gram shares, as FTRL's steps suit features around 1.
SCALE = 30.0


class WordTable(dict):
    """word bytes -> 64-bit hash, filled on first use and emptied when full, so that its memory stays bounded."""

    def __init__(self, limit: int = 100_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest = limit, longest

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def features(data: bytes, words: WordTable, bits: int = BITS) -> np.ndarray:
    """Buckets of all word 1- and 2-grams, as often as they occur; a 2-gram that came before in the text also counts in the
    bucket of one mark, so that its share tells how much a text repeats itself."""
    w = words.hashes(_WORD.findall(data))
    pairs = mixed(w[:-1] * U64(0x9E3779B97F4A7C15) + w[1:]) if len(w) > 1 else w[:0]
    again = np.full(len(pairs) - len(np.unique(pairs)), xxhash.xxh3_64_intdigest(b"\0again"), U64)
    return (np.concatenate([w, pairs, again]) & U64((1 << bits) - 1)).astype(np.int64)


def example(data: bytes, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their values."""
    at, count = np.unique(features(data, words), return_counts=True)
    return at, count * (SCALE / max(count.sum(), 1))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        x = z[at]
        return np.where(np.abs(x) <= L1, 0.0, -(x - np.sign(x) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            at, value = examples[i]
            w = weights(at)
            gap = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30))) - labels[i]
            g = gap * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += gap * gap
            bias -= 0.1 * gap / (1 + np.sqrt(bias_n))
    return weights(np.arange(1 << BITS)), bias


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The averaged model. The driver and each broadcast hold 2^BITS weights, or the ids of ``train_rows`` rows."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(train_rows)
    )
    ids = written(chosen, "labels")
    rows = texts(docs).join(F.broadcast(ids) if train_rows <= 100_000 else ids, "doc_id")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = WordTable(), []
        for batch in batches:
            for doc, data, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append((zlib.crc32(str(doc).encode()), doc, example(data, words), label))
        found.sort(key=lambda x: (x[0], x[1], x[3], x[2][0].tobytes()))
        if found:
            w, bias = train([x[2] for x in found], [x[3] for x in found])
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(w[at], bias))], ["bucket", "weight"])

    dealt = rows.select("doc_id", "text", "label").repartition(SHARDS, (F.crc32(F.col("doc_id").cast("string")) / 3).cast("int"))
    total = dealt.mapInArrow(shard, "bucket long, weight double").groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    shards = max([1, *(r.n for r in total if r.bucket < 0)])
    w = np.zeros(1 << BITS, np.float32)
    for r in total:
        if r.bucket >= 0:
            w[r.bucket] = r.weight / shards
    return w, sum(r.weight for r in total if r.bucket < 0) / shards


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), words = shared.value, WordTable()
        for batch in batches:
            found = []
            for data in batch.column(1):
                at = features(data.as_py(), words)
                found.append(bias + SCALE * float(weights[at].sum(dtype=np.float64)) / max(len(at), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(found, np.float64), -30, 30))))], ["doc_id", "score"])

    rows = texts(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
