"""A linear intent model over hashed words, letter trigrams and word pairs, trained here and scored in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import MARKERS, routes

INTENTS = ["ExactSearch", "FuzzySearch", "RelatedSearch", "ContentSearch", "CleanupAnalysis", "WebLookup", "Help", "Unknown"]
BUCKETS = 2_048
#: Fixed values of FNV-1a with 64 bits.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


#: Fixed values of a model file: its first bytes, version, and bytes before the weights.
MAGIC, VERSION, HEADER = b"STAI1\0\0\0", 1, 64


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h


def fnv1a_all(names: list[bytes]) -> np.ndarray:
    """``fnv1a`` of each name, a byte of all names at a time."""
    size = np.array([len(n) for n in names], np.int64)
    wide = np.zeros((len(names), int(size.max(initial=0))), np.uint64)
    for k, n in enumerate(names):
        wide[k, : len(n)] = np.frombuffer(n, np.uint8)
    h = np.full(len(names), OFFSET, np.uint64)
    for k in range(wide.shape[1]):
        h = np.where(size > k, (h ^ wide[:, k]) * np.uint64(PRIME), h)
    return h


def buckets(query: str, size: int = BUCKETS) -> list[int]:
    """The distinct buckets of the whole text: each word and its trigrams, then neighbouring words."""
    words = "".join(c.lower()[:1] if c.isalnum() else " " for c in query).split()
    names = [n for w in words for n in ["w:" + w, *("c3:" + w[i : i + 3] for i in range(len(w) - 2))]]
    names += [f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False)]
    return list(dict.fromkeys((fnv1a_all([n.encode() for n in names]) % np.uint64(size)).tolist()))


@dataclass
class Model:
    weights: np.ndarray  # (intents, BUCKETS), whole numbers of 8 bits
    biases: np.ndarray

    @classmethod
    def blank(cls) -> Model:
        return cls(np.zeros((len(INTENTS), BUCKETS), np.int64), np.zeros(len(INTENTS), np.int64))

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        """A stored model. Raises ValueError for other files, other versions, and sizes that do not fit each other."""
        if len(data) < HEADER or data[:8] != MAGIC:
            raise ValueError("not a model file")
        number = lambda at, n: int.from_bytes(data[at : at + n], "little")
        classes, size = number(10, 2), number(12, 4)
        if number(8, 2) != VERSION:
            raise ValueError("this version of a model is not read")
        if not 0 < classes <= len(INTENTS) or size == 0 or number(16, 4) != classes * size:
            raise ValueError("a model's sizes do not fit each other")
        if 20 + 4 * classes > HEADER or len(data) != HEADER + classes * size:
            raise ValueError("a model's file has another length than its header says")
        return cls(np.frombuffer(data, np.int8, offset=HEADER).reshape(classes, size).astype(np.int64), np.frombuffer(data, "<i4", classes, 20).astype(np.int64))

    def to_bytes(self) -> bytes:
        classes, size = self.weights.shape
        head = MAGIC + VERSION.to_bytes(2, "little") + classes.to_bytes(2, "little") + size.to_bytes(4, "little") + (classes * size).to_bytes(4, "little")
        return (head + self.biases.astype("<i4").tobytes()).ljust(HEADER, b"\0") + np.clip(self.weights, -128, 127).astype(np.int8).tobytes()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """A model from any file system that Spark reads."""
        found = spark.read.format("binaryFile").load(path).select("content").first()
        if found is None:
            raise FileNotFoundError(path)
        return cls.from_bytes(bytes(found.content))

    def classify(self, query: str) -> tuple[str, int, int]:
        """Intent, confidence and margin over the second best; the first of equals wins."""
        score = self.biases + self.weights[:, buckets(query, self.weights.shape[1])].sum(axis=1)
        best = int(score.argmax())
        rest = np.delete(score, best)
        margin = int(score[best] - rest.max()) if len(rest) else max(int(score[best]), 0)
        return INTENTS[best], int(np.clip(50 + 3 * margin, 0, 99)), margin


def train(queries: list[str], intents: list[str], epochs: int = 12) -> Model:
    """An averaged perceptron, scaled to 8 bits."""
    w, total = np.zeros((len(INTENTS), BUCKETS)), np.zeros((len(INTENTS), BUCKETS))
    rows = [(buckets(q), INTENTS.index(i)) for q, i in zip(queries, intents, strict=True)]
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, want = rows[k]
            got = int(w[:, at].sum(axis=1).argmax())
            if got != want:
                w[want, at] += 1
                w[got, at] -= 1
            total += w
    scale = 100 / max(np.abs(total).max(), 1e-9)
    common = np.bincount([want for _, want in rows], minlength=len(INTENTS))
    return Model(np.rint(total * scale).astype(np.int64), np.rint(np.log1p(common)).astype(np.int64))


def classified(log: DataFrame, column: str, model: Model) -> DataFrame:
    """``log`` with intent, confidence and margin."""

    @F.pandas_udf("intent string, confidence int, margin int")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.classify(t or "") for t in text], columns=["intent", "confidence", "margin"])

    return log.withColumn("_p", predict(F.col(column))).select(*log.columns, "_p.*")


def explained(log: DataFrame, column: str, model: Model, sure: int) -> DataFrame:
    """``log`` with each query's intent, ``by`` (rule or model), the model's confidence and margin, its subject and terms: a rule's
    verdict, else the model's if it is ``sure``, else ExactSearch."""
    guessed = classified(log, column, model).withColumnRenamed("intent", "guess")
    rows = routes(guessed, column).withColumnRenamed("intent", "rule")
    decided = F.coalesce("rule", F.when(F.col("confidence") >= sure, F.col("guess")).otherwise("ExactSearch"))
    return rows.select(*log.columns, decided.alias("intent"), F.when(F.col("rule").isNotNull(), "rule").otherwise("model").alias("by"), "confidence", "margin", "subject", "terms")


def trained_on_rules(log: DataFrame, column: str, most: int = 5_000) -> Model:
    """A model of the marker rules' verdicts on at most ``most`` queries of a log (the first by hash; a documented bound of
    labelled rows), for queries that have no marker. Callers classify other rows than those given here."""
    rows = routes(log.select(F.col(column).alias("q")), "q").filter("intent is not null").orderBy(F.xxhash64("q"), "q").limit(most).collect()
    own = [(m, name) for name, markers in MARKERS.items() for m in markers]
    return train([r.q for r in rows] + [q for q, _ in own], [r.intent for r in rows] + [i for _, i in own])
