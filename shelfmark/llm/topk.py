"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

``index`` packs vectors, without a shuffle, into shards of at most SHARD; each keeps, for each component, the list of its
vectors' places in the order of that component. ``search`` gives every block of queries to every shard, by an equal key and
not as a cross join, and there reads the lists sequentially, all to the same depth: from the top where a query's component is
positive, from the bottom where it is negative. After each stretch, a vector's score is bounded from below and from above: by
what the lists have shown of it, and for the rest by the lists' ends and by the values that the readings stand at. A query
stops when no more vectors than a few times k have an upper bound that reaches the k-th greatest lower bound; their scores are
then resolved from the stored vectors. Ties are never cut before that, so that results are exact. A query's best of all shards
are ranked together, few rows a shard.

Components become floor(SCALE * x) with x as double. Vectors that are null or hold a null or a component that is not finite take
no part, as queries or as candidates, nor do rows without an id. Vectors of different lengths have no score. A query never finds
its own id. Rows that repeat another are candidates of their own; of rows that share an id, the one with the least vector asks.
Sums beyond 2^53 are resolved in Python's numbers and held at the ends of a long. An empty table gives no rows. Columns besides
the two named are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import map_arrow, small_batches, written

SCALE = 1024
#: Vectors of a shard, and queries of a block.
SHARD, BLOCK = 4096, 512
#: Parts of the lists that are read before each look at the bounds.
DEPTHS = (1 / 4, 1 / 2, 3 / 4, 1)
#: Candidates of a query, as a multiple of k, whose scores are resolved without reading on.
FEW = 12
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

PACKED = "dims int, ids binary, numbers binary, wide boolean"


def whole(values: pa.ListArray) -> list[np.ndarray | None]:
    """Each vector's floored components as float64, or None for one that takes no part."""
    out: list[np.ndarray | None] = []
    for v in values:
        x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(float) if v.values.null_count == 0 else None
        out.append(np.floor(SCALE * x) if x is not None and np.isfinite(x).all() and np.isfinite(SCALE * x).all() else None)
    return out


def packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows of PACKED, each of at most ``size`` vectors of one length, with their ids."""
    source = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    small_batches(source)

    def row(dims: int, ids: list[int], vectors: list[np.ndarray]) -> tuple:
        numbers = np.array(vectors).reshape(len(ids), dims)
        most = np.abs(numbers).max(initial=0)
        narrow = most <= np.iinfo(np.int16).max
        return dims, np.array(ids, np.int64).tobytes(), numbers.astype(np.int16).tobytes() if narrow else numbers.tobytes(), not narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.bool_()], strict=True)], ["dims", "ids", "numbers", "wide"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), whole(batch.column(1)), strict=True):
                if v is None:
                    continue
                ids, vectors = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield made([row(len(v), *waiting.pop(len(v)))])
        if waiting:
            yield made([row(d, *x) for d, x in waiting.items()])

    return source.mapInArrow(run, PACKED)


def unpacked(dims: int, ids: bytes, numbers: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(numbers, float if wide else np.int16).reshape(len(own), dims).astype(float)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of vectors with a query, in floats where no sum can leave 2^53, else in Python's numbers."""
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(len(query), 1) < EXACT:
        return (vectors @ query).astype(np.int64).tolist()
    numbers = [int(x) for x in query]
    return [max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(v, numbers, strict=True)))) for v in vectors]


class Lists:
    """A shard's vectors, and their places in each component's order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.read_share: list[float] = []

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query's number, places of the vectors that its k best are among, as far as they reach its bar) for each query, by
        reading the lists."""
        n, dims = self.vectors.shape
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        top, bottom = np.zeros((2, n, dims))  # what the readings from the tops and from the bottoms have shown
        unseen = np.ones((2, n, dims))
        open_, done = np.arange(len(queries)), 0
        columns = np.arange(dims)
        mine = own[:, None] == self.ids[None, :] if len(np.intersect1d(own, self.ids)) else None
        exact = np.abs(self.vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(dims, 1) < EXACT
        if not exact or not dims:
            for q in open_:
                yield int(q), np.flatnonzero(self.ids != own[q])
            return
        for share in DEPTHS:
            depth = max(int(np.ceil(n * share)), done)
            for seen, shown, span in ((unseen[0], top, slice(n - depth, n - done)), (unseen[1], bottom, slice(done, depth))):
                shown[self.order[span], columns] = self.values[span]
                seen[self.order[span], columns] = 0
            done = depth
            u, d = up[open_].T, down[open_].T
            known = top @ u + bottom @ d
            greatest, least = self.values[-1], self.values[0]
            if done < n:
                high, low = self.values[n - done - 1], self.values[done]  # the next that each reading would show
                upper = known + unseen[0] @ (u * high[:, None]) + unseen[1] @ (d * low[:, None])
                lower = known + unseen[0] @ (u * least[:, None]) + unseen[1] @ (d * greatest[:, None])
            else:
                upper, lower = known, known
            if mine is not None:
                hidden = mine[open_].T
                upper, lower = np.where(hidden, -np.inf, upper), np.where(hidden, -np.inf, lower)
            bar = np.maximum(bars[open_], np.partition(lower, n - k, axis=0)[n - k] if n > k else -np.inf)
            inside = (upper >= bar) & (upper > -np.inf)
            over = np.ones(len(open_), bool) if done >= n or n <= k else inside.sum(axis=0) <= FEW * k
            for j in np.flatnonzero(over):
                self.read_share.append(share)
                yield int(open_[j]), np.flatnonzero(inside[:, j])
            open_ = open_[~over]
            if not len(open_):
                return

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query's id, vector's id, score) of each query's k best vectors here that may reach its bar, ties to smaller ids."""
        for q, places in self.candidates(queries, own, k, bars):
            scores = exact_scores(self.vectors[places], queries[q])
            found = sorted(zip((-s for s in scores), self.ids[places].tolist(), strict=True))[:k]
            yield from ((int(own[q]), i, -s) for s, i in found)


def index(rows: DataFrame, key: str, vector: str, size: int = SHARD) -> DataFrame:
    """A table of shards in the shared folder, numbered by their partition and place in it."""
    shards = packed(rows, key, vector, size)
    return written(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")


def takes_part(v: Column) -> Column:
    """Whether a vector is there and all its components are, as finite numbers."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x * SCALE) < float("inf"))), F.lit(False))


def asked(queries: DataFrame, key: str, vector: str, shards: DataFrame, k: int, block: int) -> DataFrame:
    """A table of the queries in blocks, with each query's bar: its k-th score in the pilot, the shard of most vectors; none is
    asked for vectors of another length. The pilot is one row of at most SHARD vectors, so it is broadcast."""
    rows = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(takes_part(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    blocks = packed(rows, "id", "v", block).select("dims", F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"), F.col("wide").alias("q_wide"))
    pilot = shards.orderBy(F.desc(F.octet_length("ids")), "shard").limit(1).drop("shard")

    def barred(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            own, vectors = unpacked(r["dims"], r["q_ids"], r["q_numbers"], r["q_wide"])
            bars = np.full(len(own), -np.inf)
            if r["ids"] is not None and not r["q_wide"] and not r["wide"]:
                scores: dict[int, list[int]] = {}
                for q, _, score in Lists(*unpacked(r["dims"], r["ids"], r["numbers"], r["wide"])).best(vectors, own, k, bars):
                    scores.setdefault(q, []).append(score)
                bars = np.array([scores[q][k - 1] if len(scores.get(q, ())) == k else -np.inf for q in own.tolist()])
            yield pa.RecordBatch.from_pylist([{"dims": r["dims"], "q_ids": r["q_ids"], "q_numbers": r["q_numbers"], "q_wide": r["q_wide"], "bars": bars.tobytes()}], BLOCKS)

    found = map_arrow(blocks.join(F.broadcast(pilot), "dims", "left"), barred, "dims int, q_ids binary, q_numbers binary, q_wide boolean, bars binary")
    return written(found, "queries")


BLOCKS = pa.schema([("dims", pa.int32()), ("q_ids", pa.binary()), ("q_numbers", pa.binary()), ("q_wide", pa.bool_()), ("bars", pa.binary())])


def search(shards: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of the shards with the greatest inner products, ties to
    smaller ids; all, if fewer. A lane has one shard or few, and gets all blocks of queries, one after another."""
    blocks = asked(queries, key, vector, shards, k, block)
    count, last = shards.agg(F.count("*"), F.max(F.shiftright("shard", 33))).first()
    lanes, parts = max(count, 1), (last or 0) + 1
    place = F.pmod(F.col("shard").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("shard", 33), F.lit(lanes)).cast("int")
    here = shards.withColumn("lane", place).repartitionById(lanes, F.col("lane"))
    there = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartitionById(lanes, F.col("lane"))
    pairs = there.join(here, ["lane", "dims"]).select("shard", "dims", "ids", "numbers", "wide", "q_ids", "q_numbers", "q_wide", "bars")
    small_batches(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if lists is None or shard != r["shard"]:
                    shard, lists = r["shard"], Lists(*unpacked(r["dims"], r["ids"], r["numbers"], r["wide"]))
                own, vectors = unpacked(r["dims"], r["q_ids"], r["q_numbers"], r["q_wide"])
                found = list(lists.best(vectors, own, k, np.frombuffer(r["bars"])))
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
