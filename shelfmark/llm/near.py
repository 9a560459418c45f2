"""MinHash near-deduplication with SuperMinHash signatures.

A document's set is its distinct shingles of ``size`` words (A-Z lower-cased; fewer words make one shingle of all): five unless
a caller says otherwise, as in the pipeline; op4's contract says four. SuperMinHash gives
each shingle a permutation of the signature's slots, drawn by Fisher-Yates, and takes the least (level, random) for each
slot; levels run for all shingles at once and stop as soon as no slot can fall further. Bands of the signature give buckets,
bucket members are verified on their full sets, and union-find groups what is linked.

Equal sets are one class and are worked on once. Pairs are never listed within a bucket: members are compared with the
bucket's pivots, and what a pivot links is grouped before the next pivots are chosen (see ``linked``). Documents without
words have no shingles and are linked with nothing. A null doc_id is left as its own group, linked with nothing. Rows that
share a doc_id are told apart by their texts: each text is linked by itself, and its group is named by the least doc_id.
Texts of any length are read whole, an empty table gives no
rows, and other columns are kept or left out as they are, whatever their names.

With 24 bands of 4 slots, a pair at the limit of 0.8 shares no bucket with a chance of (1 - 0.8 ** 4) ** 24 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, mixed, shingle_hashes, text_hash, texts, tie, word_hashes, written
from .groups import components, find

SLOTS, ROWS = 96, 4
BLOCK = 16384


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of 64-bit numbers: level and random part of each slot's least draw."""
    least = np.full(slots, np.iinfo(np.int64).max)
    for at in range(0, len(elements), BLOCK):
        part = elements[at : at + BLOCK]
        order: np.ndarray | None = None
        each = np.arange(len(part))
        for level in range(slots):
            x = mixed(part + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            drawn = level + (((x & U64(0xFFFFFFFF)) * U64(slots - level)) >> U64(32)).astype(np.int64)
            value = (level << 32) + (x >> U64(32)).astype(np.int64)
            if order is None:
                slot = drawn
            else:
                slot = order[each, drawn].astype(np.int64)
                order[each, drawn] = order[:, level]
                order[:, level] = slot
            np.minimum.at(least, slot, value)
            if int(least.max()) < (level + 1) << 32:
                break  # later levels draw larger values only
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(part), 1))
                order[each, drawn] = 0
                order[:, 0] = drawn
    return least


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket number for each run of ``rows`` slots."""
    parts = signature.view(U64).reshape(-1, rows)
    out = np.arange(len(parts), dtype=U64)
    for k in range(rows):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


def shingle_set(data: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(data.lower()), size))


def digest(s: np.ndarray) -> list[int]:
    """128 bits of a set, as two numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tie, n_shingles, set_a, set_b, bands): a hash of the text, the set's size, a 128-bit digest of it, and its
    buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2):
                s = shingle_set(data.as_py(), size)
                out.append((len(s), *digest(s), bands(superminhash(s)) if len(s) else []))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "tie", "n_shingles", "set_a", "set_b", "bands"])

    return texts(docs).select("doc_id", tie(), "text").mapInArrow(run, "doc_id long, tie long, n_shingles long, set_a long, set_b long, bands array<long>")


def sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(id, members binary): the full sets of ``classes`` (id, doc_id, tie), each made from the text that its doc_id and tie name.
    Rows that repeat that text make the same set, of which one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), size).tobytes() for x in batch.column(1)], pa.binary())], ["id", "members"])

    rows = texts(docs).select("doc_id", tie(), "text").join(classes.hint("merge"), ["doc_id", "tie"])
    return rows.select("id", "text").mapInArrow(run, "id long, members binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, either) of the pairs with 100 * shared >= percent * either, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


# Links in buckets, without listing their pairs


def apart(n_a, e_a, n_b, e_b, percent: int):
    """Whether sets of n_a and n_b members, of which e_a and e_b are in no other set at all, must be less alike than
    ``percent``: what they share is at most either one's other members."""
    shared = np.minimum(n_a - e_a, n_b - e_b)
    return 100 * shared < percent * (n_a + n_b - shared)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition, one (bucket, i, j) at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                if held and keys[at] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = keys[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield pa.Table.from_batches(held)


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a (bucket, i, j) block are compared with which: all with all if i = j, else block i with block j."""
    i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def live(rows: DataFrame, percent: int) -> DataFrame:
    """The rows with another of their block that is in another component and not certainly apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches):
            n, e, comp = (t.column(c).to_numpy() for c in ("n", "alone", "component"))
            x, y = sides(t)
            seen = np.zeros(len(n), bool)
            for at in range(0, len(x), 256):
                p = x[at : at + 256, None]
                near = (comp[p] != comp[y]) & ~apart(n[p], e[p], n[y], e[y], percent)
                seen[p[near.any(axis=1), 0]] = True
                seen[y[near.any(axis=0)]] = True
            if seen.any():
                yield from t.filter(pa.array(seen)).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def links_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of each block's rows, as few as join what they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches):
            rep, comp, n = (t.column(c).to_numpy() for c in ("rep", "component", "n"))
            members = [np.frombuffer(x.as_buffer(), U64) for x in t.column("members").combine_chunks()]
            words, at = np.unique(np.concatenate(members), return_inverse=True)
            ends = np.cumsum([len(m) for m in members])
            at = [at[z - len(m) : z] for m, z in zip(members, ends, strict=True)]
            x, y = sides(t)
            parent: dict[int, int] = {}
            found: list[tuple[int, int]] = []
            step = max(1, min(128, 8_000_000 // max(len(words), 1)))
            for p in range(0, len(x), step):
                left = dense(at, x[p : p + step], len(words))
                for q in range(0, len(y), step):
                    right = dense(at, y[q : q + step], len(words))
                    shared = left @ right.T
                    either = n[x[p : p + step], None] + n[y[q : q + step]] - shared
                    for a, b in zip(*np.nonzero(100 * shared >= percent * either), strict=True):
                        a, b = x[p + a], y[q + b]
                        r, s = find(parent, int(comp[a])), find(parent, int(comp[b]))
                        if r != s:
                            parent[max(r, s)] = min(r, s)
                            found.append((int(rep[a]), int(rep[b])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def dense(at: list[np.ndarray], rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for k, r in enumerate(rows):
        out[k, at[r]] = 1
    return out


#: Shingles of a block's sets together, 8 bytes each.
BLOCK_SHINGLES = 4 << 20


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a bucket of more than ``size``, or with more than BLOCK_SHINGLES in all (``weight``), in blocks: each row once for
    each block that its own is compared with."""
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("blocks", F.ceil(F.greatest(F.col("cnt") / size, F.col("weight") / BLOCK_SHINGLES)).cast("int")).withColumn("own", own)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "rep", "n", "component", "alone")


def alone(sets: DataFrame) -> DataFrame:
    """(rep, alone): how many members of each set are in no other of ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(m) for m in members])
            every = np.concatenate(members)
            for at in range(0, len(every), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + (1 << 16)]), pa.array(every[at : at + (1 << 16)])], ["rep", "member"])

    once = sets.mapInArrow(run, "rep long, member long").groupBy("member").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    return once.groupBy("rep").agg(F.count("*").alias("alone"))


#: A bucket with more than one in FULL of all members is full; there are fewer than FULL such buckets.
FULL = 1000


def by_bucket_of(rows: DataFrame, buckets: DataFrame, full: int) -> DataFrame:
    """``rows`` joined to ``buckets``, a row each with its count ``cnt``. Rows of full buckets, of which there are fewer than
    FULL, meet them where they are; others are dealt by bucket, so that no task gets all rows of a full one."""
    hot = F.broadcast(written(buckets.filter(F.col("cnt") > full), "full"))
    cold = rows.join(hot.select("bucket"), "bucket", "left_anti").join(buckets.filter(F.col("cnt") <= full), "bucket")
    return rows.join(hot, "bucket").unionByName(cold)


def linked(docs: DataFrame, reps: DataFrame, size: int, percent: int, block: int = 2048) -> DataFrame:
    """(child, parent): classes that are linked, directly or through others, with the least of them.

    1. Each bucket's pivot is the member whose buckets are fullest: in a group of edited copies, the one nearest to what all
       of them come from. Every member is verified against its buckets' pivots, and the links are grouped.
    2. Where a bucket still holds several components, a member is set aside for certain if too many of its shingles are in
       no other set, alone or together with the partner's. What remains is compared in blocks on full sets.
    So each pair that shares a bucket is linked, or in one component already, or known to be apart.
    """
    placed = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = written(placed.groupBy("bucket").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "sizes")
    full = (sizes.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]) // FULL + 1
    members = written(by_bucket_of(placed, sizes, full), "members")
    middle = members.groupBy("rep").agg(F.sum("cnt").alias("fullness"))
    pivots = members.join(middle, "rep").groupBy("bucket").agg(F.max(F.struct("fullness", -F.col("rep"), "n")).alias("top"), F.max("cnt").alias("cnt")).select("bucket", "cnt", (-F.col("top.col2")).alias("pivot"), F.col("top.n").alias("pivot_n"))
    members = written(by_bucket_of(members.drop("cnt"), pivots, full).filter(F.col("rep") != F.col("pivot")), "members")
    alike = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    pairs = members.filter(alike).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = members.select("rep").union(members.select("pivot")).distinct()
    sets = written(sets_of(docs, reps.join(wanted, "rep", "left_semi").select(F.col("rep").alias("id"), "doc_id", "tie"), size), "sets")
    links = written(verified(pairs, sets, percent), "links")
    found = components(links)
    # Pivots were compared with everyone, so a bucket of two is done.
    in_component = members.filter("cnt > 2").join(found.select(F.col("child").alias("rep"), F.col("parent").alias("component")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed_up = in_component.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("cnt").alias("cnt")).filter("low != high").select("bucket", "cnt")
    rows = written(by_bucket_of(in_component.drop("cnt"), mixed_up, full).select("bucket", "rep", "n", "cnt", "component"), "rows")
    weights = rows.groupBy("bucket").agg(F.sum("n").alias("weight"), F.max("cnt").alias("cnt"))
    rows = by_bucket_of(rows.drop("cnt"), weights, full)
    left = sets.join(rows.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    rows = rows.join(alone(left), "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    rows = rows.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    dealt = blocked(rows, block).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    close = written(live(dealt, percent), "close")
    full = close.join(sets.select(F.col("id").alias("rep"), "members"), "rep").select("bucket", "i", "j", "own", "rep", "n", "component", "members")
    # Written first: a stage never runs two Python maps, each with a worker of its own, at once.
    more = written(links_in_blocks(full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), percent), "links")
    return components(found.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(more))


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, first_tie) of every row: the least doc_id of its group, and which of that id's
    texts comes first. Rows without a group have their own doc_id and tie."""
    every = written(signatures(docs, size), "signatures")
    classes = every.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "tie", "n_shingles", "bands")).alias("least"))
    # Two classes can have the same least doc_id, so a class is named by a number of its own; it is fixed once written.
    numbered = classes.select("set_a", "set_b", F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.tie", F.col("least.n_shingles").alias("n"), "least.bands")
    reps = written(numbered, "classes")
    found = linked(docs, reps, size, percent)
    in_group = reps.select("set_a", "set_b", "rep", "doc_id", "tie").join(found.select(F.col("child").alias("rep"), "parent"), "rep", "left").withColumn("group", F.coalesce("parent", "rep"))
    firsts = in_group.groupBy("group").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    named = in_group.join(firsts, "group").select("set_a", "set_b", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    out = every.select("doc_id", "tie", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    linked_row = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & F.col("first_id").isNotNull()
    return out.select("doc_id", "tie", "n_shingles", F.when(linked_row, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked_row, F.col("first_tie")).otherwise(F.col("tie")).alias("first_tie"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: kept is the least doc_id of each group."""
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with all columns of ``docs``: the least doc_id's, and of rows that repeat its text any one. Of
    texts without words and rows with a null doc_id all stay. Texts are always joined by a shuffle: what goes grows with the
    input, so a broadcast would only suit small ones."""
    groups = written(grouped(docs, size, percent), "groups")
    other = (F.col("doc_id") != F.col("component_id")) | (F.col("tie") != F.col("first_tie"))
    gone = groups.filter(other).select(F.col("doc_id").alias("id"), F.col("tie").alias("text_hash")).distinct()
    again = groups.filter(~F.coalesce(other, F.lit(False)) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"), F.col("tie").alias("text_hash")).count().filter("count > 1").drop("count")
    # The row as a struct: its columns' names can clash with nothing.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = [F.col("row.doc_id").cast("long") == F.col("id"), text_hash(F.col("row.text")) == F.col("text_hash")]
    kept = rows.join(gone.hint("merge"), key, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, key).groupBy("id", "text_hash").agg(F.first("row").alias("row")).select("row")
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept.select("row.*")
