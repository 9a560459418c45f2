"""Duplicate files: equal sizes, then equal contents. Groups of every size count, unless a caller bounds them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

SAMPLE = 65_536


def within(largest: int | None) -> Column:
    return F.lit(True) if largest is None else F.col("files") <= largest


def same_size(attributes: DataFrame, least: int, largest: int | None = None) -> DataFrame:
    """(size_bytes, files) of sizes that two files or more have; bounded, groups of more than ``largest`` are skipped whole."""
    return attributes.filter(F.col("size_bytes") >= least).groupBy("size_bytes").agg(F.count("*").alias("files")).filter((F.col("files") >= 2) & within(largest))


def group_stats(attributes: DataFrame, least: int, largest: int | None = None) -> DataFrame:
    sizes = attributes.filter(F.col("size_bytes") >= least).groupBy("size_bytes").agg(F.count("*").alias("files"))
    kept = (F.col("files") >= 2) & within(largest)
    return sizes.agg(F.count_if(kept).alias("groups"), F.coalesce(F.sum(F.when(kept, F.col("files"))), F.lit(0)).alias("members"), F.count_if(~within(largest)).alias("oversized_groups_skipped"))


def hashed(files: DataFrame, least: int, largest: int | None) -> DataFrame:
    """(volume, file_id, size_bytes, sha256) of (volume, file_id, size_bytes, text).

    Contents are hashed where they are read, and hashes are counted there before they are shuffled, so that a set of any
    size is few rows. Equal hashes have equal sizes; only a bound needs the sizes' own counts."""
    rows = files.filter(F.col("size_bytes") >= least).select("volume", "file_id", "size_bytes", F.sha2("text", 256).alias("sha256"))
    if largest is not None:
        rows = rows.join(same_size(files, least, largest).select("size_bytes"), "size_bytes", "left_semi")
    return rows


def duplicate_sets(files: DataFrame, least: int = 1 << 20, largest: int | None = None) -> DataFrame:
    """(size_bytes, sha256, files, first_file, reclaimable) of files with equal contents."""
    sets = hashed(files, least, largest).groupBy("size_bytes", "sha256").agg(F.count("*").alias("files"), F.min(F.struct("volume", "file_id")).alias("first"))
    return sets.filter("files >= 2").select("size_bytes", "sha256", "files", F.concat(F.col("first.volume"), F.lit(":"), F.col("first.file_id").cast("string")).alias("first_file"), (F.col("size_bytes") * (F.col("files") - 1)).alias("reclaimable"))


def duplicate_files(files: DataFrame, least: int = 1 << 20, largest: int | None = None) -> DataFrame:
    """(size_bytes, sha256, copies, volume, file_id): every member of every set. Sets are counted first, with one partial row a
    task for each, and members are then joined to the few hashes that repeat; a hash of very many members is split by
    Spark's skew join."""
    rows = hashed(files, least, largest)
    sets = rows.groupBy("size_bytes", "sha256").agg(F.count("*").alias("copies")).filter("copies >= 2")
    return rows.join(sets, ["size_bytes", "sha256"]).select("size_bytes", "sha256", "copies", "volume", "file_id")


def ends(text: Column) -> Column:
    """A hash of a content's first and last SAMPLE bytes."""
    return F.xxhash64(F.substring(text, 1, SAMPLE), F.when(F.length(text) > SAMPLE, F.right(text, F.lit(SAMPLE))).otherwise(""))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys another row has too; keys are counted before they are shuffled."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2").drop("n"), list(keys), "left_semi")


def staged(files: DataFrame, least: int = 1 << 20, sample: Callable[[Column], Column] = ends, digest: Callable[[Column], Column] = sha) -> dict[str, DataFrame]:
    """The files that are left after each stage, as (volume, file_id, size_bytes, ...): those whose ``size`` repeats, then whose
    ``sample`` does, then whose ``hash`` does, then ``bytes``: the members of each set by a comparison of contents, with
    ``first``, the least file of the set. A stage opens contents of what the stage before left only, and each stage's table is
    in the shared folder, as the next one reads it twice.

    A hash's group is compared with its least file's content; what differs is a group of its own and is compared again, until
    all that have one name are equal. Hashes collide so rarely that the second round is nearly always empty."""
    own = files.filter(F.col("size_bytes") >= least)
    size = written(repeated(own.select("volume", "file_id", "size_bytes"), "size_bytes"), "same-size")
    opened = lambda left: own.join(left.drop("size_bytes"), ["volume", "file_id"])
    sampled = opened(size).select("volume", "file_id", "size_bytes", sample(F.col("text")).alias("sample"))
    sampled = written(repeated(written(sampled, "samples"), "size_bytes", "sample"), "same-sample")
    hashed_ = opened(sampled).select("volume", "file_id", "size_bytes", "sample", digest(F.col("text")).alias("hash"))
    hashed_ = written(repeated(written(hashed_, "hashes"), "size_bytes", "sample", "hash"), "same-hash")
    keys, left, sets = ["size_bytes", "sample", "hash"], hashed_, []
    while not left.isEmpty():
        first = left.groupBy(*keys).agg(F.min(F.struct("volume", "file_id")).alias("first"))
        named = left.join(first, keys)
        heads = opened(named.filter(F.struct("volume", "file_id") == F.col("first"))).select(*keys, F.col("text").alias("head"))
        compared = written(opened(named).join(heads, keys).select("volume", "file_id", *keys, "first", (F.col("text") == F.col("head")).alias("same")), "compared")
        sets.append(compared.filter("same").drop("same"))
        left = compared.filter("not same").select("volume", "file_id", *keys)
    found = functools.reduce(lambda a, b: a.unionByName(b), sets) if sets else hashed_.withColumn("first", F.struct("volume", "file_id"))
    return {"size": size, "sample": sampled, "hash": hashed_, "bytes": written(repeated(found, "first"), "same-bytes")}


def read_by_stage(files: DataFrame, stages: dict[str, DataFrame], least: int = 1 << 20) -> DataFrame:
    """(stage, files, bytes): how many files each stage opens and how many of their bytes it reads."""
    own = files.filter(F.col("size_bytes") >= least).select("size_bytes")
    ends_of = F.least(F.col("size_bytes"), F.lit(2 * SAMPLE))
    counts = [("size", own, F.lit(0)), ("sample", stages["size"], ends_of), ("hash", stages["sample"], F.col("size_bytes")), ("bytes", stages["hash"], F.col("size_bytes"))]
    parts = [rows.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("stage"), "files", "bytes") for name, rows, size in counts]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def report(sets: DataFrame) -> DataFrame:
    return sets.agg(F.count("*").alias("sets"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))
