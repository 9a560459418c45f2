"""The live view: a base snapshot under its latest changes, and paths within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import qualified, within_scope
from ..sources.catalog import named
from ..storage import written

KEY = ["volume", "file_id"]
CHAIN = 256


def latest_changes(changes: DataFrame, *more: str) -> DataFrame:
    """The last change by sequence of each file, with the columns ``more``: a partial aggregate in every task, then one row a
    key is shuffled."""
    last = F.max_by(F.struct("op", "parent_id", "size_bytes", "flags", "name", *more), "seq")
    return changes.groupBy(*KEY).agg(last.alias("c"), F.max("seq").alias("seq")).select(*KEY, "seq", "c.*")


def live_view(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base rows that no change overrides, and the files that a last change put there."""
    latest = latest_changes(changes)
    kept = base.join(latest.select(*KEY), KEY, "left_anti")
    return kept.unionByName(named(latest.filter("op = 'Upsert'").select(*KEY, "parent_id", "size_bytes", "flags", "name")))


def by_id(live: DataFrame, volume: str, file_id: int) -> DataFrame:
    return live.filter((F.col("volume") == volume) & (F.col("file_id") == file_id))


def directory_paths(live: DataFrame) -> DataFrame:
    """(volume, file_id, path) of every row that is some row's parent, by pointer doubling over these rows alone: three
    doublings a table, so that trees of eight levels take one and those of CHAIN levels three. A chain that comes back to
    itself is cut where it first does; empty names are left out."""
    parents = live.select("volume", F.col("parent_id").alias("file_id")).distinct()
    up = F.when((F.col("parent_id") != 0) & (F.col("parent_id") != F.col("file_id")), F.col("parent_id"))
    nodes = written(live.join(parents, KEY, "left_semi").select(*KEY, up.alias("next"), F.array(F.struct("file_id", "name")).alias("chain")), "directories")
    for _ in range(-(-CHAIN.bit_length() // 3)):
        if nodes.filter("next is not null").isEmpty():
            break
        nodes = written(doubled(doubled(doubled(nodes))), "directories")
    return nodes.select(*KEY, joined_names(F.col("chain")).alias("path"))


def doubled(nodes: DataFrame) -> DataFrame:
    """Each chain with the one of where it ends."""
    above = nodes.select("volume", F.col("file_id").alias("next"), F.col("next").alias("beyond"), F.col("chain").alias("more"))
    joined = nodes.join(above, ["volume", "next"], "left")
    chain = F.slice(F.concat("chain", F.coalesce("more", F.array().cast("array<struct<file_id:bigint,name:string>>"))), 1, CHAIN)
    return joined.select(*KEY, F.when(F.col("more").isNotNull(), F.col("beyond")).alias("next"), chain.alias("chain"))


def joined_names(chain) -> F.Column:
    ids = F.transform(chain, lambda x: x["file_id"])
    fresh = F.filter(chain, lambda x, i: (F.array_position(ids, x["file_id"]) == i + 1) & (x["name"] != ""))
    return F.array_join(F.reverse(F.transform(fresh, lambda x: x["name"])), "\\")


def with_scopes(directories: DataFrame) -> DataFrame:
    """Directories with the key that they are sorted by: the whole path in lower case with a separator behind. What lies below
    a directory is then a range of keys, as an interval of entry and exit numbers would be, and a new name or place of a
    directory changes the keys of its subtree alone."""
    return directories.withColumn("scope", F.concat(F.lower(F.replace(qualified(F.col("volume"), F.col("path")), F.lit("/"), F.lit("\\"))), F.lit("\\")))


def in_scope(rows: DataFrame, live: DataFrame, directories: DataFrame, scope: str) -> DataFrame:
    """``rows`` with their paths, of those that are the scope or lie below it. The scope's directories are a range of the
    directories' keys, which is pushed to their scan; rows are below one of them, or have the scope's own name, and only
    these get paths. A scope that is a drive takes all of its rows."""
    key = scope.replace("/", "\\").lower().rstrip("\\") + "\\"
    if key.count("\\") > 1:
        below = directories.filter(F.startswith("scope", F.lit(key))).select("volume", F.col("file_id").alias("parent_id"))
        named = F.col("name_norm") == key.split("\\")[-2]
        rows = rows.filter(named).unionByName(rows.filter(~named).join(below, ["volume", "parent_id"], "left_semi").select(rows.columns))
    return with_paths(rows, live, directories).filter(within_scope(F.col("path"), scope))


def with_paths(rows: DataFrame, live: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """``rows`` of the live view with their paths, each with its drive; ``directories`` are its ``directory_paths``, made here
    if they are not given."""
    above = (directory_paths(live) if directories is None else directories).select("volume", F.col("file_id").alias("parent_id"), F.col("path").alias("above"))
    found = rows.join(above, ["volume", "parent_id"], "left")
    alone = (F.col("parent_id") == 0) | (F.col("parent_id") == F.col("file_id")) | F.col("above").isNull()
    path = F.when(alone, F.col("name")).otherwise(F.concat_ws("\\", F.when(F.col("above") != "", F.col("above")), F.when(F.col("name") != "", F.col("name"))))
    return found.withColumn("path", qualified(F.col("volume"), path)).drop("above")


def with_attributes(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    known = attributes.select(*KEY, F.col("size_bytes").alias("attr_size"), F.col("modified_unix_secs").alias("attr_modified"))
    return rows.join(known, KEY, "left")


def overridden(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Every base row with whether a change overrides it."""
    return base.join(latest_changes(changes).select(*KEY, F.lit(True).alias("changed")), KEY, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
