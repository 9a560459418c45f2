"""Cleanup plans, compaction, verification, freshness and health. Nothing here touches files: plans are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safety import action_of, class_of, guarded, normal_path
from ..storage import written
from .live import KEY, latest_changes, live_view, with_paths

#: Name prefixes that a cleanup looks for, and the report's names of each and rows in all.
PATTERNS = ["temp", "cache", "npm-cache", "node_modules", "__pycache__", "target", "build", "dist", ".log"]
PER_PATTERN, IN_ALL = 128, 500


def decisions(rows: DataFrame, *keep: str) -> DataFrame:
    """(volume, file_id, path, class, risk, action, confidence) of rows with paths and flags, and the columns ``keep``. The path's
    normal form, its kind and what to do are made below each other, each once a row."""
    found = rows.select("volume", "file_id", "path", "flags", *keep, normal_path(F.col("path")).alias("normal"))
    found = found.withColumn("kind", class_of(F.col("normal"), F.col("flags"))).withColumn("guarded", guarded(F.col("normal")))
    return found.withColumn("do", action_of(F.col("guarded"), F.col("kind"))).select("volume", "file_id", "path", "kind.class", "kind.risk", "do.action", "do.confidence", *keep)


def candidates(live: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """The decisions on every live row whose name starts with a pattern, but those to keep it, with the columns ``pattern``
    and ``name_norm``."""
    number = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(PATTERNS))):
        number = F.when(F.startswith("name_norm", F.lit(p)), i).otherwise(number)
    found = live.withColumn("pattern", number).filter("pattern is not null")
    # Written first: a filter on a decision would be pushed below it, and with it all that decides.
    return written(decisions(with_paths(found, live, directories), "pattern", "name_norm"), "candidates").filter("action != 'Keep'")


def cleanup(live: DataFrame, per_pattern: int = PER_PATTERN, in_all: int = IN_ALL, directories: DataFrame | None = None) -> DataFrame:
    """What a cleanup would do with names of the patterns, in the patterns' order, names by name; a top-k report."""
    order = Window.partitionBy("pattern").orderBy("name_norm", "volume", "file_id")
    planned = candidates(live, directories).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_pattern)
    return planned.orderBy("pattern", "at").limit(in_all).drop("at", "pattern", "name_norm")


def quarantine_plan(planned: DataFrame, root: str = "Q:\\quarantine") -> DataFrame:
    """Where each path of ``candidates`` to quarantine would go; its drive becomes a directory, so that a restore finds its place."""
    target = F.concat(F.lit(root + "\\"), F.replace("path", F.lit(":"), F.lit("")))
    return planned.filter("action = 'Quarantine'").select("volume", "file_id", "path", target.alias("target"))


#: A quarantined file's record: its id, where it was and is, and its size.
ENTRY = ["id", "volume", "file_id", "path", "target", "size_bytes"]


def quarantined(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """The records of a carried-out plan; ids are a hash of the place, so that a plan that is carried out again names its
    files alike."""
    known = sizes.select(*KEY, "size_bytes")
    return plan.join(known, KEY, "left").withColumn("id", F.sha2(F.concat_ws(":", "volume", F.col("file_id").cast("string"), "path"), 256).substr(1, 40)).fillna(0, ["size_bytes"]).select(*ENTRY)


def listed(entries: DataFrame, limit: int | None = 100) -> DataFrame:
    """Quarantined files by falling id; a limit of 0 shows one, None all."""
    rows = entries.orderBy(F.desc("id"))
    return rows if limit is None else rows.limit(max(limit, 1))


def restore_plan(entries: DataFrame, live: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """(id, source, target, action) for each record: back to its path, or refused where a live file has that path."""
    taken = with_paths(live, live, directories).select(F.lower("path").alias("taken")).distinct()
    found = entries.join(taken, F.lower("path") == F.col("taken"), "left")
    return found.select("id", F.col("target").alias("source"), F.col("path").alias("target"), F.when(F.col("taken").isNull(), "Restore").otherwise("Refuse").alias("action"))


def purge_plan(entries: DataFrame) -> DataFrame:
    """(id, target, size_bytes) of what a purge would remove for good: only what lies in quarantine."""
    return entries.select("id", "target", "size_bytes")


def compact(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The next base: what the live view shows, in ranges of names and sorted, so that Parquet's statistics can skip."""
    return live_view(base, changes).repartitionByRange("volume", "name_norm").sortWithinPartitions("volume", "name_norm")


def rebuilt(snapshot: DataFrame, changes: DataFrame, position: int, lowest: int) -> DataFrame:
    """A new base from a snapshot that was begun at ``position`` of the journal: changes from there on are laid over it, so
    that what happened during the scan is not lost. Raises if the journal no longer goes back that far."""
    if position < lowest:
        raise ValueError(f"the journal starts at {lowest}, after the snapshot's position {position}: scan again")
    return live_view(snapshot, changes.filter(F.col("seq") >= position))


def verify(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per volume: base rows, change records, and files changed."""
    rows = base.groupBy("volume").agg(F.count("*").alias("records"))
    delta = changes.groupBy("volume").agg(F.count("*").alias("delta_entries"), F.count_distinct("file_id").alias("delta_unique"))
    return rows.join(delta, "volume", "left").fillna(0, ["delta_entries", "delta_unique"])


def deep_verify(base: DataFrame) -> DataFrame:
    """One row per volume: names read, distinct ids, repeated ids, and parents that are missing."""
    ids = base.select("volume", F.col("file_id").alias("parent_id"))
    missing = base.filter("parent_id != 0 and parent_id != file_id").join(ids, ["volume", "parent_id"], "left_anti").groupBy("volume").agg(F.count("*").alias("parent_links_missing"))
    per_id = base.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("name").isNotNull()).alias("named"))
    counts = per_id.groupBy("volume").agg(F.sum("named").alias("names_checked"), F.count("*").alias("ids_checked"), F.count_if(F.col("n") > 1).alias("ids_repeated"))
    return counts.join(missing, "volume", "left").fillna(0, ["parent_links_missing"])


def maintain(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next base, compacted if any change waits, and its health, a row for each volume."""
    if pending(changes).first().pending:
        base, changes = compact(base, changes), changes.limit(0)
    return base, verify(base, changes).join(deep_verify(base).select("volume", "ids_repeated", "parent_links_missing"), "volume")


def missing_parents(base: DataFrame) -> DataFrame:
    ids = base.select("volume", F.col("file_id").alias("parent_id"))
    return base.filter("parent_id != 0 and parent_id != file_id").join(ids, ["volume", "parent_id"], "left_anti").select("volume", "file_id", "parent_id")


def freshness(generations: DataFrame, current: DataFrame) -> DataFrame:
    """(volume, kind, fresh): whether a derived table's journal position is its volume's; absent equals absent."""
    now = current.select("volume", F.col("journal_id").alias("now_id"), F.col("next_usn").alias("now_usn"))
    same = F.col("journal_id").eqNullSafe(F.col("now_id")) & F.col("next_usn").eqNullSafe(F.col("now_usn"))
    return generations.join(now, "volume", "left").select("volume", "kind", same.alias("fresh"))


def doctor(base: DataFrame, changes: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per volume: counts, whether changes wait, and how many of its files attributes know."""
    known = attributes.join(base.select(*KEY), KEY, "left_semi").groupBy("volume").agg(F.count("*").alias("with_attributes"))
    health = verify(base, changes).join(deep_verify(base).select("volume", "parent_links_missing"), "volume").join(known, "volume", "left").fillna(0, ["with_attributes"])
    return health.withColumn("pending_delta", F.col("delta_entries") > 0)


def pending(changes: DataFrame) -> DataFrame:
    """Whether any change waits for compaction; stops at the first."""
    return changes.limit(1).agg((F.count("*") > 0).alias("pending"))


__all__ = ["candidates", "cleanup", "compact", "decisions", "deep_verify", "doctor", "freshness", "latest_changes", "missing_parents", "pending", "purge_plan", "quarantine_plan", "rebuilt", "restore_plan", "verify"]
