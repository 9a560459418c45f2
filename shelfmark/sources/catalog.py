"""The catalog's relations from stored tables: base snapshots, attributes, contents, and the change journal.

A base row is (volume, file_id, parent_id, size_bytes, flags, name); a root's parent is itself. Sizes in a snapshot are 0:
only attributes know them. Flags: 1 directory, 2 hidden, 4 system, 8 reparse point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalized
from ..storage import table

DIRECTORY, HIDDEN, SYSTEM, REPARSE = 1, 2, 4, 8
EPOCH_2024 = 1_704_067_200
BASE = ["volume", "file_id", "parent_id", "size_bytes", "flags", "name"]
#: Where documents' languages stand, extensions by doc_id % 10, and special names by p_partkey % 200.
LANGS = ["de", "en", "es", "fr"]
EXTENSIONS = [".md", ".rs", ".py", ".json", ".log", ".txt", ".tmp", ".html", ".pdf", ".mp4"]
SPECIAL = ["node.exe", "package.json", "node_modules", "npm-cache", "Cargo.toml", ".gitignore", "notepad.exe", "temp-cache.tmp", "build", "__pycache__"]
#: Change reasons of a journal record.
CREATE, RENAME_NEW, DELETE, RENAME_OLD, DATA = 0x100, 0x2000, 0x200, 0x1000, 0x1
RELEVANT = CREATE | DELETE | RENAME_OLD | RENAME_NEW


def rows_of(volume: str, file_id, parent_id, flags, name) -> list:
    return [F.lit(volume).alias("volume"), F.expr(file_id).cast("long").alias("file_id"), F.expr(parent_id).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("size_bytes"), F.expr(flags).cast("int").alias("flags"), F.expr(name).alias("name")]


def strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def documents_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume C: documents as files below language and source directories."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    place = f"(array_position({strings(LANGS)}, lang) - 1)"
    source = f"(100 + {place} * 100 + cast(substr(source, 4) as bigint))"
    one = spark.range(1)
    langs = spark.range(len(LANGS))
    return (
        one.select(*rows_of("C", "5", "5", "1", "'C:'"))
        .unionByName(langs.select(*rows_of("C", "10 + id", "5", "1", f"element_at({strings(LANGS)}, cast(id + 1 as int))")))
        .unionByName(docs.select("lang", "source").distinct().select(*rows_of("C", source, f"10 + {place}", "1", "source")))
        .unionByName(docs.select(*rows_of("C", "1000000 + doc_id", source, "0", f"concat('doc-', lpad(cast(doc_id as string), 7, '0'), element_at({strings(EXTENSIONS)}, cast(doc_id % 10 as int) + 1))")))
    )


def parts_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume D: parts below their brands' directories, many with equal names."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    brand = "(1000 + cast(substring_index(p_brand, '#', -1) as bigint))"
    name = f"if(p_partkey % 200 < {len(SPECIAL)}, element_at({strings(SPECIAL)}, cast(p_partkey % 200 as int) + 1), concat(replace(p_name, ' ', '-'), '.dat'))"
    flags = "if(p_partkey % 200 = 2, 1, 0) + if(p_partkey % 50 = 11, 2, 0) + if(p_partkey % 75 = 13, 4, 0)"
    return (
        spark.range(1).select(*rows_of("D", "5", "5", "1", "'D:'"))
        .unionByName(parts.select("p_brand").distinct().select(*rows_of("D", brand, "5", "1", "p_brand")))
        .unionByName(parts.select(*rows_of("D", "1000000 + p_partkey", brand, flags, name)))
    )


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name_norm", normalized(F.col("name")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both volumes with each name's normal form."""
    return named(documents_volume(spark, sf_dir).unionByName(parts_volume(spark, sf_dir)))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("C").alias("volume"), (F.lit(1_000_000) + F.col("doc_id")).alias("file_id"), F.col("n_chars").alias("size_bytes"), (F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("modified_unix_secs"))
    parts = table(spark, sf_dir, "part").select(F.lit("D").alias("volume"), (F.lit(1_000_000) + F.col("p_partkey")).alias("file_id"), (F.col("p_size").cast("long") * 1_000_000).alias("size_bytes"), (F.lit(EPOCH_2024) + F.col("p_partkey") * 86_400).alias("modified_unix_secs"))
    return docs.unionByName(parts)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, file_id, name, text) of documents' files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("C").alias("volume"), (F.lit(1_000_000) + F.col("doc_id")).alias("file_id"), F.expr(f"concat('doc-', lpad(cast(doc_id as string), 7, '0'), element_at({strings(EXTENSIONS)}, cast(doc_id % 10 as int) + 1))").alias("name"), "text")


def journal(events: DataFrame, *more: Column) -> DataFrame:
    """Journal records (seq, file_id, reason, name) of volume D from an events table, batch or stream, and the columns ``more``."""
    reason = F.expr(f"case event_type when 'signup' then {CREATE} when 'purchase' then {RENAME_NEW} when 'error' then {DELETE} when 'click' then {RENAME_OLD} else {DATA} end")
    return events.select(F.col("event_id").alias("seq"), (F.lit(1_000_000) + F.col("user_id")).alias("file_id"), reason.alias("reason"), F.concat(F.lit("renamed-"), F.col("event_id").cast("string"), F.lit(".txt")).alias("name"), *more)


def timed_journal(events: DataFrame) -> DataFrame:
    """Journal records with the milliseconds of their time, as logs hold them."""
    return journal(events, F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))


def changes_of(records: DataFrame, *more: str) -> DataFrame:
    """Relevant records as changes: a deletion has no name, anything else is an upsert; a rename's old name alone is none. The
    columns ``more`` go along."""
    relevant = (F.col("reason").bitwiseAND(RELEVANT) != 0) & ~((F.col("reason").bitwiseAND(RENAME_OLD) != 0) & (F.col("reason").bitwiseAND(RENAME_NEW) == 0))
    gone = F.col("reason").bitwiseAND(DELETE) != 0
    return records.filter(relevant).select(
        F.lit("D").alias("volume"), "seq", F.when(gone, "Delete").otherwise("Upsert").alias("op"), "file_id", F.lit(5).cast("long").alias("parent_id"),
        F.lit(0).cast("long").alias("size_bytes"), F.lit(0).alias("flags"), F.when(gone, "").otherwise(F.col("name")).alias("name"), *more,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(journal(table(spark, sf_dir, "events")))
