"""Web lookups without a network: what is asked, answers in two JSON formats, and a cache of answers as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table
from .names import lookup_name

#: Fields of an item in each format, and whether the text may be missing.
FORMATS = {"custom": ("items", "link", "snippet", False), "meta": ("results", "url", "content", True)}
#: Bytes of answers that a cache holds before it starts anew.
CACHE_BYTES = 8 << 20


def search_text(path: Column, publisher: Column | None = None, product: Column | None = None, version: Column | None = None) -> Column:
    """A file's name without its folders, and what else is known of it, empty parts left out."""
    more = [F.when(x != "", x) for x in (publisher, product, version) if x is not None]
    return F.concat_ws(" ", lookup_name(path), *more)


def cache_key(text: Column) -> Column:
    """What an answer is stored under."""
    return F.xxhash64(text)


def answers(text: Column, kind: str = "custom", limit: int = 5) -> Column:
    """array<struct<title, link, snippet>> of an answer's first items. An item without a title, a link or (in the format that
    needs one) a text ends the list: what follows is not read. Text that is no JSON has no items."""
    items, link, snippet, optional = FORMATS[kind]
    rows = F.from_json(text, f"{items} array<struct<title:string,{link}:string,{snippet}:string>>")[items]
    plain = F.transform(rows, lambda x: F.struct(x["title"].alias("title"), x[link].alias("link"), (F.coalesce(x[snippet], F.lit("")) if optional else x[snippet]).alias("snippet")))
    bad = F.transform(plain, lambda x: x["title"].isNull() | x["link"].isNull() | x["snippet"].isNull())
    first_bad = F.array_position(bad, True)
    whole = F.when(first_bad > 0, F.slice(plain, F.lit(1), F.least(first_bad.cast("int") - 1, F.lit(limit)))).otherwise(F.slice(plain, 1, limit))
    return F.coalesce(whole, F.array().cast("array<struct<title:string,link:string,snippet:string>>"))


def put(cache: DataFrame, entries: DataFrame, most_bytes: int = CACHE_BYTES) -> DataFrame:
    """A cache (key, seq, size_bytes, results) with more entries; one that already holds more than ``most_bytes`` starts anew."""
    held = cache.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    return entries if held > most_bytes else cache.unionByName(entries)


def latest(cache: DataFrame) -> DataFrame:
    """(key, seq, results): the newest answer for each key."""
    return cache.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("results", "seq").alias("results"))


def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages as a cache of answers: (key, seq, size_bytes, results), each page under its file's name."""
    pages = table(spark, sf_dir, "pages")
    item = F.struct(F.col("url").alias("title"), F.col("url").alias("link"), F.col("html").alias("snippet"))
    answer = F.to_json(F.struct(F.array(item).alias("items")))
    return pages.select(cache_key(search_text(F.col("url"))).alias("key"), F.col("page_id").alias("seq"), (F.octet_length("url") * 2 + F.octet_length("html")).cast("long").alias("size_bytes"), answers(answer).alias("results"))


def cached(cache: DataFrame, target: str) -> DataFrame:
    """(title, link, snippet) that a cache has for a file; no rows where it has none. Nothing is ever asked of a network."""
    hit = cache.filter(F.col("key") == cache_key(search_text(F.lit(target))))
    return latest(hit).select(F.inline("results"))
