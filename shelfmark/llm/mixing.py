"""Mixing sources to target weights by temperature, in DataFrame functions alone.

A source's weight is its share of tokens to the power of an exponent, normalized. The exponent is the least (flattest) that
keeps the weights' entropy at or under a target and every source's repetition at or under a limit; it is bisected, several
halvings a pass. Weights times the token budget give each source whole passes and a last, partial one. Documents lie in
blocks by a hash; every pass has its own permutation of a source's blocks, and the partial pass takes blocks in its order
while they fit, then documents of the block that does not.

Tokens are words. A null source counts as the source '', a null text as empty. Sources without a word get weight 0. Rows
that share a doc_id are placed alike. A budget is undershot by less than one document for each source. Sources are counted
before their table is broadcast; beyond ``BROADCAST`` sources it is joined by shuffles instead. Empty tables give no rows.
Texts of any length are counted whole. Columns besides those that are asked for are left out, or kept as they are where whole
rows are mixed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import written

WORD = r"[^\x20\x09-\x0D]+"
ENTROPY_SHARE, REPEATS, HIGHEST = 0.9, 4.0, 4.0
#: Documents of a block while a source has at most BLOCKS blocks; larger sources have BLOCKS larger ones.
BLOCK_DOCS, BLOCKS = 256, 1 << 16
BROADCAST = 10_000
HALVINGS, PASSES = 5, 8


def doc_key() -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def block_of(key: Column, n_blocks: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_blocks


def block_key(source: Column, block: Column, number: Column) -> Column:
    """Where a block stands in a pass: a pass sorts a source's blocks by this."""
    return F.md5(F.concat_ws(":", source, block.cast("string"), number.cast("string")))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, key) of every row."""
    return docs.select("doc_id", source_key().alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"), doc_key().alias("key"))


def exponent(sources: DataFrame, budget: int, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> float:
    """The least exponent in [0, HIGHEST] that meets both limits (HIGHEST if none does), to six places. Each pass evaluates
    2 ** HALVINGS exponents on the cluster, and the driver gets one row for each."""
    low, high, steps = 0.0, HIGHEST, 1 << HALVINGS
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = sources.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"), (F.col("tokens") / F.lit(float(total))).alias("p"))
    for _ in range(PASSES):
        grid = F.explode(F.array(*(F.lit(low + k * (high - low) / steps) for k in range(1, steps + 1))))
        power = F.pow("p", F.col("x"))
        found = shares.withColumn("x", grid).groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("e"), F.max(power / F.col("t")).alias("r"), F.count("*").alias("k"))
        rows = found.select("x", ((F.log("z") - F.col("x") * F.col("e") / F.col("z") <= entropy_share * F.log("k")) & (F.col("r") / F.col("z") * budget <= repeats)).alias("ok")).orderBy("x").collect()
        high = next((r.x for r in rows if r.ok), high)
        low = max([low, *(r.x for r in rows if r.x < high and not r.ok)])
    return round(high, 6)


def plan(tokens: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source: n_docs, tokens, weight, whole passes, n_blocks, and where the partial pass ends: the last block's
    key and number, and the key of the last document taken from it (null: none of it)."""
    grouped = tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    sources = written(grouped, "sources")
    budget = budget if budget is not None else sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    x = exponent(sources, budget, entropy_share, repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    goal = F.floor(F.col("weight") * F.lit(float(budget))).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.greatest("tokens", F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))
    sources = (
        sources.withColumn("weight", power / F.lit(z)).withColumn("goal", goal).withColumn("passes", whole)
        .withColumn("rest", F.col("goal") - F.col("passes") * F.col("tokens"))
        .withColumn("n_blocks", F.least(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(BLOCKS)).cast("long"))
    )
    sources = written(sources, "weights")
    placed = with_sources(tokens, sources.select("source", "passes", "rest", "n_blocks")).withColumn("block", block_of(F.col("key"), F.col("n_blocks")))
    blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("at", block_key(F.col("source"), F.col("block"), F.col("passes")))
    order = Window.partitionBy("source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = blocks.withColumn("upto", F.sum("n").over(order)).filter("upto > rest and upto - n <= rest")
    last = last.groupBy("source").agg(F.min(F.struct("at", "block", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))).alias("last")).select("source", F.col("last.at").alias("last_at"), F.col("last.block").alias("last_block"), F.col("last.room").alias("room"))
    inside = with_sources(placed, last).filter(F.col("block") == F.col("last_block"))
    order = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("upto", F.sum("n_tokens").over(order)).filter("upto <= room")
    ends = taken.groupBy("source").agg(F.max("key").alias("last_key"))
    return written(sources.join(last.select("source", "last_at", "last_block"), "source", "left").join(ends, "source", "left"), "plan")


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    few = sources.limit(BROADCAST + 1).count() <= BROADCAST
    return rows.join(F.broadcast(sources) if few else sources, "source")


def copies(source: Column, key: Column, own: Callable[[str], Column]) -> tuple[Column, Column]:
    """A row's block, and how often the row is taken; ``own`` gives the columns of its source's plan."""
    block = block_of(key, own("n_blocks"))
    at = block_key(source, block, own("passes"))
    level = (at == own("last_at")) & (block == own("last_block"))
    before = (at < own("last_at")) | ((at == own("last_at")) & (block < own("last_block")))
    partial = (own("rest") > 0) & F.coalesce(before | (level & (key <= own("last_key"))), F.lit(False))
    return block, (own("passes") + F.when(partial, 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> DataFrame:
    """(doc_id, source, n_tokens, pass, block, block_key): a row each time that a document is taken. A pass's order is
    block_key, then the documents' own hash; passes follow each other."""
    tokens = written(counted(docs), "tokens")
    found = with_sources(tokens, plan(tokens, budget, entropy_share, repeats).drop("n_docs", "tokens", "goal", "weight"))
    block, taken = copies(F.col("source"), F.col("key"), F.col)
    found = found.withColumn("block", block).withColumn("copies", taken).filter("copies > 0")
    found = found.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return found.select("doc_id", "source", "n_tokens", "pass", "block", block_key(F.col("source"), F.col("block"), F.col("pass")).alias("block_key"))


def mixed_rows(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with the same columns and without a shuffle of texts. Rows
    travel as one struct, so that their columns may have any names."""
    chosen = plan(written(counted(docs), "tokens"), budget, entropy_share, repeats).drop("n_docs", "tokens", "goal", "weight")
    chosen = chosen.select(F.col("source").alias("name"), F.struct(*chosen.columns).alias("plan"))
    few = chosen.limit(BROADCAST + 1).count() <= BROADCAST
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_key().alias("key"), source_key().alias("own"))
    rows = rows.join(F.broadcast(chosen) if few else chosen, F.col("own") == F.col("name"))
    _, taken = copies(F.col("own"), F.col("key"), lambda c: F.col(f"plan.{c}"))
    taken = rows.select("row", taken.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("number")).select("row.*")
