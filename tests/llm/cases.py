"""Awkward rows for every operator."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, list string"

CLEAN = " ".join(f"word{i} of sense" for i in range(40))


def rows():
    texts = [None, "", " \n\t", "one", "two words", CLEAN, CLEAN, CLEAN.replace("word7 ", "other "), CLEAN.upper(), "x" * 5000, "é中😀 " * 60, "a b c d " * 400, (CLEAN + "\n") * 30, "  " + CLEAN]
    return [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 3}", None if t is None else len(t), 1, "x", None) for i, t in enumerate(texts)]


def frame(spark, more=()):
    return spark.createDataFrame([*rows(), *more], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return {r[0]: r[1] or "" for r in rows()}


#: Columns whose names operators might use themselves.
CLASHES = ["_key", "_own", "_copies", "_pass", "_source", "_plan", "_gone", "list", "packet", "row", "id", "tie", "doc", "number", "name", "plan", "key", "own", "copies", "text_hash", "group", "kind", "n_tokens", "component_id"]


def awkward(spark):
    """The rows above, and: null ids, one id on two texts, rows twice, bytes that are no UTF-8, columns with clashing names."""
    from pyspark.sql import functions as F

    more = [(None, CLEAN, "en", "src1", 5, 1, "x", None), (None, CLEAN, "en", None, 5, 1, "x", None), (6, "another text on a taken number", "en", "src1", 30, 1, "x", None)]
    more += [(5, CLEAN + " more", "en", "src1", None, None, None, None), (7, rows()[7][1], "en", "src0", 9, 1, "x", None), (70, CLEAN + " " + CLEAN.replace("sense", "wit"), "en", "src2", 3, 1, "x", None)]
    docs = frame(spark, more)
    docs = docs.unionByName(docs.filter("doc_id in (7, 9)"))
    broken = spark.range(90, 92).select(F.col("id").alias("doc_id"), F.expr("cast(concat(X'ff80', cast(repeat('some words here ', 20) as binary), X'c3') as string)").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit(1).alias("n_words"), F.lit("x").alias("kept"), F.lit(None).cast("string").alias("list"))
    docs = docs.unionByName(broken)
    for c in CLASHES:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.concat(F.lit("USER"), F.col("doc_id").cast("string")))
    return docs
