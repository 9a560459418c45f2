"""Batched searches through dictionaries, staged duplicates, and tables that are laid out alike."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import duplicates, live, published, search
from shelfmark.plans import query
from shelfmark.sources import catalog as src

from .test_service import fill, rows

BASE = "volume string, file_id long, parent_id long, size_bytes long, flags int, name string"


def distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row[-1]


def stem(name):
    return name[: name.rindex(".")] if "." in name else name


def test_the_dictionary_finds_all_names_within_two_edits(spark):
    """Short names, repeated letters, more bytes than letters, no stem, empty names; few candidates are in vain."""
    rng = random.Random(4)
    names = {"", "a", "ab", "abc", "ab.c", "aba.b.c", "node.exe", "éa.txt", "éab", "ab" * 40}
    names |= {"ab" + "".join(rng.choice("abc.") for _ in range(rng.randint(0, 12))) for _ in range(60)}
    names |= {f"abel-{rng.randrange(10**9)}-{'xyz' * rng.randint(0, 3)}.dat" for _ in range(80)}
    texts = {n[: rng.randint(0, len(n))] + rng.choice(["", "x", "zz"]) + n[rng.randint(0, len(n)) :] for n in names}
    texts |= {n[:3] + n[4:7] + n[8:] for n in names} | {"a", "ab", "abx", "éaé"}
    view = spark.createDataFrame([("C", i, 5, 0, 0, n) for i, n in enumerate(sorted(names))], BASE).withColumn("name_norm", F.lower("name"))
    asked = spark.createDataFrame([(t,) for t in texts if t], "q string")
    words = search.dictionary(view).cache()
    near = search.fuzzy_candidates(words, asked).cache()
    tried = {(r.q, r.form) for r in near.collect()}
    forms = {(n, f) for n in names for f in {n, stem(n)}}
    want = {(t, f) for t in texts if t for n, f in forms if t[:2] == n[:2] and distance(t, f) <= 2}
    assert want <= tried
    pairs = sum(t[:2] == n[:2] for t in texts if t for n, f in forms)
    assert len(tried) < pairs / 4  # a scan by the first two letters compares all of these
    got = sorted(tuple(r) for r in search.fuzzy_batch(view, words, asked.select(F.col("q").alias("query_id"), F.col("q").alias("text")), 5).select("query_id", "file_id", "distance", "rank").collect())
    for t in sorted(texts - {""})[::70]:
        alone = search.fuzzy(view, t, 5).collect()
        assert [(r.file_id, r.distance, r.rank) for r in alone] == [x[1:] for x in sorted((x for x in got if x[0] == t), key=lambda x: x[3])]


def test_batched_ranks_search_each_text_once(spark):
    view = spark.createDataFrame([("C", i, 5, 0, i % 2, n) for i, n in enumerate(["red", "redo", "re", "r", "blue", "blur", "b"] * 3)], BASE).withColumn("name_norm", F.lower("name"))
    queries = spark.createDataFrame([(k, t) for k in range(40) for t in ["red" if k % 3 else "b"]] + [(99, t) for t in ["r", "re", "bl", "", None]] + [(100, "redo" * k) for k in range(1, 12)], "query_id int, text string")
    got = search.ranked_batch(view, queries, 4)
    for k, t in ((1, "red"), (3, "b")):
        assert rows(got.filter(f"query_id = {k}").drop("query_id")) == rows(search.ranked(view, t, 4))
    assert got.filter("query_id = 99").count() == 4 and got.filter("query_id = 100").count() == 3


def test_a_collision_of_samples_or_hashes_is_told_apart(spark):
    """Two files agree in size and both ends, and a digest that always collides groups unlike contents."""
    middle = lambda c: "a" * duplicates.SAMPLE + c * 10 + "b" * duplicates.SAMPLE
    contents = [middle("x"), middle("y"), middle("x"), "same", "same", "none", "some", "alone!!"]
    files = spark.createDataFrame([("C", i, len(t), t) for i, t in enumerate(contents)], "volume string, file_id long, size_bytes long, text string")
    stages = duplicates.staged(files, 1)
    ids = lambda df: sorted(r.file_id for r in df.collect())
    assert ids(stages["size"]) == [0, 1, 2, 3, 4, 5, 6] and ids(stages["sample"]) == [0, 1, 2, 3, 4] and ids(stages["hash"]) == [0, 2, 3, 4]
    sets = lambda s: sorted((r.file_id, r.first.file_id) for r in s["bytes"].collect())
    assert sets(stages) == [(0, 0), (2, 0), (3, 3), (4, 3)]
    assert sets(duplicates.staged(files, 1, digest=lambda t: F.lit("one"))) == sets(stages)
    assert sets(duplicates.staged(files, 1, sample=lambda t: F.lit(1).cast("long"), digest=lambda t: F.substring(t, 1, 1))) == sets(stages)
    read = {r.stage: (r.files, r.bytes) for r in duplicates.read_by_stage(files, stages, 1).collect()}
    big = len(contents[0])
    assert read == {"size": (8, 0), "sample": (7, 3 * 2 * duplicates.SAMPLE + 16), "hash": (5, 3 * big + 8), "bytes": (4, 2 * big + 8)}
    assert duplicates.staged(files.limit(0), 1)["bytes"].count() == 0


@pytest.fixture
def store(spark, tmp_path):
    fill(spark, tmp_path)
    return published.Catalog(spark, str(tmp_path), str(tmp_path / "store"), buckets=4)


def test_nothing_is_exchanged_above_the_base(spark, store, tmp_path):
    """With joins by sorting, as for an overlay of any size: the view by id, and its attributes, shuffle no base row. The
    same from a session that did not write the tables."""
    store.table("attributes")
    again = published.Catalog(spark, str(tmp_path), store.root)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith(("by_id_", "overlay_", "attributes_"))]:
        spark.sql(f"DROP TABLE {name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        view = again.live("by_id")
        kept = again.table("by_id").join(again.table("overlay").select(*live.KEY), live.KEY, "left_anti")
        assert "SortMergeJoin" in plan(view) and "Exchange" not in plan(view)
        assert "Exchange" not in plan(live.with_attributes(kept, again.table("attributes")))
        want = live.live_view(src.catalog(spark, str(tmp_path)), src.changes(spark, str(tmp_path)))
        assert rows(view.select(want.columns)) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranges_of_size_and_date_are_pushed(spark, store):
    plan = lambda q: search.filtered(store.live(), store.attributes(q), q, directories=store.table("directories"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size_bytes,1001)" in plan("size:>1000") and "by_size" in store.attributes("size:>1000").inputFiles()[0]
    assert "GreaterThanOrEqual(modified_unix_secs," in plan("date:>=2024-01-10") and "by_date" in store.attributes("date:>=2024-01-10").inputFiles()[0]
    assert "attributes" in store.attributes("ext:md").inputFiles()[0]


def test_sizes_beyond_64_bits_are_no_sizes():
    assert query.size_of("18446744073709551615") is None or query.size_of("1k") is not None
    assert query.size_of("99999999999999999999999") is None and query.parse("size:>99999999tb9").rejected


def test_a_query_name_is_taken_once():
    from shelfmark import catalog_queries

    catalog_queries.queries()
    with pytest.raises(ValueError, match="taken"):
        catalog_queries.query("q8_ranked_by_volume")


def test_batches_sort_what_was_dealt_and_no_joined_rows(spark):
    """In a plan of batched searches, what is sorted for ranks comes from an exchange, so that no task sorts all hits of the
    rows that it scans."""
    view = spark.createDataFrame([("C", i, 5, 0, i % 3, n) for i, n in enumerate(["green-tin.dat", "green-tan.dat", "grey.dat"] * 200)], BASE).withColumn("name_norm", F.lower("name"))
    asked = spark.createDataFrame([(k, t) for k in range(60) for t in (["green-tin.dat"] if k % 4 else ["green-ton.dat", "grex.dat"])], "query_id int, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (search.fuzzy_batch(view, search.dictionary(view), asked, 4), search.ranked_batch(view, asked, 4)):
            plan = [re.sub(r"^[\s:+|*()0-9-]*", "", x) for x in found._jdf.queryExecution().executedPlan().toString().split("\n")]
            for i, line in enumerate(plan):
                if line.startswith("WindowGroupLimit") and plan[i + 1].startswith("Sort"):
                    below = next(x for x in plan[i + 2 :] if not x.startswith(("Project", "Filter")))
                    assert below.startswith(("Exchange", "ReusedExchange", "Window")), below
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    got = search.fuzzy_batch(view, search.dictionary(view), asked, 4)
    for k, texts in ((1, ["green-tin.dat"]), (4, ["green-ton.dat", "grex.dat"])):
        every = sorted(((r.distance, -r.score, r.volume, r.file_id) for t in texts for r in search.fuzzy(view, t, 10_000).collect()))[:4]
        assert [(r.distance, -r.score, r.volume, r.file_id) for r in got.filter(f"query_id = {k}").orderBy("rank").collect()] == every
    assert got.count() == 60 * 4
