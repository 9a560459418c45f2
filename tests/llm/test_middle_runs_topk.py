"""Fill-in-middle cuts, periodic runs and exact top-k against brute force and DuckDB, and on awkward rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.llm import fim, periods, topk

from . import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_periodic_runs", "op13_exact_top_k"])
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    rows = lambda found, columns: sorted(repr(sorted(zip(columns, r, strict=True))) for r in found)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


# Fill-in-middle


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_cuts_by_brute_force(size):
    """Every cut of texts of many blocks, in code points, found by descent."""
    for text in ("", "a", "é中😀 x" * 9, "plain words here", "\n\n é\t"):
        blocks = fim.Blocks(text.encode(), size=size)
        assert blocks.units == blocks.points == len(text)
        for n in range(len(text) + 1):
            assert blocks.cut(n) == (len(text[:n].encode()), n)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_words_as_units(size):
    for text, units in [("  é one  two\n", ["  é ", "one  ", "two\n"]), ("one two", ["one ", "two"]), (" \n", [" \n"]), ("", [])]:
        blocks = fim.Blocks(text.encode(), "words", size)
        assert blocks.units == len(units)
        for n in range(len(units) + 1):
            upto = "".join(units[:n])
            assert blocks.cut(n) == (len(upto.encode()), len(upto))


def middle_by_brute_force(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, z - a, f"<S>{text[z:]}<P>{text[:a]}<M>{text[a:z]}"
    return n, "psm", a, z - a, f"<P>{text[:a]}<S>{text[z:]}<M>{text[a:z]}"


def test_middle_on_awkward_rows(spark):
    """Nulls, marks inside texts, halves of marks where texts are cut, a very long text, clashing columns."""
    more = [(200 + i, t, None, None, None, None, None, None) for i, t in enumerate(["<P>", "a<S>b", "<M", "<" * 40, "S>P>M>" * 9, "<S<P<M" * 50, "é😀" * 300_000])]
    docs = cases.awkward(spark).filter("doc_id is null or doc_id < 90").unionByName(cases.frame(spark, more).filter("doc_id >= 200"), allowMissingColumns=True)
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = fim.transformed(docs)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((d, *middle_by_brute_force(d, t))) for d, t in texts)
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(map(repr, texts))
    assert fim.digests(fim.transformed(cases.empty(spark))).count() == 0


def test_middle_keeps_bytes_that_are_no_text(spark):
    docs = cases.awkward(spark).filter("doc_id >= 90")
    rows = fim.transformed(docs, rate=100).join(docs.select("doc_id", "text"), "doc_id")
    assert rows.filter(fim.restored(F.col("output"), F.col("form")).cast("binary") != F.col("text").cast("binary")).isEmpty()
    assert rows.filter("form = 'plain'").isEmpty()


# Periodic runs


def runs_by_brute_force(words, least=periods.LEAST):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, 2 * q):
                found.setdefault((at, end + q), q)
            at = max(end, at + 1)
    return sorted([a, z, q] for (a, z), q in found.items())


def repetitive(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 12 else 0):
        a = rng.randrange(n)
        p, z = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
        for i in range(a, z):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("core", [4, 256])
def test_runs_by_brute_force(monkeypatch, core):
    """Several texts at once, with planted repeats over few and many kinds of words; blocks longer than their core too."""
    monkeypatch.setattr(periods, "CORE", core)
    rng = random.Random(core)
    for _ in range(300):
        texts = [repetitive(rng, rng.choice([0, 1, 12, 40, 250]), rng.choice([1, 2, 3, 60])) for _ in range(rng.randint(1, 4))]
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        want = [[b + s, b + e, q] for b, t in zip(bounds[:-1].tolist(), texts, strict=True) for s, e, q in sorted(runs_by_brute_force(t), key=lambda r: (r[0], r[2]))]
        assert periods.runs_of(np.array(sum(texts, []), np.int32), bounds).tolist() == want


def test_transform_is_exact():
    """Correlations through the spectrum equal sums of products modulo the prime."""
    rng = np.random.default_rng(3)
    for size in (8, 16, 128, 1024):
        blocks, windows = periods.reduced(rng.integers(0, 1 << 20, (2, 3, size)).astype(float))
        blocks[:, size // 4 :] = 0
        got = periods.transform(size).correlated(blocks, windows)
        want = [[sum(int(b[i]) * int(w[(i + t) % size]) for i in range(size // 4)) for t in range(size)] for b, w in zip(blocks, windows, strict=True)]
        assert ((got.astype(np.int64) - np.array(want)) % periods.PRIME == 0).all()


def test_equal_residues_are_no_run():
    """Numbers that only the modulus makes equal seed an extension and are dropped there."""
    ids = np.arange(40, dtype=np.int32)
    ids[20:] = ids[:20] + periods.PRIME
    assert len(periods.runs_of(ids, np.array([0, 40]))) == 0


@pytest.mark.parametrize("period", [1, 3, 70_001])
def test_runs_of_a_long_text(period):
    words = np.arange(300_000, dtype=np.int32) % period
    assert periods.runs_of(words, np.array([0, len(words)])).tolist() == [[0, len(words), period]]


def test_runs_on_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = sorted(map(repr, (tuple(r) for r in periods.found(docs, rewriting=periods.planted).select("doc_id", "n_words", "runs", F.col("collapsed").cast("binary")).collect())))
    want = []
    for d, text in ((r.doc_id, bytes(r.t or b"")) for r in docs.select("doc_id", F.col("text").cast("binary").alias("t")).collect()):
        words = text.split()
        order = periods.planted(d, len(words))
        words = words if order is None else [words[i] for i in order]
        runs = sorted(runs_by_brute_force(words), key=lambda r: (r[0], r[2]))
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        want.append(repr((d, len(words), [Row(start=s, length=e - s, period=q) for s, e, q in runs], bytes(b" ".join(w for i, w in enumerate(words) if i not in gone)))))
    assert got == sorted(want)
    assert periods.digests(periods.found(cases.empty(spark))).count() == 0


def test_words_are_numbered_in_pieces(monkeypatch):
    from collections import defaultdict

    text = ("é中 word \x0b more\n" * 50).encode()
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    monkeypatch.setattr(periods, "PIECE", 5)
    order = periods.numbered(text, numbers).tolist()
    assert [list(numbers)[i] for i in order] == text.split()


# Exact top-k


def best_by_brute_force(rows, queries, k):
    out = []
    for q in queries:
        asked = min(tuple(v) for i, v in rows if i == q)
        found = sorted((-sum(int(a) * int(b) for a, b in zip(asked, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(asked))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def searched(spark, rows, k=10, size=16, block=4, schema="vec_id long, embedding array<double>, dims int, ids string, shard string, lane string, rank string, score string"):
    table = spark.createDataFrame([(*r, *([None] * (len(schema.split(", ")) - 2))) for r in rows], schema).repartition(3)
    found = topk.search(topk.index(table, "vec_id", "embedding", size), table.filter("vec_id % 100 = 0"), "vec_id", "embedding", k, block)
    return sorted(tuple(r) for r in found.collect())


def test_best_by_brute_force(spark):
    """Ties, repeated rows, a third of all rows equal, and shards of a few vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(450)] + rows[150:160]
    floored = [(i, [np.floor(1024 * x) for x in v]) for i, v in rows]
    assert searched(spark, rows, size=64) == best_by_brute_force(floored, range(0, 1401, 100)[:9] and sorted({i for i, _ in rows if i % 100 == 0}), 10)


def test_vectors_that_take_no_part(spark):
    """Nulls, null and infinite components, null ids, other lengths, ids on two rows, fewer than k; huge numbers are exact."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (5, [1.0]), (6, [0.25, -3.0]), (7, [1.0, 2.0])]
    rows += [(100, [3.0, 0.0]), (100, [2.0, 5.0]), (200, []), (8, []), (300, [1e308, 0.0]), (400, [2.0**40, 1.0, 1.0]), (9, [2.0**40, -1.0, 2.0])]
    floored = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(1024 * x) for x in v)]
    want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in best_by_brute_force(floored, [0, 100, 200, 400], 10)]
    assert searched(spark, rows) == want
    assert searched(spark, rows[1:4]) == [] and searched(spark, rows[:1]) == []


def test_reading_stops_before_the_lists_end():
    """With a bar from elsewhere, most queries stop early, and what they keep holds all that reaches it."""
    rng = np.random.default_rng(7)
    vectors = np.floor(128 * rng.normal(0, 1, (2000, 32)))
    queries, own = vectors[:40], np.arange(40)
    scores = queries @ vectors.T
    scores[own, own] = -np.inf
    bars = np.sort(scores, axis=1)[:, -5]
    lists = topk.Lists(np.arange(2000), vectors)
    kept = dict(lists.candidates(queries, own, 5, bars))
    assert all(set(np.flatnonzero(scores[q] >= bars[q])) <= set(kept[q].tolist()) for q in range(40))
    assert np.mean([share < 1 for share in lists.read_share]) > 0.9


def test_search_has_no_cross_join(spark):
    df = entry.queries()["op13_exact_top_k"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
