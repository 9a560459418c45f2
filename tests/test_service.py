"""Published tables, routing, models, web answers, quarantine and the service around the journal."""

import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names, web
from shelfmark.operators import live, maintenance, model, published, search
from shelfmark.sources import catalog as src
from shelfmark.streaming import journal as stream

BASE = "volume string, file_id long, parent_id long, size_bytes long, flags int, name string"


def fill(spark, home):
    """Small source tables."""
    spark.createDataFrame([(i, f"some text {i} of it", ["de", "en"][i % 2], f"src{i % 3}", 20) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(home / "documents.parquet"))
    spark.createDataFrame([(i, f"red part{i}", f"Brand#1{i % 3}", i % 9) for i in range(300)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(home / "part.parquet"))
    spark.createDataFrame([(i, i % 7, ["signup", "error", "view"][i % 3]) for i in range(60)], "event_id long, user_id long, event_type string").write.parquet(str(home / "events.parquet"))
    spark.createDataFrame([(i, f"http://x/a/page-{i % 4}", f"<p>{i}</p>") for i in range(9)], "page_id long, url string, html string").write.parquet(str(home / "pages.parquet"))


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of small source tables."""
    fill(spark, tmp_path)
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_published_view_is_the_live_view(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    want = live.live_view(src.catalog(spark, tables), src.changes(spark, tables))
    columns = sorted(want.columns)
    assert rows(found.live().select(columns)) == rows(want.select(columns)) and rows(found.live("by_id").select(columns)) == rows(want.select(columns))
    assert rows(found.with_paths(found.live()).select("volume", "file_id", "path")) == rows(live.with_paths(want, want).select("volume", "file_id", "path"))


def test_searches_push_their_filters(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name_norm,red)" in plan(search.ranked(found.live(), "red"))
    assert "EqualTo(name_norm,node.exe)" in plan(search.exact(found.live(), "node.exe"))
    assert "EqualTo(file_id,1000007)" in plan(live.by_id(found.live("by_id"), "C", 1_000_007))
    assert "EqualTo(token,some)" in plan(search.holding(found.table("postings"), "some")) or "In(token" in plan(search.holding(found.table("postings"), "some"))


def append_event(spark, tables, *events):
    spark.createDataFrame(list(events), "event_id long, user_id long, event_type string").write.mode("append").parquet(f"{tables}/events.parquet")
    spark.catalog.refreshByPath(f"{tables}/events.parquet")


def damage(spark, root, line, kind, how):
    path = f"{root}/{line.path}"
    if how == "missing":
        shutil.rmtree(path)
    elif how == "short":
        spark.createDataFrame([], published.TABLES[kind][0]).write.mode("overwrite").parquet(path)
    else:
        spark.range(3).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)


def everything(found):
    """The view by name and by id, its paths, its postings and its attributes."""
    lists = found.table("postings").select("token", "volume", "block", F.explode("offsets").alias("o"))
    view = found.live().select("volume", "file_id", "parent_id", "name", "flags")
    return rows(view), rows(found.live("by_id").select(view.columns)), rows(found.with_paths(found.live()).select("volume", "file_id", "path")), rows(lists), rows(found.attributes("size:>0"))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Source tables and a store with three stages: a scan in the journal's middle, a refresh, a compaction with all tables."""
    home = tmp_path_factory.mktemp("history")
    fill(spark, home)
    root = str(home / "store")
    published.Catalog(spark, str(home), root, upto=30).snapshot()
    found = published.Catalog(spark, str(home), root)
    found.refresh()
    found.maintain()
    for kind in published.TABLES:
        found.table(kind)
    return str(home), root, everything(found)


@pytest.mark.parametrize("kind", sorted(published.TABLES))
def test_damage_of_any_table_leaves_one_snapshot(spark, history, tmp_path, kind):
    """After a compaction one table of its commit is damaged: whoever opens the catalog sees all of an older commit, with the
    journal after it, and never a base of one with an overlay of another."""
    tables, before, want = history
    root = str(tmp_path / "store")
    shutil.copytree(before, root)
    last = published.snapshot_of(published.commits(spark, root).orderBy(F.desc("version")).first())
    damage(spark, root, last.tables[kind], kind, ["missing", "short", "other"][len(kind) % 3])
    fresh = published.Catalog(spark, tables, root)
    assert everything(fresh) == want and not fresh.pending()


def test_a_snapshot_behind_is_brought_forward(spark, history, tmp_path):
    """Only the scan in the journal's middle is left whole."""
    tables, before, want = history
    root = str(tmp_path / "store")
    shutil.copytree(before, root)
    first = published.snapshot_of(published.commits(spark, root).orderBy("version").first())
    for row in published.commits(spark, root).collect():
        overlay = published.snapshot_of(row).tables["overlay"]
        if overlay != first.tables["overlay"]:
            shutil.rmtree(f"{root}/{overlay.path}", ignore_errors=True)
    assert published.newest(spark, root) == first
    fresh = published.Catalog(spark, tables, root)
    assert everything(fresh) == want and fresh.snapshot().version > first.version and not fresh.pending()


def test_repair_commits_whole_tables(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    found = published.Catalog(spark, tables, root)
    want = everything(found)
    assert found.repair() == []
    last = published.snapshot_of(published.commits(spark, root).orderBy(F.desc("version")).first())
    for kind in ("base", "postings"):
        damage(spark, root, last.tables[kind], kind, "missing")
    fresh = published.Catalog(spark, tables, root)
    assert fresh.repair() == ["base", "postings"] and fresh.repair() == [] and everything(fresh) == want
    for t in {t.path for r in published.commits(spark, root).collect() for k, t in published.snapshot_of(r).tables.items() if k == "overlay"}:
        shutil.rmtree(f"{root}/{t}")
    assert published.newest(spark, root) is None
    assert everything(published.Catalog(spark, tables, root)) == want


def test_of_two_publishers_one_wins(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    one, two = published.Catalog(spark, tables, root), published.Catalog(spark, tables, root)
    one.table("overlay"), two.table("overlay")
    append_event(spark, tables, (902, 5, "signup"))
    assert one.refresh()
    with pytest.raises(published.Conflict):
        two.refresh()
    with pytest.raises(published.Conflict):
        two.maintain()
    again = published.Catalog(spark, tables, root)
    assert rows(again.live()) == rows(one.live()) and not again.pending()
    assert published.commits(spark, root).filter(f"version = {again.snapshot().version}").count() == 1
    # Derived tables join what another has added meanwhile.
    one.table("attributes")
    again.table("postings")
    assert {"attributes", "postings"} <= set(published.newest(spark, root).tables)


def test_many_claims_of_one_number(spark, tmp_path):
    """Eight threads rename to one path at once."""
    from concurrent.futures import ThreadPoolExecutor

    from shelfmark.storage import claimed

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claimed(spark.range(k, k + 1), str(tmp_path / "commits" / "version=1"), str(tmp_path / "staged" / f"t{k}")), range(8)))
    assert sum(won) == 1
    assert [r.id for r in spark.read.json(str(tmp_path / "commits/version=1/part-*")).collect()] == [won.index(True)]


def test_stale_tables_are_refused_or_built_again(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    found = published.Catalog(spark, tables, root, stale="refuse")
    for kind in ("attributes", "by_size", "postings", "directories"):
        found.table(kind)
    append_event(spark, tables, (903, 6, "signup"))
    found.refresh()
    for query in ("x", "size:>1"):
        with pytest.raises(published.Stale):
            found.attributes(query)
    with pytest.raises(published.Stale):
        search.by_mode(found, "Content", "some text")
    found.table("directories")  # a file's new name touches no directory
    found.build("attributes")
    found.attributes("x")
    assert published.Catalog(spark, tables, root).attributes("size:>1").count() == 340


def test_refresh_reads_the_journals_new_part(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    found.table("directories")
    before = found.snapshot()
    append_event(spark, tables, (904, 2, "error"), (905, 3, "purchase"))
    plan = found.changes(before.position, 905)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThan(event_id,{before.position})" in plan
    assert found.refresh() and found.snapshot().tables["base"] == before.tables["base"]
    assert found.snapshot().tables["directories"].path == before.tables["directories"].path
    want = live.live_view(src.catalog(spark, tables), src.changes(spark, tables))
    assert rows(found.live().select(want.columns)) == rows(want)


def test_another_journal_means_a_new_scan(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    found.table("overlay")
    spark.createDataFrame([(7, 1, "signup"), (8, 2, "error")], "event_id long, user_id long, event_type string").write.mode("overwrite").parquet(f"{tables}/events.parquet")
    spark.catalog.refreshByPath(f"{tables}/events.parquet")
    assert found.pending() and found.refresh() and not found.refresh()
    want = live.live_view(src.catalog(spark, tables), src.changes(spark, tables))
    assert rows(found.live().select(want.columns)) == rows(want)


def test_scopes_are_ranges_of_keys(spark, tables, tmp_path):
    """A scope is pushed to the directories' scan, and its rows are those whose paths say so, orphans too."""
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    view, directories = found.live(), found.table("directories")
    assert "StringStartsWith(scope,c:\\en\\)" in live.in_scope(view, view, directories, "C:/EN")._jdf.queryExecution().executedPlan().toString()
    orphans = spark.createDataFrame([("C", 70, 69, 0, 0, "EN", "en")], view.schema)
    view = view.unionByName(orphans)
    for scope in ("C:/EN", "c:\\en\\src1", "C:", "D:\\Brand#11\\", "D:/nothing"):
        want = live.with_paths(view, view, directories).filter(names.within_scope(F.col("path"), scope))
        assert rows(live.in_scope(view, view, directories, scope).select("volume", "file_id", "path")) == rows(want.select("volume", "file_id", "path")), scope


def test_lists_of_several_blocks(spark):
    """Ids of many blocks, repeated rows, and tokens of very different frequency."""
    files = spark.createDataFrame([("C", i * 7001, f"every {'some ' if i % 3 == 0 else ''}{'rare' if i in (30, 33) else ''}") for i in range(300)] + [("C", 0, "every some ")], "volume string, file_id long, text string")
    lists = search.posting_lists(search.postings(files))
    ids = lambda text: sorted(r.file_id for r in search.holding(lists, text).collect())
    assert ids("every") == [i * 7001 for i in range(300)] and ids("some every") == [i * 7001 for i in range(0, 300, 3)]
    assert ids("rare some every") == [30 * 7001, 33 * 7001] and ids("rare none") == [] and ids("!") == []
    assert lists.agg(F.max(F.size("offsets"))).first()[0] <= 1 << search.BLOCK_BITS and lists.filter("files != size(offsets)").isEmpty()


def test_maintenance_and_guard(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    before = found.live()
    old = rows(before.select("volume", "file_id", "name"))
    assert not found.refresh()
    append_event(spark, tables, (900, 3, "signup"))
    with pytest.raises(RuntimeError):
        found.build("postings")
    assert found.refresh() and not found.refresh()
    found.build("postings")
    now = rows(found.live().select("volume", "file_id", "name"))
    assert ("D", 1_000_003, "renamed-900.txt") in now and rows(before.select("volume", "file_id", "name")) == old
    health = {r.volume: r for r in found.maintain().collect()}
    assert found.table("overlay").isEmpty() and rows(found.live().select("volume", "file_id", "name")) == now == rows(found.table("base").select("volume", "file_id", "name"))
    assert health["D"].delta_entries == 0 and health["D"].records == sum(v == "D" for v, _, _ in now)


def test_rebuild_lays_what_came_during_the_scan_over_it(spark):
    base = spark.createDataFrame([("D", 5, 5, 0, 1, "D:"), ("D", 6, 5, 0, 0, "a")], BASE).withColumn("name_norm", F.lower("name"))
    changes = spark.createDataFrame([("D", 1, "Delete", 6, 5, 0, 0, ""), ("D", 8, "Upsert", 7, 5, 0, 0, "b")], "volume string, seq long, op string, file_id long, parent_id long, size_bytes long, flags int, name string")
    assert {r.name for r in maintenance.rebuilt(base, changes, 5, 1).collect()} == {"D:", "a", "b"}
    with pytest.raises(ValueError):
        maintenance.rebuilt(base, changes, 5, 6)


@pytest.mark.parametrize(("query", "guess", "want"), [("give me renamed ones", ("Help", 80), "Help"), ("give me renamed ones", ("Help", 60), "ExactSearch"), ("cleanup now", ("Help", 99), "CleanupAnalysis")])
def test_route(spark, query, guess, want):
    class Fixed:
        def classify(self, q):
            return guess[0], guess[1], 3

    row = search.route(spark, query, Fixed())
    assert row.intent == want and row.margin == 3 and row.by == ("rule" if "cleanup" in query else "model")


def test_smart_branches(spark, tables, tmp_path):
    found = published.Catalog(spark, tables, str(tmp_path / "store"))
    blank = model.Model.blank()
    assert search.smart(found, "help please", blank).columns == ["usage"]
    assert [r.link for r in search.smart(found, "search web page-3", blank).collect()] == ["http://x/a/page-3"]
    assert search.smart(found, "search web nowhere", blank).count() == 0
    assert "action" in search.smart(found, "cleanup of old build trees", blank).columns
    assert all(r.name.startswith("renamed") for r in search.smart(found, "give me renamed ones", blank).collect())


def test_explained_routes_are_the_routes(spark):
    queries = ["find files containing rust", "something else entirely here", "node js", "clean the garden"]
    log = spark.createDataFrame([(q,) for q in queries], "q string")
    m = model.train(["find the file", "clean the garden"], ["ExactSearch", "CleanupAnalysis"])
    got = {r.q: (r.intent, r.by, r.confidence, r.margin, r.subject, r.terms) for r in model.explained(log, "q", m, search.SURE).collect()}
    for q in queries:
        r = search.route(spark, q, m)
        assert got[q] == (r.intent, r.by, r.confidence, r.margin, r.subject, r.terms)


def test_classification_by_brute_force(spark):
    """Buckets letter by letter, scores by a loop over classes and buckets."""
    m = model.train(["find the file", "clean my disk", "what is this"], ["ExactSearch", "CleanupAnalysis", "WebLookup"])

    def plain(q):
        words = "".join(c.lower()[:1] if c.isalnum() else " " for c in q).split()
        keys = set()
        for i, w in enumerate(words):
            keys |= {"w:" + w} | {"c3:" + w[k : k + 3] for k in range(len(w) - 2)} | ({f"b:{words[i - 1]}_{w}"} if i else set())
        at = {model.fnv1a(k.encode()) % model.BUCKETS for k in keys}
        score = [int(m.biases[c]) + sum(int(m.weights[c][b]) for b in at) for c in range(len(model.INTENTS))]
        best = score.index(max(score))
        margin = score[best] - max(s for c, s in enumerate(score) if c != best)
        return model.INTENTS[best], max(0, min(99, 50 + 3 * margin)), margin

    queries = ["find my disk", "clean", "", "what file is this é ß", "İstanbul dosya", "a b c d"]
    got = model.classified(spark.createDataFrame([(q,) for q in queries], "q string"), "q", m).collect()
    assert {r.q: (r.intent, r.confidence, r.margin) for r in got} == {q: plain(q) for q in queries}


def test_model_files(spark, tmp_path):
    m = model.train(["find the file", "clean my disk"], ["ExactSearch", "CleanupAnalysis"])
    data = m.to_bytes()
    (tmp_path / "m.stm").write_bytes(data)
    back = model.Model.load(spark, str(tmp_path / "m.stm"))
    assert (back.weights == m.weights).all() and (back.biases == m.biases).all()
    for bad in (b"bad", b"X" + data[1:], data[:8] + b"\2" + data[9:], data[:-1], data + b"x", data[:10] + b"\0\0" + data[12:], data[:10] + b"\x28\0" + data[12:], data[:12] + bytes(4) + data[16:]):
        with pytest.raises(ValueError):
            model.Model.from_bytes(bad)


def answer(spark, text, kind="custom"):
    row = spark.createDataFrame([(text,)], "a string").select(web.answers(F.col("a"), kind).alias("r")).first()
    return [tuple(x) for x in row.r]


def test_web_answers(spark):
    item = '{"title": "t%d", "link": "l", "snippet": "s\\u00e9"}'
    assert answer(spark, '{"items": [%s, %s]}' % (item % 1, item % 2)) == [("t1", "l", "sé"), ("t2", "l", "sé")]
    assert len(answer(spark, '{"items": [%s]}' % ", ".join(item % k for k in range(9)))) == 5
    assert answer(spark, '{"items": [%s, {"title": "x", "link": "y"}, %s]}' % (item % 1, item % 2)) == [("t1", "l", "sé")]
    assert answer(spark, '{"items": [{"link": "y", "snippet": "z"}]}') == [] == answer(spark, "no json") == answer(spark, None) == answer(spark, '{"other": 1}')
    assert answer(spark, '{"results": [{"title": "a", "url": "u"}, {"title": "b", "content": "c"}, {"title": "d", "url": "u"}]}', "meta") == [("a", "u", "")]


def test_web_cache_starts_anew_when_full(spark):
    schema = "key long, seq long, size_bytes long, results array<struct<title:string,link:string,snippet:string>>"
    old = spark.createDataFrame([(1, 1, 60, [("a", "l", "s")]), (2, 2, 60, [("b", "l", "s")])], schema)
    new = spark.createDataFrame([(1, 3, 5, [("c", "l", "s")])], schema)
    assert {r.key: r.results[0].title for r in web.latest(web.put(old, new, 1000)).collect()} == {1: "c", 2: "b"}
    assert {r.key: r.results[0].title for r in web.latest(web.put(old, new, 100)).collect()} == {1: "c"}


def test_lookup_text_and_paths(spark):
    row = spark.range(1).select(
        web.search_text(F.lit("C:\\Users\\me\\ tool.exe "), F.lit("Maker"), F.lit(""), F.lit("2")).alias("a"), web.search_text(F.lit("x/y")).alias("b"),
        names.absolute(F.lit("C"), F.lit("/a/b")).alias("c"), names.absolute(F.lit("C"), F.lit("d:\\x")).alias("d"), names.flags_of(F.lit(0x416)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f) == ("tool.exe Maker 2", "y", "C:\\a/b", "d:\\x", 15)


def test_quarantine_records(spark):
    tree = spark.createDataFrame([("C", 5, 5, 0, 1, "C:"), ("C", 6, 5, 0, 0, "temp1.tmp"), ("C", 7, 5, 0, 0, "keep.txt")], BASE).withColumn("name_norm", F.lower("name"))
    sizes = spark.createDataFrame([("C", 6, 9)], "volume string, file_id long, size_bytes long")
    entries = maintenance.quarantined(maintenance.quarantine_plan(maintenance.candidates(tree)), sizes)
    (e,) = entries.collect()
    assert (e.path, e.target, e.size_bytes) == ("C:\\temp1.tmp", "Q:\\quarantine\\C\\temp1.tmp", 9) and maintenance.listed(entries, 0).count() == 1
    assert [r.action for r in maintenance.restore_plan(entries, tree).collect()] == ["Refuse"]
    gone = tree.filter("file_id != 6")
    assert [(r.source, r.target, r.action) for r in maintenance.restore_plan(entries, gone).collect()] == [(e.target, e.path, "Restore")]
    assert [r.target for r in maintenance.purge_plan(entries).collect()] == [e.target]


def test_content_of_one_volume_in_order(spark):
    tree = spark.createDataFrame([("C", k, 5, 0, 0, f"n{9 - k}") for k in range(6, 9)], BASE).withColumn("name_norm", F.lower("name"))
    index = spark.createDataFrame([("C", 8, "rust"), ("C", 6, "rust"), ("D", 7, "rust"), ("C", 7, "other")], "volume string, file_id long, token string")
    index = search.posting_lists(index)
    assert [r.file_id for r in search.content_in_order(tree, index, "rust", "C").orderBy("rank").collect()] == [6, 8]


def test_ingestion_decisions(spark, tmp_path):
    steps = spark.createDataFrame([(0, 0), (0, 99_999), (5, 99_999), (5, 10), (3 << 20, 10)], "w long, i long").select(stream.next_step(F.col("w"), F.col("i")).alias("s"))
    assert [r.s for r in steps.collect()] == ["Ingest", "Ingest", "Compact", "Ingest", "Wait"]
    assert [stream.throttle_seconds(d, h) for d in ("Run", "Throttle", "Pause") for h in (False, True)] == [3, 5, 6, 10, 12, 20]
    marks = spark.createDataFrame([("A", 1, 50), ("B", 1, 5), ("C", 2, 50), ("E", 1, 200)], "volume string, journal_id int, next_usn int")
    now = spark.createDataFrame([(v, 1, 10, 100) for v in "ABCE"], "volume string, journal_id int, lowest_usn int, next_usn int")
    assert {r.volume: r.rebuild for r in stream.needs_rebuild(marks.union(spark.createDataFrame([("Z", 1, 1)], marks.schema)), now).collect()} == {"A": False, "B": True, "C": True, "E": True, "Z": True}


def test_service_state(spark, tmp_path):
    listener = stream.ServiceState()
    spark.streams.addListener(listener)
    events = spark.createDataFrame([(1, 1, "signup")], "event_id long, user_id long, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    stream.ingest(stream.journal_stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    for _ in range(100):
        if any(r[1] == "Stopped" for r in listener.rows):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    states = [r.state for r in listener.table(spark).collect()]
    assert states[0] == "Started" and states[-1] == "Stopped" and "Progress" in states


def test_several_volumes(spark):
    many = [("C", k, 5, 0, 0, f"node{k:03}") for k in range(30)] + [("D", 100, 5, 0, 0, "node")]
    tree = spark.createDataFrame(many, BASE).withColumn("name_norm", F.lower("name"))
    assert [r.volume for r in search.prefix_by_volume(tree, "node", 8, 2).orderBy("rank").collect()] == ["D"] + ["C"] * 7
    assert search.prefix_by_volume(tree, "", 8, 2).count() == 0
    assert [r.file_id for r in search.fuzzy_by_volume(tree, "nodee", 3, 2).orderBy("rank").collect()][0] == 100
    sizes = spark.createDataFrame([("D", 100, 9, 0)], "volume string, file_id long, size_bytes long, modified_unix_secs long")
    assert [r.file_id for r in search.filtered_by_volume(tree, sizes, "size:>5", 9, 2).collect()] == [100]
    assert np.array_equal(model.fnv1a_all([b"", b"w:node"]), np.array([model.OFFSET, model.fnv1a(b"w:node")], np.uint64))
