"""Small catalogs with known answers."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import intent, names, safety
from shelfmark.operators import duplicates, live, maintenance, model, search
from shelfmark.plans.query import date_bounds, day_of, parse, size_bounds, size_of
from shelfmark.sources.catalog import changes_of, journal, named
from shelfmark.streaming import journal as stream

BASE = "volume string, file_id long, parent_id long, size_bytes long, flags int, name string"
CHANGE = "volume string, seq long, op string, file_id long, parent_id long, size_bytes long, flags int, name string"
ATTRIBUTES = "volume string, file_id long, size_bytes long, modified_unix_secs long"


def base(spark, rows):
    return named(spark.createDataFrame(rows, BASE))


def programs(spark):
    return base(spark, [("C", 5, 5, 0, 1, "C:"), ("C", 10, 5, 0, 1, "Program Files"), ("C", 20, 10, 1234, 0, "node.exe"), ("C", 21, 10, 456, 0, "notepad.exe")])


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_exact_prefix_and_path(spark):
    rows = programs(spark)
    hits = live.with_paths(rows.join(search.exact(rows, "NODE.EXE").select("file_id"), "file_id"), rows)
    assert [r.path for r in hits.collect()] == ["C:\\Program Files\\node.exe"]
    assert [r.name for r in search.prefix(rows, "note").collect()] == ["notepad.exe"]
    assert search.prefix(rows, "").count() == 0


def test_prefix_counts_all(spark):
    rows = base(spark, [("C", 10 + i, 5, 0, 0, f"file-{i:05d}.txt") for i in reversed(range(5000))])
    assert search.prefix(rows, "file-012", 1000).count() == 100


def test_changes_override(spark):
    rows = base(spark, [("C", 5, 5, 0, 1, "C:"), ("C", 10, 5, 0, 1, "work"), ("C", 20, 10, 0, 0, "old.txt"), ("C", 21, 10, 0, 0, "gone.txt")])
    changes = spark.createDataFrame([("C", 1, "Upsert", 20, 10, 0, 0, "mid.txt"), ("C", 2, "Upsert", 20, 10, 0, 0, "new.txt"), ("C", 3, "Delete", 21, 0, 0, 0, "")], CHANGE)
    now = live.live_view(rows, changes)
    assert {r.name for r in now.collect()} == {"C:", "work", "new.txt"}
    assert live.with_paths(live.by_id(now, "C", 20), now).first().path == "C:\\work\\new.txt"
    assert {(r.file_id, r.op) for r in live.latest_changes(changes).collect()} == {(20, "Upsert"), (21, "Delete")}
    assert maintenance.verify(rows, changes).first().asDict() == {"volume": "C", "records": 4, "delta_entries": 3, "delta_unique": 2}


def test_path_starts_below_a_deleted_parent_and_cycles_end(spark):
    rows = base(spark, [("C", 1, 9, 0, 1, "a"), ("C", 2, 1, 0, 0, "b"), ("C", 3, 4, 0, 1, "x"), ("C", 4, 3, 0, 1, "y"), ("C", 6, 1, 0, 1, ""), ("C", 7, 6, 0, 0, "deep")])
    paths = {r.file_id: r.path for r in live.with_paths(rows, rows).collect()}
    assert paths[2] == "C:\\a\\b" and paths[7] == "C:\\a\\deep"
    assert paths[3].count("x") <= 2 and len(paths[4]) < 20


def test_filters(spark):
    rows = base(spark, [("C", 10, 5, 0, 0, "node.exe"), ("C", 11, 5, 0, 0, "node.txt"), ("D", 10, 5, 0, 0, "node.exe")])
    attributes = spark.createDataFrame([("C", 10, 2 << 20, 0), ("C", 11, 512, 0), ("D", 10, 512, 0)], ATTRIBUTES)
    assert [(r.volume, r.name) for r in search.filtered(rows, attributes, "node ext:exe size:>1mb").collect()] == [("C", "node.exe")]


def test_fuzzy_and_related(spark):
    rows = base(spark, [("C", i, 5, 0, 0, n) for i, n in enumerate(["notepad.exe", "node.exe", "npm", "package.json", "node_modules"], 10)])
    assert search.fuzzy(rows, "notpad").first().name == "notepad.exe"
    assert {"package.json", "npm"} <= {r.name for r in search.related(rows, "node js").collect()}
    assert {"package.json", "npm"} <= {r.name for r in search.related(rows, "node.js").collect()}


def test_content(spark):
    files = spark.createDataFrame([("C", 1, "rust search engine fast index"), ("C", 2, "python search engine"), ("C", 3, "rust compiler")], "volume string, file_id long, text string")
    rows = base(spark, [("C", i, 5, 0, 0, f"n{i}") for i in (1, 2, 3)])
    assert [r.file_id for r in search.content(rows, search.posting_lists(search.postings(files)), "rust search").collect()] == [1]
    assert search.content(rows, search.posting_lists(search.postings(files)), "!").count() == 0


def test_tokens(spark):
    assert value(spark, names.tokens(F.lit("Ab-c_1 x é " + "z" * 100 + " " + "w" * 97))) == ["ab-c_1", "é", "zzz"]


def test_names(spark):
    assert value(spark, names.normalized(F.lit("ΟΔΟΣ"))) == "οδοσ"
    assert value(spark, names.stem(F.lit(".gitignore"))) == "" and value(spark, names.stem(F.lit("a.b.c"))) == "a.b"
    lev = lambda a, b: value(spark, names.byte_distance(F.lit(a), F.lit(b), 2))
    assert (lev("node", "nod"), lev("node", "xode"), lev("node", "python"), lev("é", "e")) == (1, 1, None, 2)
    assert value(spark, names.fuzzy_distance("notpad", F.lit("notepad.exe"), 2)) == 1
    assert value(spark, names.visible_text(F.lit("<p> a &amp;lt; </p><b>b</b> <i"))) == "a &lt; b"
    assert value(spark, names.within_scope(F.lit("C:\\Work\\a"), "c:/work")) and not value(spark, names.within_scope(F.lit("C:\\Workshop\\a"), "C:\\Work"))
    assert value(spark, names.lookup_name(F.lit("C:\\a/b\\ x.dll "))) == "x.dll"
    assert [value(spark, names.relevance("node", F.lit(n), F.lit(f))) for n, f in (("node", 0), ("node.exe", 0), ("nodes", 1), ("anode", 0), ("x", 0))] == [10000, 8996, 7119, 3999, 0]


def test_query_grammar():
    q = parse('node project ext:rs size:>10mb path:"C:\\Work Space" date:2026-01-01..2026-02-01 type:file app:rust')
    assert (q.text, q.ext, q.size.low, q.path, q.kind, q.app) == ("node project", "rs", 10_000_001, "c:\\work space", "file", "rust")
    assert (q.date.low, q.date.high) == (day_of("2026-01-01"), day_of("2026-02-01") + 86_399)
    assert parse("C:\\x ext:a ext:.B size:>1 size:<9").text == "C:\\x"
    assert parse("size:bad type:x").rejected == ["size:bad", "type:x"]
    assert parse('"ext:rs" a').ext == "rs"


@pytest.mark.parametrize(("text", "want"), [("1MB", 10**6), ("1MiB", 2**20), ("1.5kb", 1500), ("1 parsec", None), ("", None)])
def test_sizes(text, want):
    assert size_of(text) == want


def test_bounds():
    assert size_bounds("1kb..x") == (1000, None) and size_bounds("<0") == (None, 0) and size_bounds("..") == (None, None)
    assert day_of("1970-01-01") == 0 and day_of("2026-02-29") is None and day_of("2024-2-29") is not None
    assert date_bounds(">1970-01-01") == (86_400, None) and date_bounds("<1970-01-02") == (None, 86_399)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("report_final.pdf dosyasını bul", "ExactSearch"), ("kodunda TODO geçen dosyalar", "ContentSearch"), ("what is strangecodec.dll search web", "WebLookup"),
        ("yanlış yazmış olabilirim nod_modules bul", "FuzzySearch"), ("gereksiz npm cache dosyalarını bul", "CleanupAnalysis"), ("helper", "Help"), ("red car", None),
    ],
)
def test_intents(spark, query, want):
    assert value(spark, intent.rule_intent(F.lit(query))) == want


def test_subjects(spark):
    assert value(spark, intent.subject(F.lit("adı node.exe olan dosyayı bul"))) == "node.exe"
    assert value(spark, intent.content_terms(F.lit("içinde websocket error geçen dosyaları bul"))) == "websocket error"
    assert value(spark, intent.subject(F.lit("node js ile alakalı her şeyi bul"))) == "node.js"
    assert value(spark, intent.subject(F.lit("abc xyz"))) == "xyz"


@pytest.mark.parametrize(
    ("path", "kind", "action"),
    [
        ("C:\\Windows\\System32\\kernel32.dll", "System", "Deny"), ("C:\\Users\\a\\npm-cache\\x", "Cache", "Quarantine"), ("C:\\w\\.git\\objects\\x", "Project", "Deny"),
        ("C:\\a\\target\\b", "BuildArtifact", "RecommendOnly"), ("C:\\a\\b.tmp", "Temporary", "Quarantine"), ("C:\\a\\b.log", "Log", "RecommendOnly"), ("C:\\a\\b", "Unknown", "Keep"),
    ],
)
def test_safety(spark, path, kind, action):
    row = maintenance.decisions(spark.createDataFrame([("C", 1, path, 0)], "volume string, file_id long, path string, flags int")).first()
    assert (row["class"], row.action) == (kind, action)


def test_governor(spark):
    ask = lambda *a: value(spark, safety.governor(*map(F.lit, a)))
    assert ask("ForegroundQuery", 99, 99, 0, True) == "Run" and ask("MetadataUpdate", 40, 10, 0, False) == "Throttle"
    assert ask("BackgroundIndex", 10, 10, 0, False) == "Pause" and ask("BackgroundIndex", 10, 10, 9999, False) == "Run" and ask("MetadataUpdate", 60, 0, 9999, False) == "Pause"
    assert value(spark, safety.permitted(*map(F.lit, ("Expensive", "Hdd", 0, 0, 4000, False)))) == "Pause"


def test_size_groups(spark):
    rows = spark.createDataFrame([("C", 1, 9, 0), ("C", 2, 5, 0), ("C", 3, 9, 0), ("C", 4, 7, 0)], ATTRIBUTES)
    assert [(r.size_bytes, r.files) for r in duplicates.same_size(rows, 1).collect()] == [(9, 2)]
    many = spark.createDataFrame([("C", i, 100, 0) for i in range(6)], ATTRIBUTES)
    assert duplicates.group_stats(many, 1, 4).first().asDict() == {"groups": 0, "members": 0, "oversized_groups_skipped": 1}


def test_duplicate_contents(spark):
    rows = spark.createDataFrame([("C", 1, 10, "same bytes"), ("C", 2, 10, "same bytes"), ("C", 3, 10, "other byte")], "volume string, file_id long, size_bytes long, text string")
    assert [(r.files, r.first_file, r.reclaimable) for r in duplicates.duplicate_sets(rows, 1).collect()] == [(2, "C:1", 10)]


def test_health(spark):
    rows = base(spark, [("C", 5, 5, 0, 1, "C:"), ("C", 6, 77, 0, 0, "x"), ("C", 6, 5, 0, 0, "y")])
    assert maintenance.deep_verify(rows).first().asDict() == {"volume": "C", "names_checked": 3, "ids_checked": 2, "ids_repeated": 1, "parent_links_missing": 1}
    marks = spark.createDataFrame([("C", "content", None, None), ("D", "content", 1, 2)], "volume string, kind string, journal_id long, next_usn long")
    now = spark.createDataFrame([("C", None, None), ("D", 1, 3)], "volume string, journal_id long, next_usn long")
    assert {(r.volume, r.fresh) for r in maintenance.freshness(marks, now).collect()} == {("C", True), ("D", False)}


def test_model():
    assert model.fnv1a(b"w:node") == 0x4383BEE8B3B277A0
    m = model.train(["find the file", "clean my disk"], ["ExactSearch", "CleanupAnalysis"])
    assert m.classify("clean my disk please")[0] == "CleanupAnalysis" and m.classify("find the file now")[0] == "ExactSearch"


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, ["signup", "error", "purchase", "click", "view"][i % 5]) for i in range(40)], "event_id long, user_id long, event_type string")
    for k in range(4):
        events.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = stream.journal_stream(spark, str(tmp_path / "in"), events.schema, 1)
        stream.ingest(rows, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    want = live.latest_changes(changes_of(journal(events)))
    assert {tuple(r) for r in stream.state(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in want.collect()}
