"""The whole job: nothing is dropped by a cap."""

import io
import zipfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.functions import names
from shelfmark.operators import duplicates, maintenance, model, search
from shelfmark.catalog_queries import web_results
from shelfmark.sources import files as documents
from shelfmark.sources.catalog import named


def test_duplicate_groups_of_any_size(spark):
    many = 4_097
    rows = spark.range(many + 1).select(F.lit("C").alias("volume"), F.col("id").alias("file_id"), F.lit(4).cast("long").alias("size_bytes"), F.when(F.col("id") < many, "same").otherwise("else").alias("text"))
    assert [(r.size_bytes, r.files) for r in duplicates.same_size(rows, 1).collect()] == [(4, many + 1)]
    assert [(r.files, r.first_file, r.reclaimable) for r in duplicates.duplicate_sets(rows, 1).collect()] == [(many, "C:0", 4 * (many - 1))]
    assert duplicates.report(duplicates.duplicate_sets(rows, 1)).first().asDict() == {"sets": 1, "files": many, "reclaimable": 4 * (many - 1)}
    assert duplicates.group_stats(rows, 1).first().asDict() == {"groups": 1, "members": many + 1, "oversized_groups_skipped": 0}
    assert duplicates.same_size(rows, 1, 4_096).count() == 0 and duplicates.duplicate_sets(rows, 1, 4_096).count() == 0


def runs(text):
    """Tokens letter by letter, as the reference reads them."""
    out, now = [], ""
    for c in text + " ":
        if c.isalnum() or c in "_-":
            now = "" if len((now + c).encode()) > 96 else now + c
        else:
            out, now = out + [now] * (len(now.encode()) >= 2), ""
    return out


def test_long_runs_keep_their_tail(spark):
    text = " ".join(["é" * 49 + "ab", "é" * 48, "é" * 49, "xé" * 70, "語" * 33 + "本文", "日本" * 5_000 + "a", "a" + "語" * 40, "𝒳" * 60, "z" * 200])
    got = spark.createDataFrame([(text,)], "text string").select(names.tokens(F.col("text")).alias("t")).first().t
    assert got == runs(text) and {"ab", "本文", "z" * 6} <= set(got)


def test_every_token_of_a_long_file(spark, tmp_path):
    words = 9_000
    text = " ".join(f"w{i}" for i in range(words)) + " last"
    files = spark.createDataFrame([("C", 1, text)], "volume string, file_id long, text string")
    live = named(spark.createDataFrame([("C", 1, 5, 0, 0, "n1")], "volume string, file_id long, parent_id long, size_bytes long, flags int, name string"))
    assert search.postings(files).count() == words + 1
    assert [r.file_id for r in search.content(live, search.posting_lists(search.postings(files)), "last w1").collect()] == [1]
    spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert entry.queries()["s13_postings"](spark, str(tmp_path)).count() == words + 1
    assert [r.tokens for r in entry.queries()["s14_rich_token_counts"](spark, str(tmp_path)).collect()] == [words + 1]


def test_plans_beyond_the_report(spark, tmp_path):
    names = ["C:"] + [f"temp{i:04d}" for i in range(130)] + [f"temp-{i:04d}.tmp" for i in range(10)] + [f"cache{i:04d}.tmp" for i in range(600)]
    rows = [("C", 5 + i, 5, 0, int(i == 0), n) for i, n in enumerate(names)]
    live = named(spark.createDataFrame(rows, "volume string, file_id long, parent_id long, size_bytes long, flags int, name string"))
    plan = maintenance.quarantine_plan(maintenance.candidates(live)).collect()
    assert len({r.file_id for r in plan}) == len(plan) == 610 and "Q:\\quarantine\\C\\cache0599.tmp" in {r.target for r in plan}
    report = [r.path for r in maintenance.cleanup(live).collect()]
    assert report[:11] == [f"C:\\temp-{i:04d}.tmp" for i in range(10)] + ["C:\\cache0000.tmp"] and len(report) == 138
    assert len(maintenance.cleanup(live, 1_000).collect()) == 500
    spark.createDataFrame([(200 * i + 7, "red blue", "Brand#11") for i in range(700)], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "a", "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, "view")], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()["m11_quarantine_plan"](spark, str(tmp_path)).count() == 700


def test_intent_reads_the_whole_text():
    filler = " ".join(f"word{i}" for i in range(60))
    assert len(model.buckets(filler)) > 96 and set(model.buckets("clean my disk")) <= set(model.buckets(filler + " clean my disk"))
    m = model.train(["find the file", "clean my disk"], ["ExactSearch", "CleanupAnalysis"])
    assert [m.classify(f"{filler} {q}")[0] for q in ("clean my disk", "find the file")] == ["CleanupAnalysis", "ExactSearch"]


def test_visible_text_of_long_pages(spark, tmp_path):
    body = "words " * 800_000 + "end"
    html = f"<p>{body}</p><b>last &amp; least</b>"
    spark.createDataFrame([(1, "http://a.example/" + "x" * 30, html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = body + " last & least"
    for name in ("f25_visible_text", "x2_extracted_text"):
        assert entry.queries()[name](spark, str(tmp_path)).first()[1] == want
    row = web_results(spark.read.parquet(str(tmp_path / "pages.parquet"))).first()
    assert row.snippet == html and row.title == row.link
    assert documents.text_of("a.txt", body.encode()) == body
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<p>{'a' * (17 << 20)}</p>")
    assert len(documents.text_of("a.docx", office.getvalue())) == 17 << 20
