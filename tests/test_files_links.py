import io
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import uri
from shelfmark.sources import files


@pytest.mark.parametrize(
    ("link", "query", "scope"),
    [
        ("search:query=red%20car&crumb=location:C%3A%5CWork%5C", "red car", "C:\\Work"), ("SearchTool:?q=a+b&scope=%22d:/x/%22", "a b", "d:\\x"), ("search:plain+words", "plain words", None),
        ("http://x?query=a", None, None), ("search:query=50%&query=", "50%", None), ("search:location=C:/", None, "C:\\"),
    ],
)
def test_links(spark, link, query, scope):
    row = spark.range(1).select(uri.parsed(F.lit(link)).alias("u")).first().u
    assert (row.query, row.scope) == (query, scope)


def test_extraction(spark):
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello &amp;amp; <b>there</b></w:p>")
        z.writestr("word/media/x.bin", "no")
    rows = [(1, "a.docx", office.getvalue()), (2, "b.html", b"<p> x </p>y"), (3, "c.docx", b"broken"), (4, "d.txt", b"plain \xff"), (5, "e.exe", b"\0\1"), (6, "f.txt", None)]
    got = {r.id: r.text for r in files.extracted(spark.createDataFrame(rows, "id long, name string, content binary"), "id", "name", "content").collect()}
    assert got == {1: "Hello &amp; there", 2: "x y", 3: None, 4: "plain \ufffd", 5: None, 6: None}


def test_directory_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f.txt").write_text("12345")
    (tmp_path / "g").write_text("1")
    got = {r.path.removeprefix(f"file:{tmp_path}"): r.size_bytes for r in files.tree(spark, str(tmp_path)).collect()}
    assert got == {"/a/b/f.txt": 5, "/g": 1}


def test_synthetic_rows(spark):
    rows = {r.file_id: r for r in files.synthetic(spark, 3200).collect()}
    folders = {k for k, r in rows.items() if r.flags}
    assert len(folders) == 200 and all(r.parent_id in folders for r in rows.values()) and len({r.name for r in rows.values()}) == 3200
    assert sum(r.size_bytes > 0 for r in rows.values()) > 2900 and all(r.parent_id <= k for k, r in rows.items() if r.flags)


def test_packages_are_read_back(spark):
    rows = spark.createDataFrame([(1, "<p>a &amp; b</p>"), (2, None)], "page_id long, html string")
    got = files.extracted(files.packaged(rows, "page_id", "html"), "page_id", "name", "content").collect()
    assert {r.page_id: r.text for r in got} == {1: "a & b", 2: ""}


def test_rich_texts_and_messages():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0\fs20 caf\'e9 \u8364? \{ok\}\par next\tab line}"
    assert files.text_of("a.rtf", rtf) == "café € {ok} next line"
    mail = b"Subject: s\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>a &lt; b</p>\r\n--b\r\nContent-Type: image/png\r\n\r\nxx\r\n--b--\r\n"
    assert files.text_of("a.eml", mail) == "café a < b" == files.text_of("a.mht", mail)
    assert files.text_of("a.eml", b"Content-Type: text/plain; charset=nowhere\r\n\r\nx") is None


def test_documents_of_all_kinds(spark):
    """Several parts, encodings and characters beyond 16 bits come back from the bytes; damaged rich text is no error."""
    markup = "<p>één {brace} \\\\ back</p><p>two &amp; 中文 😀</p><table><td>three</td></table><p>fo  ur</p>"
    rows = spark.createDataFrame([(k, markup) for k in range(6)] + [(6, ""), (7, None), (10, "no tags")], "page_id long, html string")
    packed = files.packaged(rows, "page_id", "html")
    assert {r.name.split(".")[1] for r in packed.collect()} == {ending for ending, _ in files.PACKERS}
    got = {r.page_id: r.text for r in files.extracted(packed, "page_id", "name", "content").collect()}
    want = files.visible(markup)
    assert got == {k: " ".join(want.split()) if k == 4 else want for k in range(6)} | {6: "", 7: "", 10: "no tags"}
    assert files.rich_text(b"{\\rtf1 \\u-10179? a\xff\xfe b}").endswith("b")


def test_documents_come_in_small_batches(spark):
    """Neither way holds thousands of whole documents at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.range(64, numPartitions=1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 1 << 20), F.lit("</p>")).alias("html"))
    for made in (lambda: files.packaged(pages, "page_id", "html"), lambda: files.extracted(pages.withColumn("name", F.lit("a.html")), "page_id", "name", "html")):
        spark.conf.unset(key)
        made()
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
    assert files.extracted(files.packaged(pages, "page_id", "html"), "page_id", "name", "content").filter(F.length("text") == 1 << 20).count() == 64
