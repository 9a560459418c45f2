"""Files: a folder's tree, text from documents' bytes, and made-up volumes."""

from __future__ import annotations

import email
import email.message
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small_batches

#: Parts of office packages that hold text.
PARTS = {"docx": r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml"}
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, modified_unix_secs) of every file below a folder on any file system that Spark reads; files are dealt
    to tasks by their sizes, and their contents are left alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_unix_secs"))


def visible(markup: str) -> str:
    """Text outside tags, trimmed pieces joined by blanks."""
    pieces = (p.strip() for p in re.split(r"<[^>]*(?:>|$)", markup))
    out = []
    for p in filter(None, pieces):
        for entity, char in ENTITIES:
            p = p.replace(entity, char)
        out.append(p)
    return " ".join(out)


#: Destinations of a rich text that hold no text of the reader's, and control words that stand for a character.
_RTF_HIDDEN = re.compile(rb"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}")
_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?[0-9]+) ?\??|\\(par|line|tab|cell|row)\b ?|\\[a-zA-Z]+-?[0-9]* ?|\\(.)|([{}\r\n])", re.DOTALL)


def rich_text(data: bytes) -> str:
    """A rich text file's text: characters by code page or number, breaks as blanks, control words left out."""

    def plain(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 16)]).decode("cp1252", "replace").encode()
        if m[2]:
            return chr(int(m[2]) % 65536).encode("utf-8", "surrogatepass")
        return b" " if m[3] else m[4] if m[4] in (b"\\", b"{", b"}") else b""

    raw = _RTF.sub(plain, _RTF_HIDDEN.sub(b"", data))
    try:
        found = raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a pair meet
    except UnicodeDecodeError:
        found = raw.decode("utf-8", "replace")
    return " ".join(found.split())


def message_text(data: bytes) -> str:
    """The text parts of a mail or web archive, those in HTML without their tags."""
    parts = []
    for part in email.message_from_bytes(data, policy=email.policy.default).walk():
        if part.get_content_maintype() == "text":
            body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            parts.append(visible(body) if part.get_content_subtype() in ("html", "xml") else body.strip())
    return " ".join(filter(None, parts))


def text_of(name: str, data: bytes) -> str | None:
    """A document's text by its extension; None where it has none that is read here, or is damaged."""
    kind = name.rpartition(".")[2].lower()
    if kind in ("html", "htm", "xml"):
        return visible(data.decode("utf-8", "replace"))
    if kind == "rtf" and data.startswith(b"{\\rtf"):
        return rich_text(data)
    if kind in ("eml", "mht", "mhtml"):
        try:
            return message_text(data)
        except (LookupError, ValueError):  # an unknown character set, a header that can't be read
            return None
    if kind not in PARTS:
        return None if b"\0" in data[:4096] else data.decode("utf-8", "replace")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = [i for i in z.infolist() if re.fullmatch(PARTS[kind], i.filename)]
            return " ".join(filter(None, (visible(z.read(i).decode("utf-8", "replace")) for i in inside)))
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
        return None


def extracted(files: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """(key, text) of binary documents, extracted in Python workers apart from the JVM, a few megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if data is None else text_of(n.as_py() or "", data) for n, data in zip(b.column(1), (d.as_py() for d in b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [key, "text"])

    small_batches(files)
    rows = files.select(key, name, content)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def _cut(markup: str, parts: int) -> list[str]:
    """A markup in pieces that end before a tag, so that each has its own text."""
    cuts = [0]
    for k in range(1, parts):
        at = markup.find("<", max(len(markup) * k // parts, cuts[-1]))
        cuts.append(len(markup) if at < 0 else at)
    return [markup[x:y] for x, y in zip(cuts, [*cuts[1:], len(markup)], strict=True)]


def _package(names: list[str], markup: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml", "<Types>not text</Types>")
        for name, part in zip(names, _cut(markup, len(names)), strict=True):
            z.writestr(name, part)
    return out.getvalue()


def _rich(markup: str) -> bytes:
    """Rich text with fonts and colours that are no text, and every character beyond ASCII by its number or code page."""

    def escaped(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if c in "\n\r":
            return "\\par "
        if c.isascii():
            return c
        code = c.encode("cp1252", "ignore")
        return f"\\'{code[0]:02x}" if code and code.decode("cp1252") == c else "".join(f"\\u{u - (u >> 15 << 16)}?" for u in memoryview(c.encode("utf-16-le")).cast("H"))

    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Font;}}{\\colortbl;\\red0\\green0\\blue0;}\\f0\\fs24 " + "".join(map(escaped, visible(markup))) + "\\par}").encode("ascii")


def _message(markup: str) -> bytes:
    """A mail of two parts in HTML, one in base64 and one as quoted printable text."""
    mail = email.message.EmailMessage()
    mail["Subject"], mail["From"] = "not text", "a@example.com"
    first, second = _cut(markup, 2)
    mail.set_content(first, subtype="html", cte="base64")
    mail.make_mixed()
    mail.add_attachment(second, subtype="html", cte="quoted-printable")
    return mail.as_bytes()


#: What a text is packed into, by a number: an ending and how its bytes are made.
PACKERS = [
    ("docx", lambda m: _package(["word/header1.xml", "word/document.xml", "word/footnotes.xml"], m)),
    ("pptx", lambda m: _package(["ppt/slides/slide1.xml", "ppt/slides/slide2.xml", "ppt/notesSlides/notesSlide1.xml"], m)),
    ("xlsx", lambda m: _package(["xl/sharedStrings.xml", "xl/worksheets/sheet1.xml"], m)),
    ("html", lambda m: m.encode()),
    ("rtf", _rich),
    ("eml", _message),
]


def packaged(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, content): marked-up texts as documents of all kinds, by their key: word-processor, slide and table packages of
    several parts, web pages, rich text and mail. For tests and as a sink of extracted corpora."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [PACKERS[(k or 0) % len(PACKERS)] for k in b.column(0).to_pylist()]
            packed = [make(data or "") for (_, make), data in zip(kinds, b.column(1).to_pylist(), strict=True)]
            names = [f"page-{k}.{ending}" for k, (ending, _) in zip(b.column(0).to_pylist(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(packed, pa.binary())], [key, "name", "content"])

    small_batches(texts)
    rows = texts.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, name string, content binary")


def synthetic(spark: SparkSession, rows: int, seed: int = 1) -> DataFrame:
    """A made-up volume for load tests: one directory in sixteen, of which number k lies in number k // 8, so that depths grow
    with the logarithm of the rows; files in a directory by a hash; sizes of a log-normal distribution; names of one to four
    syllables, a number and one of a few endings."""
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    syllables = F.array(*map(F.lit, "ba ce di fo gu ka le mi no pu ra se ti vo xu za".split()))
    word = F.array_join(F.transform(F.sequence(F.lit(0), pick("length", 4)), lambda k: F.element_at(syllables, (F.pmod(F.xxhash64(F.lit(seed), k, "id"), F.lit(16)) + 1).cast("int"))), "")
    folders = max(rows // 16, 1)
    is_folder = F.col("id") < folders
    ending = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".py", ".dat", ".log"])), (pick("ending", 5) + 1).cast("int"))
    size = F.floor(F.exp(8 + 2 * F.randn(seed))).cast("long")
    return spark.range(rows).select(
        F.lit("S").alias("volume"), F.col("id").alias("file_id"), F.when(is_folder, F.floor(F.col("id") / 8)).otherwise(pick("folder", folders)).cast("long").alias("parent_id"),
        F.when(is_folder, F.lit(0)).otherwise(size).cast("long").alias("size_bytes"), is_folder.cast("int").alias("flags"),
        F.concat(word, F.lit("-"), F.col("id").cast("string"), F.when(is_folder, F.lit("")).otherwise(ending)).alias("name"),
    )
