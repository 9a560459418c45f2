"""Every operator and stage on awkward rows: nulls in any column, null and shared ids, repeated rows, bytes that are no UTF-8,
columns with clashing names, hostile images, unstable templates."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, classifier, media, mixing, near, pieces, pii, rlz, rules, substring_sa
from shelfmark.llm.queries import piece_model

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.awkward(spark).repartition(3, "lang", "source").persist()


@pytest.fixture(scope="module")
def texts(docs):
    """(doc_id, text as bytes) of every row."""
    return [(r.doc_id, bytes(r.t or b"")) for r in docs.select("doc_id", F.col("text").cast("binary").alias("t")).collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bytes_by_row(docs, texts):
    """A null id is later than all others; rows with one id take nothing from each other."""
    last = 1 << 63
    first = {}
    for d, x in texts:
        for i in range(len(x) - 49):
            w = x[i : i + 50]
            first[w] = min(first.get(w, last), last if d is None else d)
    want = Counter()
    for d, x in texts:
        gone = {k for i in range(len(x) - 49) if first[x[i : i + 50]] < (last if d is None else d) for k in range(i, i + 50)}
        want[d, len(x), len(gone), sum(k - 1 not in gone for k in gone), sha(bytes(b for k, b in enumerate(x) if k not in gone))] += 1
    assert Counter(tuple(r) for r in substring_sa.deduplicated(docs).collect()) == want


def test_words_by_row(docs, texts):
    """A row that repeats another's id and text is a place of its own."""
    words = [(d, x.split()) for d, x in texts]
    count = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for d, w in words:
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[d, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert Counter(tuple(r) for r in rlz.deduplicated(docs).collect()) == want


def grouped(texts, size):
    """Groups of texts by brute force: a null id stays alone, a group's name is its least id, and its first row has it and
    the least hash among that id's texts (any of them, here)."""
    rows = sorted({(d, x) for d, x in texts if d is not None})
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := x.lower().split()) else set() for _, x in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {row: (len(sets[k]), rows[find(k)][0] if sets[k] else row[0], find(k) if sets[k] else -1 - k) for k, row in enumerate(rows)}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_by_row(docs, texts, size):
    want = grouped(texts, size)
    expected = Counter((d, len({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}) if (w := x.lower().split()) else 0, None, True) if d is None else (d, want[d, x][0], want[d, x][1], want[d, x][1] == d) for d, x in texts)
    assert Counter(tuple(r) for r in near.near_duplicates(docs, size).collect()) == expected


def test_one_row_of_each_group_stays(docs, texts):
    """The default, as in the pipeline, is five words a shingle."""
    want = grouped(texts, 5)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, bytes(r.t or b"")) for r in kept.withColumn("t", F.col("text").cast("binary")).select("doc_id", "t").collect())
    groups = {}
    for (d, x), (n, least, group) in want.items():
        if n and d == least:
            groups.setdefault(group, set()).add((d, x))
    assert all(sum(got[row] for row in members) == 1 for members in groups.values())
    assert sum(got.values()) == len(groups) + sum(d is None or not x.split() for d, x in texts)
    assert {r["_gone"] for r in kept.filter("doc_id = 9").collect()} == {"USER9"}


def test_rows_by_themselves(spark, docs, texts):
    """What depends on a row's text alone is the same for that text under any id."""
    distinct = sorted({x for _, x in texts})
    plain = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(distinct)], "doc_id long, text binary")
    model = classifier.fit(plain, spark.createDataFrame([(k, k % 2) for k in range(len(distinct))], "doc_id long, quality int"))
    operators = {
        "rules": lambda d: rules.quality(d).drop("rejected_by"),
        "classifier": lambda d: classifier.scored(d, model).drop("held_out"),
        "pieces": lambda d: pieces.encoded(d, piece_model()),
        "media": lambda d: media.digests(media.text_media(d)),
        "pii": lambda d: pii.found(d),
    }
    for name, operator in operators.items():
        by_text = {distinct[r[0]]: tuple(r)[1:] for r in operator(plain).collect()}
        assert Counter(tuple(r) for r in operator(docs).collect()) == Counter((d, *by_text[x]) for d, x in texts), name


def test_mixing_keeps_user_columns(docs, texts):
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    rows = got.withColumn("t", F.col("text").cast("binary")).collect()
    assert {(r.doc_id, bytes(r.t or b"")) for r in rows} <= set(texts) and len(rows) > 5
    assert all(r[c] == (None if r.doc_id is None else f"USER{r.doc_id}") for r in rows for c in ("_key", "_own", "_copies", "_pass", "_source", "_plan", "key", "plan", "number"))


def test_stages(spark, docs, texts, tmp_path):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        path = str(tmp_path / f"{k}.parquet")
        out.write.parquet(path)
        assert spark.read.parquet(path).columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(texts)


def test_redaction_leaves_other_bytes_alone(spark):
    text = b"\xff mail me.now@x.example.org \x80 or 10.0.0.1 \xc3"
    docs = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b"\xff\xfe none"))], "doc_id long, text binary").withColumn("text", F.expr("cast(text as string)"))
    got = {r.doc_id: bytes(r.t) for r in pii.redacted(docs).select("doc_id", F.col("text").cast("binary").alias("t")).collect()}
    assert got == {1: b"\xff mail <email> \x80 or <ip> \xc3", 2: b"\xff\xfe none"}


BMP = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")


def bmp(width, height, bits, packed, rest):
    return BMP + width.to_bytes(4, "little", signed=True) + height.to_bytes(4, "little", signed=True) + b"\1\0" + bits.to_bytes(2, "little") + packed.to_bytes(4, "little") + bytes(20) + rest


@pytest.mark.parametrize(
    "data",
    [
        b"P5 99999999999999999999 1\n255\nx", b"P5 999999999 999999999 255\nx", b"P2 1 1 255 " + b"9" * 40, b"P2 1 1 255 300", b"P2 2 1 255 1", b"P1 2 1 1 7", b"P6 0 5 255 ", b"P5", b"P7 1 1 1", b"",
        b"P4 99999999 99999999\nx", bmp(2, 1, 24, 0, b""), bmp(-2, 1, 24, 0, bytes(99)), bmp(1 << 30, -(1 << 31), 32, 0, bytes(9)), bmp(1, 1, 32, 3, (0xF800).to_bytes(4, "little") + bytes(99)), bmp(1, 1, 8, 0, b"\xff"), b"BM",
    ],
)
def test_hostile_images_raise_what_the_operator_catches(data):
    with pytest.raises((ValueError, IndexError)):
        media.decode(data)


def test_channel_masks_and_the_job_on_hostile_images(spark):
    masks = b"".join((0xFF << s).to_bytes(4, "little") for s in (0, 8, 16))
    image = bmp(1, 1, 32, 3, masks + b"\1\2\3\4")
    image = image[:10] + (66).to_bytes(4, "little") + image[14:]
    assert media.decode(image)[0, 0].tolist() == [1, 2, 3]
    rows = spark.createDataFrame([(1, bytearray(image)), (2, bytearray(b"P5 99999999999999999999 1")), (3, None)], "id long, image binary")
    assert {r.id: r.width for r in media.media(rows, "id", "image").collect()} == {1: 1, 2: None, 3: None}


def test_feature_by_brute_force(spark):
    """The difference hash of a text's greymap: means over an 8 x 9 grid of areas cut at fractions of a sample."""
    for text in (b"", b"some text of a few words", bytes(range(256)) * 9 + b"tail"):
        size = max(-(-len(text) // 64), 1)
        grid = [[float(b) for b in text.ljust(size * 64, b"\0")[64 * k : 64 * k + 64]] for k in range(size)]

        def mean(a, z, row):
            """Of columns a to z, fractions counted, over the rows of cell ``row``."""
            total = 0.0
            for y in range(size):
                height = max(0.0, min(y + 1, (row + 1) * size / 8) - max(y, row * size / 8))
                for x in range(64):
                    width = max(0.0, min(x + 1, z) - max(x, a))
                    total += height * width * grid[y][x]
            return round(total / (size / 8 * (z - a)) * 256)

        bits = "".join(str(int(mean(k * 64 / 9, (k + 1) * 64 / 9, row) < mean((k + 1) * 64 / 9, (k + 2) * 64 / 9, row))) for row in range(8) for k in range(8))
        got = media.digests(media.text_media(spark.createDataFrame([(1, bytearray(text))], "doc_id long, text binary"))).first()
        assert got.feature == f"{int(bits, 2):016x}"


def test_templates_that_rewrite_history(spark):
    """At any length, whatever they declare."""
    turns = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(200)]
    late = lambda ts: ("!" if 130 <= len(ts) < 198 else "") + chat.marked(ts)
    assert chat.spans(turns, late) == (late(turns), None)
    wrong = lambda ts: f"{len(ts)}:" + chat.marked(ts)
    wrong.local = 2
    assert chat.spans(turns, wrong)[1] is None
    near = lambda ts: "".join(f"[{'same' if k and ts[k - 1][0] == r else r}]{t}" for k, (r, t) in enumerate(ts))
    plain = chat.spans(turns, near)
    near.local = 1
    assert chat.spans(turns, near) == plain and plain[1] is not None
    rows = spark.createDataFrame([(c, k, r, t) for c in (1, None) for k, (r, t) in enumerate(turns[:4])] + [(1, None, None, None), (1, 2, "user", "t2")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(rows).collect()}
    assert len(got[1].spans) == 6 and len(got[None].spans) == 4


def test_rendering_without_spans(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(rows, lambda ts: f"{len(ts)} turns" + "".join(t for _, t in ts))
    row = out.first()
    assert row.spans is None and not row.stable
    assert tuple(chat.digests(out).first()) == (1, None, None, None, None, len("2 turnsab"))
