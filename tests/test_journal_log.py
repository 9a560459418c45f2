"""Raw journal logs: whole, torn and damaged records, places that are gone, and keyed state across restarts."""

import os

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from shelfmark.operators import live
from shelfmark.sources import catalog as src
from shelfmark.sources import journal_log
from shelfmark.streaming import journal as stream

RECORDS = "seq long, file_id long, reason int, name string, millis long"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORDS)


def some(spark, low, high, files=5):
    """Creations, and a deletion at every seventh position."""
    return records(spark, *((i, i % files, src.DELETE if i % 7 == 3 else src.CREATE, f"é\t\n{i}", i * 1000) for i in range(low, high)))


def read(spark, path):
    journal_log.register(spark)
    return spark.read.format("journal").option("path", path).load()


def seqs(df):
    return sorted(r.seq for r in df.collect())


def only_file(path):
    return max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".txt")), key=os.path.getmtime)


def test_log_round_trip(spark, tmp_path):
    log = str(tmp_path / "log")
    assert seqs(read(spark, log)) == []
    journal_log.append(some(spark, 0, 30), log, "one")
    journal_log.append(some(spark, 30, 50), log, "one")
    assert sorted(map(tuple, read(spark, log).collect())) == sorted(map(tuple, some(spark, 0, 50).collect()))
    found = journal_log.Log(log)
    assert (found.journal, found.lowest, found.end) == ("one", 0, 50) and found.files == sorted(found.files)
    assert len(found.spans(30, 40)) < len(found.files)


def test_a_torn_record_waits_and_a_damaged_one_is_refused(spark, tmp_path):
    log = str(tmp_path / "log")
    journal_log.append(some(spark, 0, 10).coalesce(1), log, "one")
    path = only_file(log)
    whole = open(path, "rb").read()
    last = whole[:-1].rindex(b"\n") + 1
    for cut in (len(whole) - 1, last + 3, last + 1):
        open(path, "wb").write(whole[:cut])
        assert journal_log.Log(log).end == 9 and seqs(read(spark, log)) == list(range(9))
    open(path, "wb").write(whole)
    assert journal_log.Log(log).end == 10
    open(path, "wb").write(whole.replace(b"\t0\t", b"\t9\t", 1))
    with pytest.raises(PySparkException, match="not a record"):
        seqs(read(spark, log))


def test_last_lines_of_long_files(tmp_path):
    from pyarrow import fs

    for size in (0, 1, 5000, 70_000):
        path = tmp_path / f"f{size}"
        path.write_bytes(b"first\n" + b"x" * size + b"\ntorn")
        assert journal_log.last_line(fs.LocalFileSystem(), str(path), path.stat().st_size) == (b"x" * size or None)


def test_keyed_state_across_restarts(spark, tmp_path):
    """Batches of a few records, a restart, records out of order within a batch, and deletions."""
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    batches = 0
    for low, high in ((0, 20), (20, 55), (55, 56)):
        journal_log.append(some(spark, low, high), log, "one")
        started = stream.follow(stream.log_stream(spark, log, 10), checkpoint)
        started.processAllAvailable()
        batches += sum(p.numInputRows > 0 for p in started.recentProgress)
        started.stop()
        want = live.latest_changes(src.changes_of(some(spark, 0, high)))
        assert sorted(map(tuple, stream.kept_state(spark, checkpoint).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert batches >= 5


def test_tombstones_age_out(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    rows = [(0, 1, src.CREATE, "a", 0), (1, 1, src.DELETE, "", 1000), (2, 2, src.CREATE, "b", 2000)]
    held = lambda: {r.file_id: r.op for r in stream.kept_state(spark, checkpoint).collect()}
    states = []
    for more in (rows, [(3, 3, src.CREATE, "c", 4000)], [(4, 3, src.CREATE, "d", 90_000)], [(5, 3, src.CREATE, "e", 91_000)]):
        journal_log.append(records(spark, *more), log, "one")
        started = stream.follow(stream.log_stream(spark, log), checkpoint, keep_millis=10_000)
        started.processAllAvailable()
        started.stop()
        states.append(held())
    assert states[0] == {1: "Delete", 2: "Upsert"} and states[1] == {1: "Delete", 2: "Upsert", 3: "Upsert"}
    assert states[-1] == {2: "Upsert", 3: "Upsert"}


@pytest.mark.parametrize("how", ["identity", "truncated", "shorter"])
def test_a_reset_stops_the_stream_and_a_rebuild_goes_on(spark, tmp_path, how):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    journal_log.append(some(spark, 0, 20), log, "one")
    started = stream.follow(stream.log_stream(spark, log), checkpoint)
    started.processAllAvailable()
    started.stop()
    for f in os.listdir(log):
        os.remove(os.path.join(log, f))
    low, high, name = {"identity": (0, 40, "two"), "truncated": (25, 40, "one"), "shorter": (0, 5, "one")}[how]
    journal_log.append(some(spark, low, high), log, name)
    started = stream.follow(stream.log_stream(spark, log), checkpoint)
    try:
        with pytest.raises(StreamingQueryException, match="JournalReset"):
            started.processAllAvailable()
    finally:
        started.stop()
    found = stream.followed_or_rebuilt(spark, log, checkpoint, str(tmp_path / "again"))
    want = live.latest_changes(src.changes_of(some(spark, low, high)))
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_combined_before_the_shuffle(spark):
    rows = src.changes_of(some(spark, 0, 700, files=1).coalesce(1), "millis")
    assert stream.combined(rows).count() == 1 and stream.combined(rows).select(F.max("seq")).first()[0] == rows.select(F.max("seq")).first()[0]


def test_parts_of_a_file_hold_each_record_once(spark, tmp_path, monkeypatch):
    """A batch reads the parts of a file that hold its positions, whatever lines the cuts fall on."""
    log = str(tmp_path / "log")
    journal_log.append(some(spark, 0, 300, files=1).coalesce(1), log, "one")
    for span in (1, 37, 500, 1 << 20):
        monkeypatch.setattr(journal_log, "SPAN", span)
        for low, high in ((0, 300), (0, 1), (17, 18), (120, 180), (299, 300), (250, 900)):
            spans = journal_log.Log(log).spans(low, high)
            got = [x for s in spans for b in journal_log.records(*s.value) for x in b.column("seq").to_pylist()]
            assert got == list(range(low, min(high, 300)))
            assert span != 500 or len(spans) <= (min(high, 300) - low) // 5 + 3
    assert len(journal_log.Log(log).spans(0, 300)) == len(journal_log.Log(log).files)


def test_state_without_tombstones_ageing_makes_no_call_a_file(spark, tmp_path):
    """Thousands of files in a batch: their state is Spark's own aggregate."""
    log = str(tmp_path / "log")
    journal_log.append(records(spark, *[(i, i, src.CREATE, f"n{i}", i) for i in range(3000)]), log, "one")
    changes = stream.log_stream(spark, log)
    assert "FlatMapGroupsInPandasWithState" not in stream.keyed(changes)._jdf.queryExecution().analyzed().toString()
    started = stream.follow(changes, str(tmp_path / "checkpoint"))
    stream_done(started)
    assert stream.kept_state(spark, str(tmp_path / "checkpoint")).count() == 3000


def stream_done(started):
    started.processAllAvailable()
    started.stop()
