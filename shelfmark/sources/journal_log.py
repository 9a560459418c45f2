"""The change journal as raw logs, and a data source that reads them, as a batch or as a stream.

A log is a folder of text files. A line is one record: the journal's identity, its position (seq), file, reason, time and name
(in base64), and a CRC of what stands before it, between tabs. Positions grow within a file and from file to file, whatever
the files are called.

    journal_log.register(spark)
    spark.readStream.format("journal").option("path", log).option("records_per_batch", 10_000).load()

A stream's offset is an identity and the next position. A line that does not end yet is held back until it does, as its writer
may be at it; a line that ends and does not match its CRC is damaged, and raises ``DamagedRecord``. A reader whose place is gone
(its journal has another identity by now, or starts behind its position, or ends before it) raises ``JournalReset``: what was
read so far must be scanned again, as changes are missing. ``records_per_batch`` bounds the batches of a running stream; its
very first batch takes what is there. Empty folders have no records, and a stream on one waits.

Paths are URIs that pyarrow's file systems know (local, HDFS, object stores), or local paths that all executors share.
"""

from __future__ import annotations

import base64
import bisect
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "seq long, file_id long, reason int, name string, millis long"
_ARROW = pa.schema([("seq", pa.int64()), ("file_id", pa.int64()), ("reason", pa.int32()), ("name", pa.string()), ("millis", pa.int64())])
#: Bytes that are read of a file at once, and rows of a batch.
PIECE, ROWS = 1 << 20, 8192
#: Bytes of a file that a task reads.
SPAN = 4 << 20


class JournalReset(RuntimeError):
    """The place of a reader is not in the journal."""


class DamagedRecord(RuntimeError):
    """A whole line that isn't what its CRC says."""


def encoded(records: DataFrame, journal: str) -> DataFrame:
    """Lines of (seq, file_id, reason, name, millis) records."""
    line = F.concat_ws("\t", F.lit(journal), F.col("seq").cast("string"), F.col("file_id").cast("string"), F.col("reason").cast("string"), F.col("millis").cast("string"), F.base64(F.col("name").cast("binary")))
    return records.select("seq", F.concat_ws("\t", line, F.crc32(line.cast("binary")).cast("string")).alias("value"))


def append(records: DataFrame, path: str, journal: str) -> None:
    """Write records behind a log's last, in files of growing positions."""
    encoded(records, journal).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("append").text(path)


def decoded(line: bytes) -> tuple:
    """(journal, seq, file_id, reason, name, millis) of a line without its end."""
    rest, _, crc = line.rpartition(b"\t")
    fields = rest.split(b"\t")
    if len(fields) != 6 or not crc.isdigit() or int(crc) != zlib.crc32(rest):
        raise DamagedRecord(f"not a record: {line[:80]!r}")
    journal, seq, file_id, reason, millis, name = fields
    return journal.decode(), int(seq), int(file_id), int(reason), base64.b64decode(name).decode(), int(millis)


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def lines(path: str, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    """A file's whole lines that start at the bytes from ``begin`` to before ``end``, read piece by piece."""
    store, place = store_of(path)
    with store.open_input_file(place) as source:
        at, inside = max(begin - 1, 0), begin == 0  # what starts a byte earlier ends before the first line that counts
        source.seek(at)
        rest = b""
        while piece := source.read(PIECE):
            *found, rest = (rest + piece).split(b"\n")
            for line in found:
                if inside:
                    if end is not None and at >= end:
                        return
                    yield line
                at, inside = at + len(line) + 1, True


def last_line(store: stores.FileSystem, place: str, size: int) -> bytes | None:
    """A file's last whole line, found from its end."""
    length = 1 << 12
    with store.open_input_file(place) as source:
        while True:
            source.seek(max(size - length, 0))
            found = source.read().rpartition(b"\n")[0].rpartition(b"\n")
            if found[1] or length >= size:
                return found[2] or None
            length *= 8


class Log:
    """A log's files by position: (first position, last position, path); files without a whole line don't count yet."""

    def __init__(self, path: str):
        store, place = store_of(path)
        self.journal: str | None = None
        self.files: list[tuple[int, int, str]] = []
        self.sizes: dict[str, int] = {}
        infos = store.get_file_info(stores.FileSelector(place, allow_not_found=True))
        scheme = path[: path.index("://") + 3] if "://" in path and store.type_name not in ("local", "hdfs") else ""
        for x in infos:
            if x.type == stores.FileType.File and x.size and not x.base_name.startswith(("_", ".")):
                last = last_line(store, x.path, x.size)
                if last:
                    first = decoded(next(lines(scheme + x.path if scheme else x.path)))
                    self.files.append((first[1], decoded(last)[1], scheme + x.path))
                    self.sizes[scheme + x.path] = x.size
                    self.journal = first[0]
        self.files.sort()
        if self.files:
            self.journal = decoded(next(lines(self.files[-1][2])))[0]

    @property
    def lowest(self) -> int:
        return self.files[0][0] if self.files else 0

    @property
    def end(self) -> int:
        """The position behind the last whole record."""
        return self.files[-1][1] + 1 if self.files else 0

    def spans(self, start: int, end: int) -> list[InputPartition]:
        """Parts of files, SPAN bytes each, that hold the positions from ``start`` to before ``end``: a batch reads what it
        takes and not all of a file, by as many tasks as that fills."""
        found = []
        for first, last, path in self.files:
            if first < end and last >= start:
                cuts = range(0, self.sizes[path], SPAN)
                # A line before a cut's may be longer than a part; a cut without a line behind it is behind everything.
                position = lambda cut: next((decoded(x)[1] for x in lines(path, cut)), last + 1)  # noqa: B023, E731
                low = max(bisect.bisect_right(cuts, start, key=position) - 1, 0)
                high = bisect.bisect_left(cuts, end, key=position)
                found += [InputPartition((path, start, end, self.journal, cut, cut + SPAN)) for cut in cuts[low:high]]
        return found


def records(path: str, start: int, end: int, journal: str, begin: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records from ``start`` to before ``end`` of a file's lines between two bytes."""
    held: list[tuple] = []
    for line in lines(path, begin, stop):
        own, *row = decoded(line)
        if row[0] >= end:
            break
        if row[0] >= start:
            if own != journal:
                raise JournalReset(f"{path} is of journal {own}, not {journal}")
            held.append(tuple(row))
            if len(held) == ROWS:
                yield batch(held)
                held = []
    if held:
        yield batch(held)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class JournalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        log = Log(self.path)
        return log.spans(log.lowest, log.end)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else records(*partition.value)  # None where there are no partitions


class JournalStream(DataSourceStreamReader):
    def __init__(self, path: str, per_batch: int | None):
        self.path, self.per_batch = path, per_batch
        self.at: int | None = None

    def initialOffset(self) -> dict:
        log = Log(self.path)
        self.at = log.lowest
        return {"journal": log.journal or "", "position": self.at}

    def latestOffset(self) -> dict:
        log = Log(self.path)
        end = log.end
        if self.at is not None and self.per_batch is not None:
            end = min(end, max(self.at, log.lowest) + self.per_batch)
        return {"journal": log.journal or "", "position": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log, at, to = Log(self.path), start["position"], end["position"]
        # A journal that was empty when the stream began had no identity yet.
        if start["journal"] not in ("", log.journal or "") or end["journal"] != (log.journal or "") or (log.files and at < log.lowest and at > 0) or to < at or to > log.end:
            raise JournalReset(f"position {at} of journal {start['journal']!r} is gone: {self.path} is journal {log.journal!r} from {log.lowest} to {log.end}; scan again")
        self.at = to
        return log.spans(at, to)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return records(*partition.value)

    def commit(self, end: dict) -> None:
        self.at = end["position"]


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema) -> JournalStream:
        per_batch = self.options.get("records_per_batch")
        return JournalStream(self.options["path"], None if per_batch is None else int(per_batch))


def register(spark: SparkSession) -> None:
    """Make the source known to a session. Its code goes with it by value, as the process that plans a stream sees neither
    shipped files nor the driver's path."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JournalSource)
