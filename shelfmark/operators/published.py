"""The published catalog: generations of sorted tables, and commits that each name one generation of every table.

A generation is a Parquet folder of its own, so that a publish that fails or runs again never touches one that is read. A
commit is one line: its number, the journal and the position in it that the view shows, up to where changes are in the base
itself, and every table's folder, rows and position. It is put in place by a rename that only one publisher of a number can
win; the others get ``Conflict``. A reader opens the newest commit all of whose tables are whole (their columns and rows are
as its line says), and takes every table from it, never one from another: after damage it is at an older commit, and brings
that one forward by the journal after it.

The base is sorted by (volume, name_norm), posting lists by token and attributes once more by size and by date, so that
Parquet's statistics skip what a pushed prefix, token or range rules out. What meets by id (the base by id, the overlay,
attributes) is bucketed alike by (volume, file_id) and sorted within: the live view and attribute joins over it shuffle nothing.
How many buckets there are is chosen at the first scan and stands in the commits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_text_candidate
from ..plans.query import parse
from ..sources import catalog as src
from ..storage import claimed, shared_dir
from . import live, maintenance, search

_ROW = "volume string, file_id long, parent_id long, size_bytes long, flags int, name string, name_norm string"
_ATTRIBUTES = "volume string, file_id long, size_bytes long, modified_unix_secs long"
#: Columns of each table, and the order that its generations are written in.
TABLES = {
    "base": (_ROW, ["volume", "name_norm", "file_id"]),
    "by_id": (_ROW, ["volume", "file_id"]),
    "overlay": ("volume string, file_id long, seq long, op string, parent_id long, size_bytes long, flags int, name string, name_norm string", ["volume", "file_id"]),
    "attributes": (_ATTRIBUTES, ["volume", "file_id"]),
    "by_size": (_ATTRIBUTES, ["size_bytes", "volume", "file_id"]),
    "by_date": (_ATTRIBUTES, ["modified_unix_secs", "volume", "file_id"]),
    "postings": ("token string, volume string, block long, files long, offsets array<int>", ["token", "volume", "block"]),
    "dictionary": ("head string, length int, part int, segment string, form string, name_norm string", ["head", "length", "part", "segment"]),
    "directories": ("volume string, file_id long, path string, scope string", ["scope", "volume", "file_id"]),
}
#: The tables that are bucketed by id.
BUCKETED = ("by_id", "overlay", "attributes")
#: The tables that a view is made of; the others are derived, and are stale once the view has moved on.
CORE = ("base", "by_id", "overlay")
COMMIT = "version long, token string, journal string, position long, compacted long, buckets int, tables array<struct<kind:string,path:string,records:bigint,position:bigint>>"


class Conflict(RuntimeError):
    """Another publisher put a commit of this number in place first."""


class Stale(RuntimeError):
    """A derived table is older than the view, and the catalog was opened to refuse that."""


@dataclass(frozen=True)
class Line:
    """A generation of a table as a commit names it, by its folder below the root."""

    path: str
    records: int
    position: int | None


@dataclass(frozen=True)
class Snapshot:
    version: int
    journal: str
    position: int | None
    compacted: int | None
    buckets: int
    tables: dict[str, Line] = field(default_factory=dict)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """A line for each commit ever made below ``root``; none where there are none."""
    try:
        return spark.read.schema(COMMIT).json(f"{root}/commits/version=*/part-*")
    except AnalysisException:
        return spark.createDataFrame([], COMMIT)


def snapshot_of(row) -> Snapshot:
    return Snapshot(row.version, row.journal, row.position, row.compacted, row.buckets, {t.kind: Line(t.path, t.records, t.position) for t in row.tables})


def commit(spark: SparkSession, root: str, s: Snapshot) -> None:
    """Put a snapshot's line in place, or raise Conflict if its number is taken."""
    token = uuid.uuid4().hex
    row = [(s.version, token, s.journal, s.position, s.compacted, s.buckets, [(k, t.path, t.records, t.position) for k, t in sorted(s.tables.items())])]
    if not claimed(spark.createDataFrame(row, COMMIT), f"{root}/commits/version={s.version:010d}", f"{root}/staged/{token}"):
        raise Conflict(f"commit {s.version} is another publisher's")


def generation(rows: DataFrame, root: str, kind: str, position: int | None, buckets: int) -> Line:
    """Write a generation of a table, sorted, in buckets if it is one of those. It counts once a commit names it."""
    schema, order = TABLES[kind]
    columns = [c.split()[0] for c in schema.split(", ")]
    name = uuid.uuid4().hex
    path = f"{kind}/{name}"
    if kind in BUCKETED:
        dealt = rows.select(*columns).repartition(buckets, *live.KEY)
        dealt.write.bucketBy(buckets, *live.KEY).sortBy(*live.KEY).option("path", f"{root}/{path}").saveAsTable(f"{kind}_{name}")
    else:
        rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{root}/{path}")
    return Line(path, rows.sparkSession.read.schema(schema).parquet(f"{root}/{path}").count(), position)


def opened(spark: SparkSession, root: str, kind: str, line: Line, buckets: int) -> DataFrame:
    """A generation's rows. Buckets are known to Spark by a table in the session's catalog, which is made if another
    application wrote the generation; the table is external, so that no files go with it."""
    schema = TABLES[kind][0]
    if kind not in BUCKETED:
        return spark.read.schema(schema).parquet(f"{root}/{line.path}")
    name, keys = line.path.replace("/", "_"), ", ".join(live.KEY)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{root}/{line.path}'")
    return spark.table(name)


def whole(spark: SparkSession, root: str, kind: str, line: Line) -> bool:
    """Whether a generation's folder is there with its columns and as many rows as it should have."""
    wanted = spark.createDataFrame([], TABLES[kind][0]).schema
    try:
        found = spark.read.schema(wanted).parquet(f"{root}/{line.path}")
        files = found.inputFiles()
        if not files:
            return line.records == 0
        if kind in BUCKETED and not all(re.search(r"_[0-9]+(\.[^/]*)?$", f) for f in files):
            return False
        stands = spark.read.parquet(f"{root}/{line.path}").schema
        return [(f.name, f.dataType) for f in stands] == [(f.name, f.dataType) for f in wanted] and found.count() == line.records
    except Exception as e:  # noqa: BLE001  a damaged file shows itself as whatever its reader raises
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        return False


def newest(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest snapshot all of whose tables are whole; None if there is none."""
    for row in commits(spark, root).orderBy(F.desc("version")).toLocalIterator():
        s = snapshot_of(row)
        if all(whole(spark, root, k, t) for k, t in s.tables.items()):
            return s
    return None


def last_version(spark: SparkSession, root: str) -> int:
    return commits(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


class Catalog:
    """The published tables below ``root``. A table that no commit names yet is derived from the opened view when it is first
    asked for. ``refresh`` brings later changes, ``maintain`` compacts; both raise Conflict if another publisher was faster,
    and a catalog that is opened again sees the winner's tables.

    ``stale`` says what becomes of derived tables that are older than the view: "rebuild" publishes them again when they are
    asked for, "refuse" raises Stale. ``upto`` bounds the journal: the catalog as it was then. ``buckets`` is for a first scan;
    without it, there are as many as the session has shuffle partitions."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, stale: str = "rebuild", upto: int | None = None, buckets: int | None = None):
        if stale not in ("rebuild", "refuse"):
            raise ValueError("stale is rebuild or refuse")
        self.spark, self.sf_dir, self.root, self.stale, self.upto, self.buckets = spark, sf_dir, root, stale, upto, buckets
        self.at: Snapshot | None = None
        self.seen = 0

    # The journal

    def changes(self, after: int | None = None, until: int | None = None) -> DataFrame:
        rows = src.changes(self.spark, self.sf_dir)
        rows = rows if self.upto is None else rows.filter(F.col("seq") <= self.upto)
        rows = rows if after is None else rows.filter(F.col("seq") > after)
        return rows if until is None else rows.filter(F.col("seq") <= until)

    def journal_position(self) -> int | None:
        return self.changes().agg(F.max("seq")).first()[0]

    def journal_id(self) -> str:
        """Names the journal by its first record: another first record is another journal."""
        first = src.journal(self.spark.read.parquet(f"{self.sf_dir}/events.parquet")).agg(F.min(F.struct("seq", "file_id", "reason"))).first()[0]
        return "" if first is None else ":".join(map(str, first))

    # Opening and committing

    def snapshot(self) -> Snapshot:
        """The opened snapshot: the newest whole one, brought forward if newer ones are damaged; the first one is published
        from the sources."""
        if self.at is None:
            self.reopen()
            try:
                if self.at is None:
                    self.scan()
                elif self.at.version < self.seen:
                    self.refresh()
            except Conflict:  # someone else did so first
                self.reopen()
                if self.at is None:
                    raise
        return self.at

    def reopen(self) -> None:
        self.seen, self.at = last_version(self.spark, self.root), newest(self.spark, self.root)

    def scan(self) -> None:
        """A snapshot from the sources as they are, with all changes over it."""
        position, spark, root = self.journal_position(), self.spark, self.root
        base = src.catalog(spark, self.sf_dir)
        rows = {"base": base, "by_id": base, "overlay": src.named(live.latest_changes(self.changes(until=position)))}
        buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = {k: generation(r, root, k, position, buckets) for k, r in rows.items()}
        self.put(Snapshot(0, self.journal_id(), position, None, buckets, tables))

    def put(self, s: Snapshot) -> None:
        """Commit under the next number, unless there are commits that this catalog hasn't seen and that are whole."""
        last = last_version(self.spark, self.root)
        if last > self.seen and newest(self.spark, self.root) != self.at:
            raise Conflict(f"commit {last} came after {self.seen}")
        s = replace(s, version=last + 1)
        commit(self.spark, self.root, s)
        self.at, self.seen = s, s.version

    def derived(self, kind: str) -> DataFrame:
        """Rows of a derived table for the opened view."""
        spark, sf_dir = self.spark, self.sf_dir
        if kind in ("attributes", "by_size", "by_date"):
            return src.attributes(spark, sf_dir)
        if kind == "postings":
            return search.content_index(src.contents(spark, sf_dir).filter(is_text_candidate(F.col("name"))))
        if kind == "dictionary":
            return search.dictionary(self.live())
        return live.with_scopes(live.directory_paths(self.live()))

    def add(self, kind: str) -> None:
        """Publish a derived table for the opened view. If only other derived tables were added meanwhile, it joins them."""
        line = generation(self.derived(kind), self.root, kind, self.snapshot().position, self.at.buckets)
        for _ in range(8):
            try:
                return self.put(replace(self.at, tables={**self.at.tables, kind: line}))
            except Conflict:
                other = newest(self.spark, self.root)
                if other is None or any(other.tables.get(k) != self.at.tables[k] for k in CORE):
                    raise
                self.at, self.seen = other, last_version(self.spark, self.root)
        raise Conflict(f"{kind}: others commit all the time")

    def table(self, kind: str) -> DataFrame:
        s = self.snapshot()
        if kind not in s.tables or (kind not in CORE and s.tables[kind].position != s.position):
            if kind in s.tables and self.stale == "refuse":
                raise Stale(f"{kind} is at {s.tables[kind].position}, the view at {s.position}: build it again")
            self.add(kind)
        return self.read(kind)

    def read(self, kind: str) -> DataFrame:
        """A table of the opened snapshot as it stands there."""
        return opened(self.spark, self.root, kind, self.at.tables[kind], self.at.buckets)

    def attributes(self, query: str) -> DataFrame:
        """The attributes in the order that serves a query's filters: by size, by date, or by id where it has neither."""
        q = parse(query)
        return self.table("by_size" if q.size.any() else "by_date" if q.date.any() else "attributes")

    # The view

    def live(self, base: str = "base") -> DataFrame:
        """Base rows that no change overrides, and what the latest changes put there, both of one snapshot."""
        overlay = self.table("overlay")
        kept = self.table(base).join(overlay.select(*live.KEY), live.KEY, "left_anti")
        return kept.unionByName(overlay.filter("op = 'Upsert'").drop("seq", "op"))

    def with_paths(self, rows: DataFrame) -> DataFrame:
        return live.with_paths(rows, self.live(), self.table("directories"))

    def pending(self) -> bool:
        """Whether the journal went on since the opened snapshot."""
        return self.snapshot().position != self.journal_position()

    def refresh(self) -> bool:
        """Bring the view forward by the changes after its position; whether there were any. The overlay is its own latest
        changes and the journal's new part, whose position is pushed to its scan; directories are made again only if a change
        touches one. What was read before goes on being read. Another journal, or one that no longer reaches back to the
        position, means a new scan."""
        s, now = self.snapshot(), self.journal_position()
        if self.journal_id() != s.journal:
            self.scan()
            return True
        if now == s.position:
            return False
        old, fresh = self.table("overlay"), src.named(live.latest_changes(self.changes(s.position, now)))
        overlay = live.latest_changes(old.unionByName(fresh), "name_norm")
        tables = {**s.tables, "overlay": generation(overlay, self.root, "overlay", now, s.buckets)}
        if "directories" in tables and not self.moves_directories(fresh):
            tables["directories"] = replace(tables["directories"], position=now)
        self.put(replace(s, position=now, tables=tables))
        return True

    def moves_directories(self, changes: DataFrame) -> bool:
        """Whether a change concerns a directory, or a parent that wasn't one's before."""
        known = self.read("directories").select(*live.KEY)
        own = changes.join(known, live.KEY, "left_semi")
        parents = changes.filter("op = 'Upsert'").select("volume", F.col("parent_id").alias("file_id")).distinct().join(known, live.KEY, "left_anti")
        return not own.select(*live.KEY).union(parents).isEmpty()

    def freshness(self) -> DataFrame:
        """(kind, position, fresh) of every table of the opened snapshot: whether it is at the view's position. A search that
        needs one that isn't builds it again, or refuses."""
        s = self.snapshot()
        rows = [(k, t.position, k in CORE or t.position == s.position) for k, t in sorted(s.tables.items())]
        return self.spark.createDataFrame(rows, "kind string, position long, fresh boolean")

    def build(self, kind: str) -> None:
        """Publish a derived table again. Refused while changes wait, as it would be older than the view beside it."""
        if self.pending():
            raise RuntimeError("changes wait: refresh first")
        self.add(kind)

    def maintain(self) -> DataFrame:
        """Compact if the overlay has rows: the live view becomes the base and the overlay starts anew, in one commit; derived
        tables stay, as the view does. Then repair what is damaged. Gives the base's health, a row for each volume."""
        s = self.snapshot()
        if not self.table("overlay").isEmpty():
            rows = {"base": self.live(), "by_id": self.live("by_id"), "overlay": self.table("overlay").limit(0)}
            self.put(replace(s, compacted=s.position, tables={**s.tables, **{k: generation(r, self.root, k, s.position, s.buckets) for k, r in rows.items()}}))
        self.repair()
        base = self.table("base")
        return maintenance.verify(base, self.table("overlay").select("volume", "file_id")).join(maintenance.deep_verify(base).select("volume", "ids_repeated", "parent_links_missing"), "volume")

    def repair(self) -> list[str]:
        """The tables of the newest commit that aren't whole; if there are any, a commit of whole tables for the journal's
        newest position follows: from the newest whole snapshot, or from the sources if there is none."""
        row = commits(self.spark, self.root).orderBy(F.desc("version")).first()
        last = None if row is None else snapshot_of(row)
        broken = [] if last is None else sorted(k for k, t in last.tables.items() if not whole(self.spark, self.root, k, t))
        if broken:
            self.seen, self.at = last.version, newest(self.spark, self.root)
            if self.at is None:
                self.scan()
            elif not self.refresh():
                self.put(self.at)
            for kind in set(last.tables) - set(self.at.tables):
                self.add(kind)
        return broken


_OPEN: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a folder of tables for this application, published at its first use: source tables are taken as they
    are then, and later changes come by ``refresh``."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _OPEN:
        _OPEN[key] = Catalog(spark, sf_dir, f"{shared_dir(spark)}/catalog-{hashlib.md5('|'.join(key).encode()).hexdigest()}")
    return _OPEN[key]
