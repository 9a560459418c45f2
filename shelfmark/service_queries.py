"""Registered queries of the service around the catalog: routing, modes, several volumes, quarantine, published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog_queries import _NODE, ATTRIBUTES, CATALOG, CHANGES, CLEANUP, CONTENTS, DECIDED, LIVE, PATHS, PLAN, _files, _log, _plan, postings_sql, query, ranked_sql, score_sql
from .functions import names, safety
from .operators import duplicates, live, maintenance, model, search
from .operators.published import TABLES, Catalog, commits, snapshot_of
from .operators.published import catalog as published
from .sources import catalog as src
from .storage import shared_dir, table
from .streaming import journal as stream

_CONTENT = f"WITH {LIVE}, {CONTENTS}, " + postings_sql(names.TEXT_EXTENSIONS)


def hits_sql(*tokens: str) -> str:
    listed = ", ".join(f"'{t}'" for t in tokens)
    return f"(volume, file_id) IN (SELECT (volume, file_id) FROM postings WHERE token IN ({listed}) GROUP BY volume, file_id HAVING count(DISTINCT token) = {len(tokens)})"


#: A model that is sure of nothing, for queries that a rule decides or that nothing does.
BLANK = model.Model.blank()


# Smart search, a query for each branch


@query("q9_smart_content", _CONTENT + ranked_sql("of", hits_sql("of"), 50))
def _(spark, sf_dir):
    return search.smart(published(spark, sf_dir), "find files containing of", BLANK)


@query("q9_smart_related", f"WITH {LIVE} " + ranked_sql("node.js", _NODE, 50))
def _(spark, sf_dir):
    return search.smart(published(spark, sf_dir), "everything related to node js", BLANK)


@query("q9_smart_exact", f"WITH {LIVE} " + ranked_sql("package.json", "starts_with(nn, 'package.json')", 50))
def _(spark, sf_dir):
    return search.smart(published(spark, sf_dir), "find package.json", BLANK)


def fuzzy_sql(q: str, limit: int, columns: str, rows: str = "live", most: int = 2) -> str:
    d = f"least(levenshtein('{q}', nn), levenshtein('{q}', st))"
    return f"""SELECT {columns}, row_number() OVER (ORDER BY distance, score DESC, volume, file_id)::INT AS rank FROM (
    SELECT volume, file_id, name, flags, {d}::INT AS distance, {score_sql(q)} AS score FROM {rows} WHERE starts_with(nn, '{q[:2]}') AND {d} <= {most}) QUALIFY rank <= {limit}"""


@query("q9_smart_fuzzy", f"WITH {LIVE} " + fuzzy_sql("notepat.exe", 50, "volume, file_id, name, flags, score"))
def _(spark, sf_dir):
    return search.smart(published(spark, sf_dir), "fuzzy notepat.exe typo", BLANK)


@query("q9_smart_subject", f"WITH {LIVE} " + ranked_sql("renamed", "starts_with(nn, 'renamed')", 50))
def _(spark, sf_dir):
    """No rule decides and no model is sure: the subject, not the whole query, is searched."""
    return search.smart(published(spark, sf_dir), "give me renamed ones", BLANK)


@query("q9_smart_cleanup", f"WITH RECURSIVE {LIVE}, {PATHS}, {DECIDED}, {CLEANUP} SELECT volume, file_id, path, class, risk, action, confidence FROM planned")
def _(spark, sf_dir):
    return search.smart(published(spark, sf_dir), "cleanup of old build trees", BLANK)


_NAMED = "SELECT *, substr(trim(regexp_extract(url, '[^\\/]*$')), 1, 260) AS name FROM pages"


@query("q9_smart_web", f"WITH n AS ({_NAMED}) SELECT url AS title, url AS link, html AS snippet FROM n WHERE name = (SELECT max(name) FROM n WHERE regexp_matches(name, '^[0-9]{{3}}$')) QUALIFY row_number() OVER (ORDER BY page_id DESC) = 1")
def _(spark, sf_dir):
    """A lookup of the page whose name is the greatest number of three digits."""
    name = names.lookup_name(F.col("url"))
    target = table(spark, sf_dir, "pages").filter(name.rlike("^[0-9]{3}$")).agg(F.coalesce(F.max(name), F.lit("none"))).first()[0]
    return search.smart(published(spark, sf_dir), f"search web {target}", BLANK)


@query("q10_route_explain")
def _(spark, sf_dir):
    """Every query of the log with its intent, what decided it, the model's confidence and margin, and its subject."""
    log = _log(spark, sf_dir)
    return model.explained(log, "q", model.trained_on_rules(log.filter("conv_id % 2 = 0"), "q"), search.SURE)


# Modes


_WITHIN = "(lower(path) = 'c:' || chr(92) || 'en' OR starts_with(lower(path), 'c:' || chr(92) || 'en' || chr(92)))"
_PATHS = f"WITH RECURSIVE {LIVE}, {PATHS} "


@query("q11_mode_folders", _PATHS + ranked_sql("src", f"starts_with(nn, 'src') AND flags & 1 <> 0 AND {_WITHIN}", 80, extra="JOIN paths USING (volume, file_id)"))
def _(spark, sf_dir):
    return search.by_mode(published(spark, sf_dir), "Folders", "src", "C:/EN")


@query("q11_mode_files", _PATHS + ranked_sql("doc", f"starts_with(nn, 'doc') AND flags & 1 = 0 AND {_WITHIN}", 80, extra="JOIN paths USING (volume, file_id)"))
def _(spark, sf_dir):
    return search.by_mode(published(spark, sf_dir), "Files", "doc", "C:/EN")


@query("q11_mode_all", f"WITH {LIVE} " + ranked_sql("red", "starts_with(nn, 'red')", 80))
def _(spark, sf_dir):
    return search.by_mode(published(spark, sf_dir), "All", "red")


@query("q11_mode_all_related", f"WITH {LIVE} " + ranked_sql("node", _NODE, 80))
def _(spark, sf_dir):
    return search.by_mode(published(spark, sf_dir), "All", "node")


@query("q11_mode_content", f"WITH RECURSIVE {LIVE}, {PATHS}, {CONTENTS}, {postings_sql(names.TEXT_EXTENSIONS)} " + ranked_sql("of", f"{_WITHIN} AND {hits_sql('of')}", 80, extra="JOIN paths USING (volume, file_id)"))
def _(spark, sf_dir):
    return search.by_mode(published(spark, sf_dir), "Content", "of", "C:/EN")


# Searches with a budget for each volume


def by_volume_sql(q: str, where: str, order: str, limit: int, extra: str = "") -> str:
    """Two volumes give max(8, limit) candidates each at most, in their own order, which are then ranked together."""
    own = max(8, min(limit, limit))
    found = f"SELECT volume, file_id, name, flags, nn, st, {score_sql(q)} AS score FROM live {extra} WHERE {where} QUALIFY row_number() OVER (PARTITION BY volume ORDER BY {order}) <= {own}"
    return f"SELECT volume, file_id, name, flags, score, row_number() OVER (ORDER BY score DESC, strlen(name), volume, file_id)::INT AS rank FROM ({found}) QUALIFY rank <= {limit}"


_SCORED = "score DESC, strlen(name), file_id"


@query("q8_ranked_by_volume", f"WITH {LIVE} " + by_volume_sql("r", "starts_with(nn, 'r')", _SCORED, 20))
def _(spark, sf_dir):
    return search.ranked_by_volume(published(spark, sf_dir).live(), "r", 20, 2)


@query("q8_prefix_by_volume", f"WITH {LIVE} " + by_volume_sql("d", "starts_with(nn, 'd')", "nn, file_id", 20))
def _(spark, sf_dir):
    return search.prefix_by_volume(published(spark, sf_dir).live(), "D", 20, 2)


@query("q8_related_by_volume", f"WITH {LIVE} " + by_volume_sql("node js", _NODE, _SCORED, 30))
def _(spark, sf_dir):
    return search.related_by_volume(published(spark, sf_dir).live(), "node js", 30, 2)


@query("q8_filtered_by_volume", f"WITH {LIVE}, {ATTRIBUTES} " + by_volume_sql("", "a.size_bytes >= 1001", _SCORED, 30, "JOIN (SELECT volume, file_id, size_bytes FROM attributes) a USING (volume, file_id)"))
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return search.filtered_by_volume(found.live(), found.attributes("size:>1000"), "size:>1000", 30, 2)


@query("q8_content_by_volume", f"{_CONTENT} " + by_volume_sql("of the", hits_sql("the", "of"), "file_id", 30))
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return search.content_by_volume(found.live(), found.table("postings"), "of the", 30, 2)


@query("q8_fuzzy_by_volume", f"WITH {LIVE}, near AS (SELECT *, least(levenshtein('notpad', nn), levenshtein('notpad', st)) AS d FROM live WHERE starts_with(nn, 'no')), own AS (SELECT * FROM near WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY volume ORDER BY d, {score_sql('notpad')} DESC, file_id) <= 20) " + fuzzy_sql("notpad", 20, "volume, file_id, name, flags, distance, score", rows="own"))
def _(spark, sf_dir):
    return search.fuzzy_by_volume(published(spark, sf_dir).live(), "notpad", 20, 2)


@query("q7_content_in_order", f"{_CONTENT} SELECT volume, file_id, name, flags, row_number() OVER (ORDER BY file_id)::INT AS rank FROM live WHERE volume = 'C' AND {hits_sql('the', 'of')} QUALIFY rank <= 100")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return search.content_in_order(found.live(), found.table("postings"), "of the", "C")


# Many searches at once


_ASKED = "(SELECT DISTINCT p_brand || ':' || p_type || ':' || k AS query_id, substr(replace(p_name, ' ', '-'), 1, k) AS text FROM part, (SELECT unnest([2, 5, 9]) AS k))"


@query(
    "q16_batch_ranked",
    f"""WITH {LIVE}, asked AS {_ASKED}, hits AS (SELECT query_id, volume, file_id, name, flags, {score_sql("@").replace("'@'", "text")} AS score FROM live JOIN asked ON starts_with(nn, text))
    SELECT query_id, volume, file_id, name, flags, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(name), volume, file_id)::INT AS rank FROM hits QUALIFY rank <= 10""",
)
def _(spark, sf_dir):
    """Ranked searches for the starts of all parts' names, by brand and type."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", F.explode(F.array(F.lit(2), F.lit(5), F.lit(9))).alias("k"))
    asked = parts.select(F.concat_ws(":", "p_brand", "p_type", F.col("k").cast("string")).alias("query_id"), F.expr("substr(replace(p_name, ' ', '-'), 1, k)").alias("text")).distinct()
    return search.ranked_batch(published(spark, sf_dir).live(), asked, 10)


def _misspelt() -> tuple[str, str]:
    """Names of parts with a letter missing, a letter changed, or two letters too many, in Spark's SQL and DuckDB's."""
    name = "replace(p_name, ' ', '-')"
    text = f"CASE p_partkey % 3 WHEN 0 THEN substr({name}, 1, 3) || substr({name}, 5) WHEN 1 THEN substr({name}, 1, 5) || 'x' || substr({name}, 7) ELSE substr({name}, 1, 4) || 'zz' || substr({name}, 5) END"
    return text, text


@query(
    "q17_batch_fuzzy",
    f"""WITH {LIVE}, asked AS (SELECT p_partkey AS query_id, {_misspelt()[1]} AS text FROM part), texts AS (SELECT DISTINCT text FROM asked), words AS (SELECT DISTINCT nn, st FROM live),
    near AS (SELECT text, nn, least(levenshtein(text, nn), levenshtein(text, st))::INT AS distance FROM texts JOIN words ON substr(text, 1, 2) = substr(nn, 1, 2)),
    hits AS (SELECT text, volume, file_id, name, flags, distance, {score_sql("@").replace("'@'", "text")} AS score FROM live JOIN (SELECT * FROM near WHERE distance <= 2) USING (nn)),
    best AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, score DESC, volume, file_id)::INT AS rank FROM hits QUALIFY rank <= 10)
    SELECT query_id, volume, file_id, name, flags, distance, score, rank FROM asked JOIN best USING (text)""",
)
def _(spark, sf_dir):
    """A typo-tolerant search for every part by its misspelt name, through the dictionary of names."""
    found = published(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_misspelt()[0]).alias("text"))
    return search.fuzzy_batch(found.live(), found.table("dictionary"), asked, 10)


# Duplicates by file


_MEMBERS = "SELECT n_chars AS size_bytes, sha256(text) AS sha256, count(*) OVER (PARTITION BY n_chars, text) AS copies, 'C' AS volume, 1000000 + doc_id AS file_id FROM documents WHERE n_chars >= 1 QUALIFY copies >= 2"
_GUARDED = " OR ".join([f"contains(np, '{x}')" for x in safety.PROTECTED_INSIDE] + [f"ends_with(np, '{x}')" for x in safety.PROTECTED_ENDS]).replace("\\", "' || chr(92) || '")


@query("q12_duplicate_files", f"WITH RECURSIVE {LIVE}, {PATHS} SELECT m.*, path, ({_GUARDED}) AS protected FROM ({_MEMBERS}) m JOIN (SELECT *, replace(lower(path), '/', chr(92)) AS np FROM paths) USING (volume, file_id)")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    members = duplicates.duplicate_files(_files(spark, sf_dir), 1)
    rows = found.with_paths(members.join(found.live().select("volume", "file_id", "parent_id", "name"), ["volume", "file_id"]))
    return rows.select("size_bytes", "sha256", "copies", "volume", "file_id", "path", safety.protected(F.col("path")).alias("protected"))


@query("q12_staged_files", "SELECT n_chars AS size_bytes, sha256(text) AS hash, 'C' AS volume, 1000000 + doc_id AS file_id, 1000000 + min(doc_id) OVER (PARTITION BY n_chars, text) AS first_file FROM documents WHERE n_chars >= 1 QUALIFY count(*) OVER (PARTITION BY n_chars, text) >= 2")
def _(spark, sf_dir):
    """Members of duplicate sets by size, sample, hash and a comparison of bytes, each stage on what the one before left."""
    return duplicates.staged(_files(spark, sf_dir), 1)["bytes"].select("size_bytes", "hash", "volume", "file_id", F.col("first.file_id").alias("first_file"))


_ENDS = f"substr(text, 1, {duplicates.SAMPLE}), CASE WHEN length(text) > {duplicates.SAMPLE} THEN right(text, {duplicates.SAMPLE}) ELSE '' END"


@query(
    "a5_bytes_by_stage",
    f"""WITH d AS (SELECT * FROM documents WHERE n_chars >= 1), a AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY n_chars) >= 2),
    b AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY n_chars, {_ENDS}) >= 2), c AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY n_chars, text) >= 2)
    SELECT 'size' AS stage, count(*) AS files, 0::BIGINT AS bytes FROM d UNION ALL SELECT 'sample', count(*), coalesce(sum(least(n_chars, {2 * duplicates.SAMPLE})), 0)::BIGINT FROM a
    UNION ALL SELECT 'hash', count(*), coalesce(sum(n_chars), 0)::BIGINT FROM b UNION ALL SELECT 'bytes', count(*), coalesce(sum(n_chars), 0)::BIGINT FROM c""",
)
def _(spark, sf_dir):
    """How many files each stage of the duplicate check opens, and how many bytes of them it reads."""
    files = _files(spark, sf_dir)
    return duplicates.read_by_stage(files, duplicates.staged(files, 1), 1)


# Quarantine


def _entries(spark, sf_dir):
    return maintenance.quarantined(_plan(spark, sf_dir), published(spark, sf_dir).table("attributes"))


@query("m11_quarantine_list", f"{PLAN} SELECT * FROM entries ORDER BY id DESC LIMIT 100")
def _(spark, sf_dir):
    return maintenance.listed(_entries(spark, sf_dir))


@query("m11_restore_plan", f"{PLAN} SELECT id, target AS source, path AS target, CASE WHEN lower(path) IN (SELECT lower(path) FROM paths) THEN 'Refuse' ELSE 'Restore' END AS action FROM entries")
def _(spark, sf_dir):
    """As planned, nothing has moved yet, so that every restore is refused; the tests show the other case."""
    found = published(spark, sf_dir)
    return maintenance.restore_plan(_entries(spark, sf_dir), found.live(), found.table("directories"))


@query("m11_purge_plan", f"{PLAN} SELECT id, target, size_bytes FROM entries")
def _(spark, sf_dir):
    return maintenance.purge_plan(_entries(spark, sf_dir))


# Published tables


@query("m2_published_base", f"WITH {CATALOG} SELECT *, lower(name) AS name_norm FROM catalog")
def _(spark, sf_dir):
    return published(spark, sf_dir).table("base")


def _history(spark, sf_dir) -> Catalog:
    """A store of its own with three commits: a scan when half of the journal was written, a refresh, and a compaction."""
    root = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    end = src.changes(spark, sf_dir).agg(F.max("seq")).first()[0]
    Catalog(spark, sf_dir, root, upto=(end or 0) // 2).snapshot()
    later = Catalog(spark, sf_dir, root)
    later.refresh()
    later.maintain()
    return later


def _damage(store: Catalog, kind: str, newest: int) -> None:
    """Empty a table's generation in each of the newest commits."""
    for row in commits(store.spark, store.root).orderBy(F.desc("version")).limit(newest).collect():
        line = snapshot_of(row).tables[kind]
        store.spark.createDataFrame([], TABLES[kind][0]).write.mode("overwrite").parquet(f"{store.root}/{line.path}")


@query("m2_recovered_view", f"WITH {LIVE} SELECT volume, file_id, parent_id, size_bytes, flags, name, nn AS name_norm FROM live")
def _(spark, sf_dir):
    """The newest commit lost its base: the view is the one before it, of one snapshot throughout."""
    store = _history(spark, sf_dir)
    _damage(store, "base", 1)
    return Catalog(spark, sf_dir, store.root).live()


@query("m2_recovered_behind", f"WITH RECURSIVE {LIVE}, {PATHS} SELECT volume, file_id, path FROM paths")
def _(spark, sf_dir):
    """All commits but the first lost their overlay: that one is brought forward by the journal after it."""
    store = _history(spark, sf_dir)
    _damage(store, "overlay", 2)
    found = Catalog(spark, sf_dir, store.root)
    return found.with_paths(found.live()).select("volume", "file_id", "path")


@query(
    "m8_table_freshness",
    f"""WITH {CHANGES}, ends AS (SELECT max(seq) AS now, max(seq) FILTER (seq <= (SELECT max(seq) // 2 FROM changes)) AS half FROM changes)
    SELECT kind, CASE WHEN kind IN ('overlay', 'directories') THEN now ELSE half END AS position, kind <> 'attributes' OR now = half AS fresh
    FROM ends, (SELECT unnest(['attributes', 'base', 'by_id', 'directories', 'overlay']) AS kind)""",
)
def _(spark, sf_dir):
    """Tables published when half of the journal was written, after a refresh: what the changes do not touch is still fresh."""
    root = f"{shared_dir(spark)}/freshness-{uuid.uuid4().hex}"
    end = src.changes(spark, sf_dir).agg(F.max("seq")).first()[0]
    before = Catalog(spark, sf_dir, root, upto=(end or 0) // 2)
    before.table("attributes"), before.table("directories")
    later = Catalog(spark, sf_dir, root)
    later.refresh()
    return later.freshness()


@query("j1_bucketed_view", f"WITH {LIVE} SELECT volume, file_id, parent_id, size_bytes, flags, name, nn AS name_norm FROM live")
def _(spark, sf_dir):
    """The live view over the tables bucketed by id: no exchange above the base."""
    return published(spark, sf_dir).live("by_id")


@query("j2_bucketed_attributes", f"WITH {LIVE}, {ATTRIBUTES} SELECT l.volume, l.file_id, a.size_bytes AS attr_size, a.modified_unix_secs AS attr_modified FROM live l LEFT JOIN attributes a USING (volume, file_id)")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return live.with_attributes(found.live("by_id"), found.table("attributes")).select("volume", "file_id", "attr_size", "attr_modified")


@query("s6_id_scan", f"WITH {CATALOG} SELECT volume, file_id, name, lag(file_id) OVER (PARTITION BY volume ORDER BY file_id) IS NULL AS first FROM catalog")
def _(spark, sf_dir):
    """The base in the order of its ids, from the table that is stored so."""
    rows = published(spark, sf_dir).table("by_id")
    first = rows.groupBy("volume").agg(F.min("file_id").alias("least"))
    return rows.join(F.broadcast(first), "volume").select("volume", "file_id", "name", (F.col("file_id") == F.col("least")).alias("first"))


@query("s15_content_index", f"WITH {CONTENTS}, {postings_sql(names.TEXT_EXTENSIONS)} SELECT token, count(*) AS files, min(file_id) AS first_file FROM postings GROUP BY token")
def _(spark, sf_dir):
    """Of the posting lists alone: their counts and first places, without opening a list."""
    first = F.shiftleft("block", search.BLOCK_BITS) + F.col("offsets")[0]
    return published(spark, sf_dir).table("postings").groupBy("token").agg(F.sum("files").alias("files"), F.min(first).alias("first_file"))


@query("s16_discovered_volumes", f"WITH {CATALOG} SELECT upper(volume) AS volume, count(*) AS records FROM catalog WHERE regexp_matches(volume, '^[A-Za-z]$') GROUP BY 1")
def _(spark, sf_dir):
    """The volumes that a published base holds, with their rows."""
    rows = published(spark, sf_dir).table("base")
    return rows.filter(F.col("volume").rlike("^[A-Za-z]$")).groupBy(F.upper("volume").alias("volume")).agg(F.count("*").alias("records"))


@query("m12_rebuilt", f"""WITH {CATALOG}, {CHANGES}, late AS (SELECT * FROM changes WHERE seq >= (SELECT max(seq) // 2 FROM changes)),
last AS (SELECT volume, file_id, arg_max(op, seq) AS op, arg_max(name, seq) AS name FROM late GROUP BY volume, file_id)
SELECT volume, file_id, name FROM catalog WHERE (volume, file_id) NOT IN (SELECT (volume, file_id) FROM last) UNION ALL SELECT volume, file_id, name FROM last WHERE op = 'Upsert'""")
def _(spark, sf_dir):
    """A base scanned again when half of the journal was written, with what came during the scan."""
    changes = src.changes(spark, sf_dir)
    lowest, newest = changes.agg(F.min("seq"), F.max("seq")).first()
    return maintenance.rebuilt(src.catalog(spark, sf_dir), changes, newest // 2 if newest else 0, min(lowest or 0, (newest or 0) // 2)).select("volume", "file_id", "name")


@query("t5_needs_rebuild", f"WITH {CHANGES} SELECT file_id::VARCHAR AS volume, arg_min(seq, seq) < (SELECT max(seq) // 4 FROM changes) AS rebuild FROM changes GROUP BY file_id")
def _(spark, sf_dir):
    """Which readers of the journal, each left at its file's first change, lost their place once its first quarter is gone."""
    changes = src.changes(spark, sf_dir)
    readers = changes.groupBy(F.col("file_id").cast("string").alias("volume")).agg(F.min("seq").alias("next_usn"))
    ends = changes.agg(F.floor(F.max("seq") / 4).alias("lowest_usn"), F.max("seq").alias("newest"))
    journals = readers.select("volume").join(F.broadcast(ends)).select("volume", F.lit(1).alias("journal_id"), "lowest_usn", F.col("newest").alias("next_usn"))
    return stream.needs_rebuild(readers.withColumn("journal_id", F.lit(1)), journals)


@query("t6_next_step", f"WITH {CHANGES} SELECT file_id, CASE WHEN idle >= 30000 AND waiting > 0 THEN 'Compact' WHEN waiting >= 2097152 THEN 'Wait' ELSE 'Ingest' END AS step FROM (SELECT file_id, sum(strlen(name)) * 4096 AS waiting, ((SELECT max(seq) FROM changes) - max(seq)) * 100 AS idle FROM changes GROUP BY file_id)")
def _(spark, sf_dir):
    """What ingestion would do for each file's changes, as if each were a volume: names stand for 4096 bytes a letter, and a
    place in the journal for a tenth of a second."""
    changes = src.changes(spark, sf_dir)
    end = F.broadcast(changes.agg(F.max("seq").alias("end")))
    rows = changes.groupBy("file_id").agg((F.sum(F.octet_length("name")) * 4096).alias("waiting"), F.max("seq").alias("last")).join(end)
    return rows.select("file_id", stream.next_step(F.col("waiting"), (F.col("end") - F.col("last")) * 100).alias("step"))
