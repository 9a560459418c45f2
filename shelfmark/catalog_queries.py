"""Registered queries of the catalog engine, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intent, names, safety, web
from .operators import duplicates, live, maintenance, model, search
from .operators.published import catalog as published
from .plans import uri
from .sources import catalog as src
from .sources import files, journal_log
from .storage import shared_dir, table
from .streaming import journal as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    if name in QUERIES:
        raise ValueError(f"{name} is taken")

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The relations in SQL

_LANGS = "['de', 'en', 'es', 'fr']"
_EXT = str(src.EXTENSIONS)
_SPECIAL = str(src.SPECIAL)
C_NAME = f"'doc-' || lpad(doc_id::VARCHAR, 7, '0') || {_EXT}[doc_id % 10 + 1]"
CATALOG = f"""
c_docs AS (SELECT doc_id, lang, source, list_position({_LANGS}, lang) - 1 AS lp, substr(source, 4)::BIGINT AS sn FROM documents),
catalog AS (
  SELECT 'C' AS volume, 5::BIGINT AS file_id, 5::BIGINT AS parent_id, 0::BIGINT AS size_bytes, 1::INT AS flags, 'C:' AS name
  UNION ALL SELECT 'C', 9 + i, 5, 0, 1, {_LANGS}[i] FROM (SELECT unnest([1, 2, 3, 4]) AS i)
  UNION ALL SELECT DISTINCT 'C', 100 + lp * 100 + sn, 10 + lp, 0, 1, source FROM c_docs
  UNION ALL SELECT 'C', 1000000 + doc_id, 100 + lp * 100 + sn, 0, 0, {C_NAME} FROM c_docs
  UNION ALL SELECT 'D', 5, 5, 0, 1, 'D:'
  UNION ALL SELECT DISTINCT 'D', 1000 + split_part(p_brand, '#', 2)::BIGINT, 5, 0, 1, p_brand FROM part
  UNION ALL SELECT 'D', 1000000 + p_partkey, 1000 + split_part(p_brand, '#', 2)::BIGINT, 0,
    (p_partkey % 200 = 2)::INT + 2 * (p_partkey % 50 = 11)::INT + 4 * (p_partkey % 75 = 13)::INT,
    CASE WHEN p_partkey % 200 < 10 THEN {_SPECIAL}[p_partkey % 200 + 1] ELSE replace(p_name, ' ', '-') || '.dat' END FROM part)"""
CHANGES = """
changes AS (SELECT 'D' AS volume, event_id AS seq, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Upsert' END AS op, 1000000 + user_id AS file_id,
  5::BIGINT AS parent_id, 0::BIGINT AS size_bytes, 0::INT AS flags, CASE WHEN event_type = 'error' THEN '' ELSE 'renamed-' || event_id || '.txt' END AS name
  FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
latest AS (SELECT volume, file_id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(parent_id, seq) AS parent_id, arg_max(size_bytes, seq) AS size_bytes,
  arg_max(flags, seq) AS flags, arg_max(name, seq) AS name FROM changes GROUP BY volume, file_id)"""
LIVE = f"""{CATALOG}, {CHANGES},
live AS (SELECT *, lower(name) AS nn, CASE WHEN strpos(lower(name), '.') > 0 THEN regexp_extract(lower(name), '^(.*)[.][^.]*$', 1) ELSE lower(name) END AS st FROM (
  SELECT volume, file_id, parent_id, size_bytes, flags, name FROM catalog WHERE (volume, file_id) NOT IN (SELECT (volume, file_id) FROM latest)
  UNION ALL SELECT volume, file_id, parent_id, size_bytes, flags, name FROM latest WHERE op = 'Upsert'))"""
PATHS = r"""
up AS (SELECT volume, file_id, file_id AS at, parent_id, name AS path, 0 AS d FROM live UNION ALL
  SELECT u.volume, u.file_id, p.file_id, p.parent_id, p.name || chr(92) || u.path, d + 1 FROM up u JOIN live p ON p.volume = u.volume AND p.file_id = u.parent_id
  WHERE u.parent_id <> 0 AND u.parent_id <> u.at AND d < 255),
paths AS (SELECT volume, file_id, CASE WHEN regexp_matches(path, '^[A-Za-z]:') THEN path ELSE volume || ':' || chr(92) || path END AS path
  FROM (SELECT volume, file_id, arg_max(path, d) AS path FROM up GROUP BY volume, file_id))"""
ATTRIBUTES = """
attributes AS (SELECT 'C' AS volume, 1000000 + doc_id AS file_id, n_chars AS size_bytes, 1704067200 + doc_id * 3600 AS modified_unix_secs FROM documents
  UNION ALL SELECT 'D', 1000000 + p_partkey, p_size::BIGINT * 1000000, 1704067200 + p_partkey * 86400 FROM part)"""
CONTENTS = f"""
contents AS (SELECT 'C' AS volume, 1000000 + doc_id AS file_id, {C_NAME} AS name, text FROM documents)"""
#: A run of more than 96 bytes is read letter by letter, and cleared each time that it passes 96.
_RUN = r"CASE WHEN strlen(t) <= 96 THEN t ELSE list_reduce(string_split(t, ''), lambda a, c: CASE WHEN strlen(a || c) > 96 THEN '' ELSE a || c END, '') END"
_RUNS = rf"list_filter(list_distinct(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\-]+'), lambda t: {_RUN})), lambda t: strlen(t) >= 2)"


def candidates_sql(extensions: list[str]) -> str:
    return f"regexp_matches(lower(name), '[.]({'|'.join(extensions)})$')"


def postings_sql(extensions: list[str]) -> str:
    """A file's distinct tokens in DuckDB."""
    return f"postings AS (SELECT volume, file_id, unnest({_RUNS}) AS token FROM contents WHERE {candidates_sql(extensions)})"


def score_sql(q: str) -> str:
    q = f"'{q}'"
    return f"""CASE WHEN nn = {q} OR st = {q} OR starts_with(nn, {q}) OR starts_with(st, {q}) OR contains(nn, {q}) THEN
      CASE WHEN nn = {q} THEN 10000 WHEN st = {q} THEN 9000 WHEN starts_with(nn, {q}) THEN 7000 WHEN starts_with(st, {q}) THEN 6500 ELSE 4000 END
      + CASE WHEN flags & 1 <> 0 THEN 120 ELSE 0 END - CASE WHEN flags & 2 <> 0 THEN 300 ELSE 0 END - CASE WHEN flags & 4 <> 0 THEN 500 ELSE 0 END
      - least(500, greatest(0, strlen(nn) - strlen({q}))) ELSE 0 END::INT"""


def ranked_sql(q: str, where: str, limit: int, rows: str = "live", extra: str = "") -> str:
    return f"""SELECT volume, file_id, name, flags, score, row_number() OVER (ORDER BY score DESC, strlen(name), volume, file_id)::INT AS rank FROM (
      SELECT volume, file_id, name, flags, {score_sql(q)} AS score FROM {rows} {extra} WHERE {where})
    QUALIFY rank <= {limit}"""


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view made from the sources."""
    return live.live_view(src.catalog(spark, sf_dir), src.changes(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(src.contents(spark, sf_dir).filter(names.is_text_candidate(F.col("name"))))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view over the published base and overlay, as searches read it."""
    return published(spark, sf_dir).live()


# Scans, changes and the live view


@query("s1_catalog_scan", f"WITH {CATALOG} SELECT volume, count(*) AS records, count_if(flags & 1 <> 0) AS directories, sum(file_id)::BIGINT AS id_sum FROM catalog GROUP BY volume")
def _(spark, sf_dir):
    rows = src.catalog(spark, sf_dir)
    return rows.groupBy("volume").agg(F.count("*").alias("records"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("directories"), F.sum("file_id").alias("id_sum"))


@query("s2_journal_changes", f"WITH {CHANGES} SELECT * FROM changes")
def _(spark, sf_dir):
    return src.changes(spark, sf_dir)


@query("s10_attributes", f"WITH {CATALOG}, {ATTRIBUTES} SELECT c.volume, c.file_id, a.size_bytes, a.modified_unix_secs FROM catalog c JOIN attributes a USING (volume, file_id) WHERE flags & 1 = 0")
def _(spark, sf_dir):
    files = src.catalog(spark, sf_dir).filter(F.col("flags").bitwiseAND(1) == 0).select("volume", "file_id")
    return files.join(src.attributes(spark, sf_dir), live.KEY)


@query("s16_volumes", f"WITH {CATALOG} SELECT DISTINCT upper(volume) AS volume FROM catalog WHERE regexp_matches(volume, '^[A-Za-z]$')")
def _(spark, sf_dir):
    return src.catalog(spark, sf_dir).filter(F.col("volume").rlike("^[A-Za-z]$")).select(F.upper("volume").alias("volume")).distinct()


@query("a1_latest_changes", f"WITH {CHANGES} SELECT * FROM latest")
def _(spark, sf_dir):
    return live.latest_changes(src.changes(spark, sf_dir))


@query("j1_live_view", f"WITH {LIVE} SELECT volume, file_id, parent_id, size_bytes, flags, name, nn AS name_norm FROM live")
def _(spark, sf_dir):
    return view(spark, sf_dir)


@query("j2_live_attributes", f"WITH {LIVE}, {ATTRIBUTES} SELECT l.volume, l.file_id, a.size_bytes AS attr_size, a.modified_unix_secs AS attr_modified FROM live l LEFT JOIN attributes a USING (volume, file_id)")
def _(spark, sf_dir):
    return live.with_attributes(view(spark, sf_dir), src.attributes(spark, sf_dir)).select("volume", "file_id", "attr_size", "attr_modified")


@query("j3_paths", f"WITH RECURSIVE {LIVE}, {PATHS} SELECT volume, file_id, path FROM paths")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return found.with_paths(found.live()).select("volume", "file_id", "path")


@query("j8_overridden", f"WITH {CATALOG}, {CHANGES} SELECT c.volume, c.file_id, l.file_id IS NOT NULL AS changed FROM catalog c LEFT JOIN latest l USING (volume, file_id)")
def _(spark, sf_dir):
    return live.overridden(src.catalog(spark, sf_dir), src.changes(spark, sf_dir)).select("volume", "file_id", "changed")


#: A view that lost the directories with odd ids, so that links are missing.
DAMAGED = f"{LIVE}, damaged AS (SELECT * FROM live WHERE flags & 1 = 0 OR file_id % 2 = 0)"


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).filter((F.col("flags").bitwiseAND(1) == 0) | (F.col("file_id") % 2 == 0))


@query("j9_missing_parents", f"WITH {DAMAGED} SELECT volume, file_id, parent_id FROM damaged l WHERE parent_id <> 0 AND parent_id <> file_id AND NOT EXISTS (SELECT 1 FROM damaged p WHERE p.volume = l.volume AND p.file_id = l.parent_id)")
def _(spark, sf_dir):
    return maintenance.missing_parents(damaged(spark, sf_dir))


@query("q15_point_lookup", f"WITH RECURSIVE {LIVE}, {PATHS} SELECT volume, file_id, name, path FROM live JOIN paths USING (volume, file_id) WHERE volume = 'C' AND file_id = 1000007")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return found.with_paths(live.by_id(found.live("by_id"), "C", 1_000_007)).select("volume", "file_id", "name", "path")


# Searches


@query("q1_prefix_search", f"WITH {LIVE} SELECT volume, file_id, name, flags, row_number() OVER (ORDER BY nn, volume, file_id)::INT AS rank FROM live WHERE starts_with(nn, 'red') QUALIFY rank <= 50")
def _(spark, sf_dir):
    return search.prefix(stored(spark, sf_dir), "Red")


@query("q2_exact_search", f"WITH {LIVE} SELECT volume, file_id, name, flags, row_number() OVER (ORDER BY nn, volume, file_id)::INT AS rank FROM live WHERE nn = 'node.exe' QUALIFY rank <= 50")
def _(spark, sf_dir):
    return search.exact(stored(spark, sf_dir), "NODE.EXE")


@query("q3_ranked_search", f"WITH {LIVE} " + ranked_sql("red", "starts_with(nn, 'red')", 50))
def _(spark, sf_dir):
    return search.ranked(stored(spark, sf_dir), "red")


_DIST = "least(levenshtein('notpad', nn), levenshtein('notpad', st))"


@query(
    "q4_fuzzy_search",
    f"""WITH {LIVE} SELECT volume, file_id, name, flags, distance, score, row_number() OVER (ORDER BY distance, score DESC, volume, file_id)::INT AS rank FROM (
    SELECT volume, file_id, name, flags, {_DIST}::INT AS distance, {score_sql("notpad")} AS score FROM live WHERE starts_with(nn, 'no') AND {_DIST} <= 2) QUALIFY rank <= 50""",
)
def _(spark, sf_dir):
    return search.fuzzy(stored(spark, sf_dir), "notpad")


_NODE = " OR ".join(f"starts_with(nn, '{a}')" for a in intent.RELATIONS[0][3])


@query("q5_related_search", f"WITH {LIVE} " + ranked_sql("node js", _NODE, 100))
def _(spark, sf_dir):
    return search.related(stored(spark, sf_dir), "node js")


@query("q6_filtered_size", f"WITH {LIVE}, {ATTRIBUTES} " + ranked_sql("", "regexp_matches(nn, '[.]md$') AND a.size_bytes >= 501", 50, extra="JOIN (SELECT volume, file_id, size_bytes, modified_unix_secs FROM attributes) a USING (volume, file_id)"))
def _(spark, sf_dir):
    return search.filtered(stored(spark, sf_dir), published(spark, sf_dir).attributes("size:>500"), "ext:md size:>500")


@query(
    "q6_filtered_path_date",
    f"WITH RECURSIVE {LIVE}, {PATHS}, {ATTRIBUTES} " + ranked_sql("doc", "starts_with(nn, 'doc') AND contains(lower(path), 'fr') AND a.modified_unix_secs >= 1704844800", 50, extra="JOIN paths USING (volume, file_id) JOIN (SELECT volume, file_id, modified_unix_secs FROM attributes) a USING (volume, file_id)"),
)
def _(spark, sf_dir):
    return search.filtered(stored(spark, sf_dir), published(spark, sf_dir).attributes("date:>=2024-01-10"), "doc path:fr date:>=2024-01-10", directories=published(spark, sf_dir).table("directories"))


@query("q6_filtered_type", f"WITH {LIVE} " + ranked_sql("", "flags & 1 <> 0", 50))
def _(spark, sf_dir):
    return search.filtered(stored(spark, sf_dir), published(spark, sf_dir).table("attributes"), "type:dir")


_APP = " OR ".join(f"nn = '{a}' OR contains(lower(path), '{a}')" for a in intent.RELATIONS[0][3])


@query("q6_filtered_app", f"WITH RECURSIVE {LIVE}, {PATHS} " + ranked_sql("", f"contains(lower(path), 'node') OR contains(nn, 'node') OR {_APP}", 50, extra="JOIN paths USING (volume, file_id)"))
def _(spark, sf_dir):
    return search.filtered(stored(spark, sf_dir), published(spark, sf_dir).table("attributes"), "app:node", directories=published(spark, sf_dir).table("directories"))


_CONTENT = f"WITH {LIVE}, {CONTENTS}, " + postings_sql(names.TEXT_EXTENSIONS)


@query("s13_postings", f"WITH {CONTENTS}, {postings_sql(names.TEXT_EXTENSIONS)} SELECT volume, file_id, token FROM postings")
def _(spark, sf_dir):
    return index(spark, sf_dir)


@query("s14_rich_token_counts", f"WITH {CONTENTS} SELECT volume, file_id, len({_RUNS})::BIGINT AS tokens FROM contents WHERE {candidates_sql(names.TEXT_EXTENSIONS + names.RICH_EXTENSIONS)} AND len({_RUNS}) > 0")
def _(spark, sf_dir):
    files = src.contents(spark, sf_dir).filter(names.is_rich_candidate(F.col("name")))
    return search.postings(files).groupBy("volume", "file_id").agg(F.count("*").alias("tokens"))


_HITS = "(volume, file_id) IN (SELECT (volume, file_id) FROM postings WHERE token IN ('the', 'of') GROUP BY volume, file_id HAVING count(DISTINCT token) = 2)"


@query("q7_content_search", _CONTENT + ranked_sql("of the", _HITS, 100))
def _(spark, sf_dir):
    return search.content(stored(spark, sf_dir), published(spark, sf_dir).table("postings"), "of the")


@query(
    "q3_ranked_bounded",
    f"""WITH {LIVE}, b AS (SELECT * FROM live WHERE starts_with(nn, 'red') QUALIFY row_number() OVER (PARTITION BY volume ORDER BY nn, file_id) <= 160) """ + ranked_sql("red", "true", 20, rows="b"),
)
def _(spark, sf_dir):
    return search.ranked_bounded(stored(spark, sf_dir), "red", 20)


# Duplicates


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("C").alias("volume"), (F.lit(1_000_000) + F.col("doc_id")).alias("file_id"), F.col("n_chars").alias("size_bytes"), "text")


@query("a3_same_size", "SELECT n_chars AS size_bytes, count(*) AS files FROM documents WHERE n_chars >= 1 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf_dir):
    return duplicates.same_size(_files(spark, sf_dir), 1)


@query("a4_same_size_merged", f"WITH {ATTRIBUTES} SELECT size_bytes, count(*) AS files FROM attributes WHERE size_bytes >= 8 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf_dir):
    return duplicates.same_size(src.attributes(spark, sf_dir), 8)


@query("a3_group_stats", "WITH g AS (SELECT n_chars, count(*) AS n FROM documents WHERE n_chars >= 1 GROUP BY 1) SELECT count_if(n BETWEEN 2 AND 3)::BIGINT AS groups, coalesce(sum(n) FILTER (n BETWEEN 2 AND 3), 0)::BIGINT AS members, count_if(n > 3)::BIGINT AS oversized_groups_skipped FROM g")
def _(spark, sf_dir):
    return duplicates.group_stats(_files(spark, sf_dir), 1, 3)


_SETS = """SELECT n_chars AS size_bytes, sha256(text) AS sha256, count(*) AS files, 'C:' || (1000000 + min(doc_id)) AS first_file, n_chars * (count(*) - 1) AS reclaimable
FROM documents WHERE n_chars IN (SELECT n_chars FROM documents WHERE n_chars >= 1 GROUP BY 1 HAVING count(*) >= 2) GROUP BY n_chars, text HAVING count(*) >= 2"""


@query("q12_duplicate_sets", _SETS)
def _(spark, sf_dir):
    return duplicates.duplicate_sets(_files(spark, sf_dir), 1)


@query("a7_duplicate_report", f"SELECT count(*) AS sets, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable FROM ({_SETS})")
def _(spark, sf_dir):
    return duplicates.report(duplicates.duplicate_sets(_files(spark, sf_dir), 1))


# Safety and cleanup


def _class_sql(path: str, flags: str) -> str:
    p = f"replace(lower({path}), '/', chr(92))"
    lit = lambda x: "'" + x.replace("\\", "' || chr(92) || '") + "'"
    out = "CASE "
    for name, _, _, parts, inside, ends in safety.CLASSES:
        tests = [f"contains({p}, {lit(x)})" for x in inside] + [f"ends_with({p}, {lit(x)})" for x in ends]
        tests += [f"list_has_any(string_split({p}, chr(92)), {parts})"] if parts else []
        tests += [f"{flags} & 4 <> 0"] if name == "System" else []
        out += f"WHEN {' OR '.join(tests)} THEN '{name}' "
    return out + "ELSE 'Unknown' END"


_SURE = "CASE class " + " ".join(f"WHEN '{c[0]}' THEN {c[2]}" for c in safety.CLASSES) + " ELSE 25 END"
_RISK = "CASE class " + " ".join(f"WHEN '{c[0]}' THEN '{c[1]}'" for c in safety.CLASSES) + " ELSE 'High' END"
_GUARD = " OR ".join([f"contains(np, '{x}')" for x in safety.PROTECTED_INSIDE] + [f"ends_with(np, '{x}')" for x in safety.PROTECTED_ENDS]).replace("\\", "' || chr(92) || '")
DECIDED = f"""
kinds AS (SELECT volume, file_id, path, name, flags, replace(lower(path), '/', chr(92)) AS np, {_class_sql("path", "flags")} AS class FROM live JOIN paths USING (volume, file_id)),
decided AS (SELECT volume, file_id, path, name, class, {_RISK} AS risk,
  CASE WHEN {_GUARD} OR class = 'System' THEN 'Deny' WHEN class IN ('Cache', 'Temporary') THEN 'Quarantine' WHEN class IN ('BuildArtifact', 'Log') THEN 'RecommendOnly' WHEN class = 'Unknown' THEN 'Keep' ELSE 'Deny' END AS action,
  (CASE WHEN {_GUARD} OR class = 'System' THEN 100 WHEN class = 'Unknown' THEN 20 ELSE {_SURE} END)::INT AS confidence FROM kinds)"""


@query("f11_safety_decisions", f"WITH RECURSIVE {LIVE}, {PATHS}, {DECIDED} SELECT volume, file_id, path, class, risk, action, confidence FROM decided")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return maintenance.decisions(found.with_paths(found.live()))


_PATTERN = "CASE " + " ".join(f"WHEN starts_with(lower(name), '{p}') THEN {i}" for i, p in enumerate(maintenance.PATTERNS)) + " END"
FOUND = f"found AS (SELECT *, {_PATTERN} AS pattern FROM decided WHERE action <> 'Keep' AND {_PATTERN} IS NOT NULL)"
CLEANUP = f"""{FOUND},
ranked AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY lower(name), volume, file_id) AS nth FROM found QUALIFY nth <= 128),
planned AS (SELECT * FROM ranked ORDER BY pattern, nth LIMIT 500)"""
#: The whole quarantine plan, its records once carried out, and how a record is named.
PLAN = f"""WITH RECURSIVE {LIVE}, {PATHS}, {DECIDED}, {FOUND}, {ATTRIBUTES},
plan AS (SELECT volume, file_id, path, 'Q:' || chr(92) || 'quarantine' || chr(92) || replace(path, ':', '') AS target FROM found WHERE action = 'Quarantine'),
entries AS (SELECT substr(sha256(volume || ':' || file_id || ':' || path), 1, 40) AS id, volume, file_id, path, target, coalesce(a.size_bytes, 0) AS size_bytes FROM plan LEFT JOIN attributes a USING (volume, file_id))"""


@query("q13_cleanup", f"WITH RECURSIVE {LIVE}, {PATHS}, {DECIDED}, {CLEANUP} SELECT volume, file_id, path, class, risk, action, confidence FROM planned")
def _(spark, sf_dir):
    found = published(spark, sf_dir)
    return maintenance.cleanup(found.live(), directories=found.table("directories"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = published(spark, sf_dir)
    return maintenance.quarantine_plan(maintenance.candidates(found.live(), found.table("directories")))


@query("m11_quarantine_plan", f"{PLAN} SELECT * FROM plan")
def _(spark, sf_dir):
    return _plan(spark, sf_dir)


# Maintenance


@query("m1_compact", f"WITH {LIVE} SELECT volume, file_id, parent_id, size_bytes, flags, name, nn AS name_norm FROM live")
def _(spark, sf_dir):
    return maintenance.compact(src.catalog(spark, sf_dir), src.changes(spark, sf_dir))


@query("m3_verify", f"WITH {CATALOG}, {CHANGES} SELECT volume, count(*) AS records, coalesce(any_value(e), 0) AS delta_entries, coalesce(any_value(u), 0) AS delta_unique FROM catalog LEFT JOIN (SELECT volume, count(*) AS e, count(DISTINCT file_id) AS u FROM changes GROUP BY volume) USING (volume) GROUP BY volume")
def _(spark, sf_dir):
    return maintenance.verify(src.catalog(spark, sf_dir), src.changes(spark, sf_dir))


_DEEP = """(SELECT volume, count(name) AS names_checked, count(DISTINCT file_id) AS ids_checked, (SELECT count(*) FROM (SELECT 1 FROM {0} r WHERE r.volume = c.volume GROUP BY file_id HAVING count(*) > 1)) AS ids_repeated,
  count_if(parent_id <> 0 AND parent_id <> file_id AND NOT EXISTS (SELECT 1 FROM {0} p WHERE p.volume = c.volume AND p.file_id = c.parent_id)) AS parent_links_missing FROM {0} c GROUP BY volume)"""


@query("m4_deep_verify", f"WITH {DAMAGED}, twice AS (SELECT * FROM damaged UNION ALL SELECT * FROM damaged WHERE file_id % 10 = 3) SELECT volume, names_checked::BIGINT AS names_checked, ids_checked, ids_repeated, parent_links_missing::BIGINT AS parent_links_missing FROM {_DEEP.format('twice')}")
def _(spark, sf_dir):
    """Of a damaged view in which some rows stand twice."""
    rows = damaged(spark, sf_dir)
    return maintenance.deep_verify(rows.unionByName(rows.filter("file_id % 10 = 3")))


@query(
    "m7_doctor",
    f"""WITH {CATALOG}, {CHANGES}, {ATTRIBUTES}, damaged AS (SELECT * FROM catalog WHERE flags & 1 = 0 OR file_id % 2 = 0)
    SELECT c.volume, count(*) AS records, coalesce(any_value(e), 0) AS delta_entries, coalesce(any_value(u), 0) AS delta_unique, any_value(parent_links_missing)::BIGINT AS parent_links_missing,
    count(a.file_id) AS with_attributes, coalesce(any_value(e), 0) > 0 AS pending_delta FROM damaged c LEFT JOIN (SELECT volume, count(*) AS e, count(DISTINCT file_id) AS u FROM changes GROUP BY volume) d USING (volume)
    LEFT JOIN attributes a USING (volume, file_id) JOIN {_DEEP.format("damaged")} USING (volume) GROUP BY c.volume""",
)
def _(spark, sf_dir):
    """Of a base that lost some directories."""
    base = src.catalog(spark, sf_dir).filter((F.col("flags").bitwiseAND(1) == 0) | (F.col("file_id") % 2 == 0))
    return maintenance.doctor(base, src.changes(spark, sf_dir), src.attributes(spark, sf_dir))


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Positions of derived tables: attributes were built at the journal's end, content before its last tenth. Users whose
    files did not change in it are as fresh as before."""
    changes = src.changes(spark, sf_dir)
    end = changes.agg(F.max("seq").alias("end"))
    at = lambda rows: rows.groupBy(F.col("file_id").cast("string").alias("volume")).agg(F.max("seq").alias("next_usn"))
    now = at(changes)
    earlier = at(changes.crossJoin(F.broadcast(end)).filter("seq * 10 <= end * 9"))
    marks = now.withColumn("kind", F.lit("attributes")).unionByName(now.select("volume").join(earlier, "volume", "left").withColumn("kind", F.lit("content")))
    journal = F.lit(7).cast("long").alias("journal_id")
    return marks.select("volume", "kind", journal, "next_usn"), now.select("volume", journal, "next_usn")


@query(
    "m8_freshness",
    f"""WITH {CHANGES}, n AS (SELECT file_id::VARCHAR AS volume, max(seq) AS now, max(seq) FILTER (seq * 10 <= (SELECT max(seq) FROM changes) * 9) AS old FROM changes GROUP BY file_id)
    SELECT volume, 'attributes' AS kind, true AS fresh FROM n UNION ALL SELECT volume, 'content', now IS NOT DISTINCT FROM old FROM n""",
)
def _(spark, sf_dir):
    """Freshness of two derived tables for every file's own journal, as if each were a volume."""
    return maintenance.freshness(*_generations(spark, sf_dir))


@query("m9_pending", f"WITH {CHANGES} SELECT count(*) > 0 AS pending FROM changes")
def _(spark, sf_dir):
    return maintenance.pending(src.changes(spark, sf_dir))


@query("m6_maintain", f"WITH {LIVE} SELECT volume, names_checked AS records, 0::BIGINT AS delta_entries, 0::BIGINT AS delta_unique, ids_repeated, parent_links_missing::BIGINT AS parent_links_missing FROM {_DEEP.format('live')}")
def _(spark, sf_dir):
    return maintenance.maintain(src.catalog(spark, sf_dir), src.changes(spark, sf_dir))[1]


# Functions over columns


@query("f2_relevance", f"WITH {LIVE} SELECT volume, file_id, {score_sql('e')} AS score FROM live")
def _(spark, sf_dir):
    return search.scored(view(spark, sf_dir), "e").select("volume", "file_id", "score")


@query("f3_byte_distance", "SELECT p_partkey, CASE WHEN levenshtein('red-blue.dat', n) <= 6 THEN levenshtein('red-blue.dat', n)::INT END AS distance FROM (SELECT p_partkey, replace(p_name, ' ', '-') || '.dat' AS n FROM part)")
def _(spark, sf_dir):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".dat"))
    return table(spark, sf_dir, "part").select("p_partkey", names.byte_distance(F.lit("red-blue.dat"), name, 6).alias("distance"))


_LOG = "SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"))


_WORDS = r"string_split_regex(lower(q), '\s+')"
_REL = "CASE " + " ".join(f"WHEN {f'''contains(regexp_replace(lower(q), '[ -]', '', 'g'), '{inside}') OR ''' if inside else ''}list_has_any({_WORDS}, {asked}) THEN '{canonical}'" for canonical, inside, asked, _ in intent.RELATIONS) + " END"
_MEAN = "list_filter(string_split_regex(q, '[\\s,;:\"''()\\[\\]]+'), lambda t: length(t) >= 2 AND NOT list_contains(" + str(intent.STOPWORDS) + ", lower(t)))"
_PATHY = r"'[.\\/]'"
_SUBJECT = f"""coalesce({_REL}, list_filter(m, lambda t: regexp_matches(t, {_PATHY}))[1],
  list_reduce(m, lambda a, b: CASE WHEN length(b) >= length(a) THEN b ELSE a END, ''), lower(q))""".replace("list_reduce(m", "CASE WHEN len(m) > 0 THEN list_reduce(m").replace(", ''), lower(q))", ", '') END, lower(q))")


def _intent_sql() -> str:
    out = "CASE "
    for name, markers in intent.MARKERS.items():
        tests = [f"contains(lower(q), '{m}')" for m in markers] + ([f"({_REL}) IS NOT NULL"] if name == "RelatedSearch" else [])
        out += f"WHEN {' OR '.join(tests)} THEN '{name}' "
    return out + f"WHEN regexp_matches(subject, {_PATHY}) THEN 'ExactSearch' END"


@query("f14_route", f"SELECT conv_id, turn, {_intent_sql()} AS intent, subject, array_to_string(m, ' ') AS terms FROM (SELECT *, {_SUBJECT} AS subject FROM (SELECT *, {_MEAN} AS m FROM ({_LOG})))")
def _(spark, sf_dir):
    return intent.routes(_log(spark, sf_dir), "q").select("conv_id", "turn", "intent", "subject", "terms")


@query("f20_routed", f"SELECT conv_id, turn, len(list_filter(string_split_regex(q, '\\s+'), lambda t: t <> '')) >= 3 OR {' OR '.join(f'''contains(lower(q), '{m}')''' for m in intent.NATURAL)} AS routed FROM ({_LOG})")
def _(spark, sf_dir):
    return _log(spark, sf_dir).select("conv_id", "turn", intent.routed(F.col("q")).alias("routed"))


@query("f18_intent_model")
def _(spark, sf_dir):
    """Learned on conversations with an even number, applied to the others."""
    log = _log(spark, sf_dir)
    return model.classified(log.filter("conv_id % 2 = 1"), "q", model.trained_on_rules(log.filter("conv_id % 2 = 0"), "q")).drop("q")


@query("f22_lookup_name", r"SELECT page_id, substr(trim(regexp_extract(url, '[^\\/]*$')), 1, 260) AS filename FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.lookup_name(F.col("url")).alias("filename"))


_BITS = "((CASE event_type WHEN 'signup' THEN 16 WHEN 'purchase' THEN 2 WHEN 'error' THEN 4 WHEN 'click' THEN 1024 ELSE 0 END) | (user_id % 2) * 16)"


@query("f24_attribute_flags", f"SELECT event_id, (CASE WHEN {_BITS} & 16 <> 0 THEN 1 ELSE 0 END + CASE WHEN {_BITS} & 2 <> 0 THEN 2 ELSE 0 END + CASE WHEN {_BITS} & 4 <> 0 THEN 4 ELSE 0 END + CASE WHEN {_BITS} & 1024 <> 0 THEN 8 ELSE 0 END)::INT AS flags FROM events")
def _(spark, sf_dir):
    bits = F.expr("(case event_type when 'signup' then 16 when 'purchase' then 2 when 'error' then 4 when 'click' then 1024 else 0 end) | (cast(user_id % 2 as int) * 16)")
    return table(spark, sf_dir, "events").select("event_id", names.flags_of(bits).alias("flags"))


@query(
    "f25_visible_text",
    r"""SELECT page_id, array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*(>|$)', chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''),
    lambda s: replace(replace(replace(replace(replace(s, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), ' ') AS visible FROM pages""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.visible_text(F.col("html")).alias("visible"))


#: Loads by user and hour: views, events and distinct kinds of them; the busiest hour stands for a processor's load.
_LOADS = """SELECT user_id, h, n, u.total, 100 * n // u.top AS cpu, least(99, 100 * kinds // 5)::INT AS memory, gap FROM (
  SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n, count(DISTINCT event_type) AS kinds, (date_diff('millisecond', date_trunc('hour', ts), min(ts)))::BIGINT AS gap FROM events GROUP BY 1, 2)
  JOIN (SELECT user_id, max(n) AS top, sum(n)::BIGINT AS total FROM (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) u USING (user_id)"""


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, hour, n, total, cpu, memory, gap): each user's events by the hour, in percent of that user's busiest hour and of
    the kinds of events, and the milliseconds before the hour's first."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    first = (F.unix_millis(F.min(F.col("ts").cast("timestamp"))) - F.unix_millis(F.col("hour"))).alias("gap")
    hours = table(spark, sf_dir, "events").select("user_id", hour.alias("hour"), "ts", "event_type").groupBy("user_id", "hour").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), first)
    users = hours.groupBy("user_id").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return hours.join(users, "user_id").select("user_id", "hour", "n", "total", F.floor(100 * F.col("n") / F.col("top")).cast("int").alias("cpu"), F.least(F.lit(99), F.floor(100 * F.col("kinds") / 5)).cast("int").alias("memory"), "gap")


@query("f28_governor", f"SELECT user_id, epoch_ms(h) AS hour_ms, CASE WHEN memory >= 88 OR cpu >= 55 THEN 'Pause' WHEN total % 2 = 1 AND gap < 1500 THEN 'Pause' WHEN cpu >= 30 THEN 'Throttle' ELSE 'Run' END AS decision FROM ({_LOADS})")
def _(spark, sf_dir):
    """What a background job may do in each hour under a user's load; users with an even number of events count as idle."""
    rows = loads(spark, sf_dir)
    work = F.when(F.col("total") % 2 == 1, "BackgroundIndex").otherwise("MetadataUpdate")
    decision = safety.governor(work, F.col("cpu"), F.col("memory"), F.col("gap"), F.lit(False))
    return rows.select("user_id", F.unix_millis("hour").alias("hour_ms"), decision.alias("decision"))


@query("f28_permitted", f"SELECT user_id, epoch_ms(h) AS hour_ms, CASE WHEN n = 1 THEN 'Run' WHEN total % 2 = 0 AND gap < 5000 THEN 'Pause' WHEN memory >= 88 OR cpu >= 55 OR gap < 1500 THEN 'Pause' WHEN cpu >= 30 THEN 'Throttle' ELSE 'Run' END AS decision FROM ({_LOADS})")
def _(spark, sf_dir):
    rows = loads(spark, sf_dir)
    decision = safety.permitted(F.when(F.col("n") == 1, "Cheap").otherwise("Expensive"), F.when(F.col("total") % 2 == 0, "Hdd").otherwise("Ssd"), F.col("cpu"), F.col("memory"), F.col("gap"), F.lit(False))
    return rows.select("user_id", F.unix_millis("hour").alias("hour_ms"), decision.alias("decision"))


_URI = "'search:?query=' || replace(p_name, ' ', '%20') || '&crumb=location:C%3A%5C' || replace(p_brand, '#', '%23') || '%5C'"


@query("f21_search_links", f"SELECT p_partkey, url_decode(regexp_extract(u, 'query=([^&]*)', 1)) AS query, rtrim(url_decode(regexp_extract(u, 'location:([^&]*)', 1)), chr(92)) AS scope FROM (SELECT p_partkey, {_URI} AS u FROM part)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", uri.parsed(F.expr(_URI)).alias("u")).select("p_partkey", "u.query", "u.scope")


_NAME = r"substr(trim(regexp_extract(url, '[^\\/]*$')), 1, 260)"
_LOOKUP = f"concat_ws(' ', {_NAME}, CASE WHEN page_id % 3 > 0 THEN 'publisher' || page_id % 3 END, nullif(regexp_extract(url, '://([^/]*)', 1), ''), CASE WHEN page_id % 2 > 0 THEN '2.0' END)"


@query("f23_lookup_text", f"SELECT page_id, {_LOOKUP} AS lookup, count(*) OVER (PARTITION BY {_LOOKUP}) AS sharing FROM pages")
def _(spark, sf_dir):
    """Texts of lookups, and how many pages share their cache key: as many as share the text."""
    publisher = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("publisher"), (F.col("page_id") % 3).cast("string")))
    text = web.search_text(F.col("url"), publisher, F.regexp_extract("url", "://([^/]*)", 1), F.when(F.col("page_id") % 2 > 0, "2.0"))
    rows = table(spark, sf_dir, "pages").select("page_id", text.alias("lookup")).withColumn("key", web.cache_key(F.col("lookup")))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("sharing")), "key").drop("key")


@query("x2_extracted_text", f"SELECT page_id, CASE WHEN page_id % 6 = 4 THEN regexp_replace(trim(visible), '\\s+', ' ', 'g') ELSE visible END AS text FROM ({SQL['f25_visible_text']})")
def _(spark, sf_dir):
    """Pages inside documents of six kinds, of several parts and encodings, read back from the documents' bytes; rich text has no
    runs of blanks."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return files.extracted(files.packaged(pages, "page_id", "html"), "page_id", "name", "content")


def web_answers(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, answer) as a web search would give pages in JSON: each with its whole text and, after every seventh, one item
    without a title and one more."""
    items, link, snippet, _ = web.FORMATS[kind]
    item = F.struct(F.col("url").alias("title"), F.col("url").alias(link), F.col("html").alias(snippet))
    bad = F.struct(F.lit(None).cast("string").alias("title"), F.col("url").alias(link), F.col("html").alias(snippet))
    return pages.select("page_id", F.to_json(F.struct(F.when(F.col("page_id") % 7 == 0, F.array(item, item, bad, item)).otherwise(F.array(item, item, item, item, item, item)).alias(items))).alias("answer"))


def web_results(pages: DataFrame, kind: str = "custom") -> DataFrame:
    """(page_id, title, link, snippet) of the first five whole items of each answer."""
    return web_answers(pages, kind).select("page_id", F.inline(web.answers(F.col("answer"), kind)))


_RESULTS = "SELECT page_id, url AS link, url AS title, html AS snippet FROM (SELECT *, unnest(range(CASE WHEN page_id % 7 = 0 THEN 2 ELSE 5 END)) FROM pages)"


@query("s19_web_results", _RESULTS)
def _(spark, sf_dir):
    return web_results(table(spark, sf_dir, "pages"))


@query("s19_web_results_meta", _RESULTS)
def _(spark, sf_dir):
    return web_results(table(spark, sf_dir, "pages"), "meta")


_PAGE_NAME = "substr(trim(regexp_extract(url, '[^\\\\/]*$')), 1, 260)"


@query("s18_web_cache", f"SELECT max(page_id) AS last_page, arg_max(url, page_id) AS url FROM pages GROUP BY {_PAGE_NAME}")
def _(spark, sf_dir):
    cache = web.latest(web.page_cache(spark, sf_dir))
    return cache.select(F.col("seq").alias("last_page"), F.col("results")[0]["link"].alias("url"))


@query("q14_web_lookup", f"SELECT f.doc_id, p.url AS link FROM (SELECT doc_id, (doc_id % 1000)::VARCHAR AS target FROM documents) f LEFT JOIN (SELECT {_PAGE_NAME} AS target, arg_max(url, page_id) AS url FROM pages GROUP BY 1) p USING (target)")
def _(spark, sf_dir):
    """What the cache of answers has for a page named by each document's number; nothing is asked of a network."""
    asked = table(spark, sf_dir, "documents").select("doc_id", web.cache_key(web.search_text(F.concat(F.lit("C:\\pages\\"), (F.col("doc_id") % 1000).cast("string")))).alias("key"))
    return asked.join(web.latest(web.page_cache(spark, sf_dir)), "key", "left").select("doc_id", F.col("results")[0]["link"].alias("link"))


# Streaming


@query("t1_journal_stream", f"WITH {CHANGES} SELECT * FROM latest")
def _(spark, sf_dir):
    """The journal read as a stream until all of it is in; its state equals the batch's."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = stream.journal_stream(spark, f"{path}*", schema)
    started = stream.ingest(rows, f"{home}/changes", f"{home}/checkpoint")
    if not started.awaitTermination(3600):
        started.stop()
        raise TimeoutError("the journal was not read within an hour")
    return stream.state(spark, f"{home}/changes")


def _logged(spark: SparkSession, records: DataFrame, path: str, journal: str) -> str:
    """A raw log of journal records below a shared folder."""
    journal_log.append(records, path, journal)
    return path


def _caught_up(started) -> None:
    """Wait until a stream has read all there is, and stop it."""
    started.processAllAvailable()
    started.stop()


@query("s2_journal_log", f"WITH {CHANGES} SELECT * FROM changes")
def _(spark, sf_dir):
    """The journal written as a raw log, and read back by the data source."""
    records = src.timed_journal(table(spark, sf_dir, "events"))
    path = _logged(spark, records, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", "first")
    journal_log.register(spark)
    return src.changes_of(spark.read.format("journal").option("path", path).load())


@query("t3_keyed_state", f"WITH {CHANGES} SELECT * FROM latest")
def _(spark, sf_dir):
    """The journal followed as a stream with keyed state, stopped at its half and started again, in batches of a tenth."""
    home = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    records = src.timed_journal(table(spark, sf_dir, "events"))
    half = (records.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (records.filter(F.col("seq") < half), records.filter(F.col("seq") >= half)):
        log = _logged(spark, part, f"{home}/log", "first")
        _caught_up(stream.follow(stream.log_stream(spark, log, max(half // 5, 1)), f"{home}/checkpoint"))
    return stream.kept_state(spark, f"{home}/checkpoint")


@query("t5_state_after_reset", f"WITH {CHANGES} SELECT * FROM latest")
def _(spark, sf_dir):
    """A followed journal is replaced by another: its stream stops with JournalReset, and a new one follows the other from its
    beginning."""
    home = f"{shared_dir(spark)}/reset-{uuid.uuid4().hex}"
    records = src.timed_journal(table(spark, sf_dir, "events"))
    log = _logged(spark, records.filter("seq % 2 = 0"), f"{home}/log", "first")
    _caught_up(stream.follow(stream.log_stream(spark, log), f"{home}/checkpoint"))
    records.limit(0).select(F.lit("").alias("value")).write.mode("overwrite").text(log)
    _logged(spark, records, log, "second")
    return stream.followed_or_rebuilt(spark, log, f"{home}/checkpoint", f"{home}/again")


def queries() -> dict[str, Query]:
    from . import service_queries  # noqa: F401  registers its own

    for name, f in QUERIES.items():
        f.__name__ = name
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import service_queries  # noqa: F401

    return dict(SQL)
