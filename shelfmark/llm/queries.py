"""One registered query for each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, fim, media, mixing, near, periods, pieces, pii, rlz, rules, substring_sa, topk
from .base import table

Query = Callable[[SparkSession, str], DataFrame]

#: The chat operator's control conversation: its texts hold the template's own marks.
CONTROL = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_sa.deduplicated(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scored(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), piece_model())


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.text_media(table(spark, sf_dir, "documents")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(rows.unionByName(control)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op10_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.deduplicated(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.found(table(spark, sf_dir, "documents"), rewriting=periods.planted))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(topk.index(rows, "vec_id", "embedding"), rows.filter("vec_id % 100 = 0"), "vec_id", "embedding")


def queries() -> dict[str, Query]:
    found = [op1_source_mixing, op2_suffix_array_dedup, op3_quality_rules, op4_minhash_near_dedup, op5_quality_classifier, op6_sentencepiece, op7_media_columns, op8_chat_formatting, op9_pii, op10_relative_lempel_ziv, op11_fill_in_middle, op12_periodic_runs, op13_exact_top_k]
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, len({WORDS})::BIGINT AS n_tokens, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens)::DOUBLE AS b, list(tokens::DOUBLE) FILTER (tokens > 0) AS ts FROM s),
p AS (SELECT b, ts, list_transform(ts, lambda x: x / b) AS ps FROM t),
bis AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 4.0::DOUBLE AS high UNION ALL
        SELECT k + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
          SELECT k, low, high, mid, ln(z) - mid * e / z <= 0.9 * ln(len(ps)) AND r / z * b <= 4.0 AS ok FROM (
            SELECT k, low, high, (low + high) / 2 AS mid, b, ps, list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) AS z,
                   list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2) * ln(x))) AS e,
                   list_max(list_transform(ts, lambda x: pow(x / b, (low + high) / 2) / x)) AS r
            FROM bis, p WHERE k < 42))),
x AS (SELECT round(high, 6) AS x FROM bis WHERE k = 42),
w AS (SELECT source, n_docs, tokens, CASE WHEN tokens > 0 THEN pow(tokens / b, x) ELSE 0 END AS f, b FROM s, t, x),
g AS (SELECT *, floor(f / (SELECT sum(f) FROM w) * b)::BIGINT AS goal FROM w),
q AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN goal // tokens ELSE 0 END AS passes, CASE WHEN tokens > 0 THEN goal % tokens ELSE goal END AS rest,
      least(ceil(n_docs / 256), 65536)::BIGINT AS n_blocks FROM g),
pl AS (SELECT d.*, passes, rest, ('0x' || substr(key, 1, 8))::BIGINT % n_blocks AS block FROM d JOIN q USING (source)),
bl AS (SELECT source, block, passes, rest, sum(n_tokens) AS n, md5(source || ':' || block || ':' || passes) AS spot FROM pl GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY spot, block ROWS UNBOUNDED PRECEDING) AS upto FROM bl),
dd AS (SELECT pl.*, cu.spot, cu.upto - cu.n AS before, sum(pl.n_tokens) OVER (PARTITION BY pl.source, pl.block ORDER BY key RANGE UNBOUNDED PRECEDING) AS within
       FROM pl JOIN cu USING (source, block)),
c AS (SELECT *, passes + CASE WHEN rest > 0 AND before <= rest AND before + within <= rest THEN 1 ELSE 0 END AS copies FROM dd)
SELECT doc_id, source, n_tokens, pass::INT AS pass, block, md5(source || ':' || block || ':' || pass) AS block_key
FROM (SELECT *, unnest(range(0, copies)) AS pass FROM c)
"""

OP2 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, octet_length(b) - 49)) AS p FROM d)),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) AS before FROM m)),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes,
       coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: z[i] - a[i])), 0)::BIGINT AS n_removed,
       coalesce(len(a), 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN h ELSE
         array_to_string(list_transform(range(1, len(a) + 2), lambda i:
           substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END) + 1,
                  2 * ((CASE WHEN i > len(a) THEN octet_length(b) ELSE a[i] END) - (CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (
        SELECT doc_id, i, list_slice(w, i, i + 2) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM tri WHERE c > 1) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u, count_if(regexp_matches(l, '^[\\x20\\x09-\\x0D]*(-|\\*|•)')) AS bullets,
        count_if(regexp_matches(l, '([.]{{3}}|…)[\\x20\\x09-\\x0D]*$')) AS ellipses FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(lin.n - lin.u, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lin.n, 0) AS n_lines,
      coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses, coalesce(top.n, 0) AS most_common,
      len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS lettered,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
      FROM d LEFT JOIN lin USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN top USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > 10 * n_words OR n_dup_lines * 100 > 40 * greatest(n_lines, 1)
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * capitals > letters OR 100 * lettered < 60 * n_words
            OR 100 * bullets > 90 * greatest(n_lines, 1) OR 100 * ellipses > 30 * greatest(n_lines, 1) OR 100 * most_common > 50 * n_words) AS kept
FROM f
"""

_ESCAPED = r"regexp_extract_all({}, '<\\*\|')"
OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(text) + len({_ESCAPED.format("r")}) + len({_ESCAPED.format("text")}) + {len("<|im_start|>") + len("<|im_end|>") + 2})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, p, list_slice(w, p, p + 34) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM x) WHERE c > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 35 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) AS before FROM m)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 35 AS z FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: z[i] - a[i])), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN a IS NULL THEN w ELSE flatten(list_transform(range(1, len(a) + 2), lambda i:
         list_slice(w, CASE WHEN i = 1 THEN 1 ELSE z[i - 1] END, (CASE WHEN i > len(a) THEN len(w) ELSE a[i] - 1 END)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

OP11 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  list_transform(range(0, 4), lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 8 * k + 1, 8))::BIGINT) AS h FROM documents),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

#: Equal words q apart, for each q in stretches of successive places; a stretch that two distances give has the smaller period.
OP12 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM g),
o AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM x)),
e AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM o l JOIN o r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.word = r.word AND r.i > l.i),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 1 + q AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, stop, min(q) AS q FROM s WHERE stop - start >= greatest(12, 2 * q) GROUP BY doc_id, start, stop),
y AS (SELECT doc_id, count(*) AS n_runs, min({{'less': start - stop, 'start': start, 'q': q}}) AS best, string_agg(start || ',' || (stop - start) || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, stop)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM o ANTI JOIN gone ON o.doc_id IS NOT DISTINCT FROM gone.doc_id AND o.i = gone.i GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, (-best.less)::BIGINT AS length, best.q::BIGINT AS period, (-1000 * best.less // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN y ON x.doc_id IS NOT DISTINCT FROM y.doc_id LEFT JOIN k ON x.doc_id IS NOT DISTINCT FROM k.doc_id
"""

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding))
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INT AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1, "op2_suffix_array_dedup": OP2, "op3_quality_rules": OP3, "op8_chat_formatting": OP8, "op10_relative_lempel_ziv": OP10, "op11_fill_in_middle": OP11, "op12_periodic_runs": OP12, "op13_exact_top_k": OP13}
