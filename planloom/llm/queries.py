"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import math

from planloom.llm import bytecnn, decontamination, licenses, linededup, packing, rules, sharding, simhash, urltrust, warc
from planloom.llm.common import table


#: Rounds after which the SQL of op5 has spread all but 0.85 ** 150 of the trust.
SPREAD_ROUNDS = 150
#: The public vocabulary with which op1 and the pipeline pack.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares(spark, sf_dir):
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary_path()))


def op2_byte_network(spark, sf_dir):
    return bytecnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_adaptive_rules(spark, sf_dir):
    return rules.judge(table(spark, sf_dir, "documents")).drop("failed")


def op4_ring_shards(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op5_link_trust(spark, sf_dir):
    return urltrust.judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op6_suffix_arrays(spark, sf_dir):
    return decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op7_transactions(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_line_dedup(spark, sf_dir):
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op9_simhash_tiles(spark, sf_dir):
    return simhash.fingerprint_digests(table(spark, sf_dir, "documents"))


def op10_license_signatures(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


#: DuckDB strips these with trim's second argument, and lower-cases A-Z only with translate.
_ASCII_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_ASCII_SPACE})")} AS k FROM lines
), seen AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= {linededup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT y.doc_id, y.pos, y.line, coalesce(y.doc_id > s.first_doc, false) AS lost FROM keyed y LEFT JOIN seen s ON y.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _op3_sql() -> str:
    spread = "CASE measure " + " ".join(f"WHEN '{k}' THEN {s}" for k, (s, _) in rules.MEASURES.items()) + " END"
    both = ", ".join(f"'{k}'" for k, (_, b) in rules.MEASURES.items() if b)
    value = f"CASE WHEN b = -100000 THEN 0 ELSE pow({rules.GAMMA}, b) * {2 / (1 + rules.GAMMA)!r} END"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT r, doc_id, lang, source, length(t) - length(regexp_replace(t, '{rules.SYMBOLS}', '', 'g')) AS n_symbols,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM texts
), grams AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + {rules.WINDOW - 1}), ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - {rules.WINDOW - 1})) AS i FROM split)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range({rules.WINDOW}) s(k) GROUP BY r
), counts AS (
  SELECT s.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM split s LEFT JOIN covered c ON s.r = c.r
), long AS (
  SELECT r, lang, source, n_words, unnest(['symbols_per_word', 'dup_line_share', 'repeat_share', 'mean_word_length']) AS measure,
    unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS v FROM counts
), sketch AS (
  SELECT lang, source, measure, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {math.log(rules.GAMMA)!r}) AS INT) ELSE -100000 END AS b, count(*) AS n FROM long WHERE n_words > 0 GROUP BY ALL
), levels AS (
  SELECT 'source' AS level, lang, source, measure, b, n FROM sketch
  UNION ALL SELECT 'lang', lang, '', measure, b, sum(n) FROM sketch GROUP BY lang, measure, b
  UNION ALL SELECT 'all', '', '', measure, b, sum(n) FROM sketch GROUP BY measure, b
), ranked AS (
  SELECT *, {value} AS v, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels
), quartiles AS (
  SELECT level, lang, source, measure, max(total) AS n, min(v) FILTER (upto >= 0.25 * total) AS q25, min(v) FILTER (upto >= 0.5 * total) AS q50, min(v) FILTER (upto >= 0.75 * total) AS q75
  FROM ranked GROUP BY level, lang, source, measure
), fences AS (
  SELECT level, lang, source, measure, n, q75 + {rules.REACH} * greatest(q75 - q50, {spread}) AS high, CASE WHEN measure IN ({both}) THEN q25 - {rules.REACH} * greatest(q50 - q25, {spread}) END AS low FROM quartiles
), chosen AS (
  SELECT s.lang, s.source, s.measure, CASE WHEN s.n >= {rules.MIN_ROWS} THEN s.high WHEN l.n >= {rules.MIN_ROWS} THEN l.high ELSE a.high END AS high,
    CASE WHEN s.n >= {rules.MIN_ROWS} THEN s.low WHEN l.n >= {rules.MIN_ROWS} THEN l.low ELSE a.low END AS low
  FROM fences s JOIN fences l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure JOIN fences a ON a.level = 'all' AND a.measure = s.measure WHERE s.level = 'source'
), outside AS (
  SELECT r, bool_or(v > high OR coalesce(v < low, false)) AS bad FROM long x JOIN chosen c ON x.lang IS NOT DISTINCT FROM c.lang AND x.source IS NOT DISTINCT FROM c.source AND x.measure = c.measure GROUP BY r
), based AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM based b LEFT JOIN outside o ON b.r = o.r
"""


def _op5_sql() -> str:
    fits = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{}}" for r in sorted(urltrust.RULES, key=lambda r: -len(r.text))
    ) + " END"
    ordered = sorted(urltrust.RULES, key=lambda r: -len(r.text))
    rule, verdict = fits.format(*[f"'{r.text}'" for r in ordered]), fits.format(*[f"'{r.verdict}'" for r in ordered])
    link = urltrust.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE urls AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), ruled AS (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM urls
), links AS (
  SELECT src, dst, count(*) AS w FROM (SELECT host AS src, {_LOWER.format("unnest(list_distinct(regexp_extract_all(html, '" + link + "', 1)))")} AS dst FROM urls)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), hosts AS (
  SELECT DISTINCT host FROM urls WHERE host <> ''
), above AS (
  SELECT h.host, arg_min(u.host, h.i) AS up FROM (SELECT host, i, array_to_string(list_slice(string_split(host, '.'), i, 1000), '.') AS up
    FROM (SELECT host, unnest(generate_series(2, greatest(len(string_split(host, '.')), 2))) AS i FROM hosts)) h JOIN hosts u ON h.up = u.host GROUP BY h.host
), edges AS (
  SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT host, up, 1 FROM above UNION ALL SELECT up, host, 1 FROM above) GROUP BY src, dst
), one AS (
  SELECT src, dst, w, 'trust' AS kind FROM edges UNION ALL SELECT dst, src, w, 'distrust' FROM edges
), steps AS (
  SELECT src, dst, kind, w / sum(w) OVER (PARTITION BY src, kind) AS share FROM one
), seeds AS (
  SELECT host, CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM ruled WHERE rule IS NOT NULL GROUP BY ALL
), terms AS (
  SELECT host, kind, n / sum(n) OVER (PARTITION BY kind) AS v, 0 AS k FROM seeds
  UNION ALL SELECT s.dst, s.kind, sum({urltrust.DAMPING} * v * share), min(k) + 1 FROM terms t JOIN steps s ON t.host = s.src AND t.kind = s.kind WHERE k < {SPREAD_ROUNDS} GROUP BY s.dst, s.kind
), scored AS (
  SELECT host, coalesce(sum(v) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(v) FILTER (kind = 'distrust'), 0) AS distrust FROM terms GROUP BY host
)
SELECT page_id, u.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {(1 + urltrust.MARGIN) * urltrust.THRESHOLD!r} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled u LEFT JOIN scored s ON u.host = s.host
"""


OP7_SQL = f"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS s FROM pages
), firsts AS (
  SELECT s, min(page_id) AS first FROM d WHERE n >= {warc.MIN_BYTES} GROUP BY s
)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN firsts f ON d.s = f.s
"""

OP6_SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least({decontamination.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)
), grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM sized) s)
), found AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM grams d JOIN windows t ON d.n = t.n AND d.g = t.g
), hits AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), range({decontamination.WINDOW}) r(k) WHERE k < n GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""

QUERIES = {
    "op1_sum_of_squares": op1_sum_of_squares,
    "op2_byte_network": op2_byte_network,
    "op3_adaptive_rules": op3_adaptive_rules,
    "op4_ring_shards": op4_ring_shards,
    "op5_link_trust": op5_link_trust,
    "op6_suffix_arrays": op6_suffix_arrays,
    "op7_transactions": op7_transactions,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_tiles": op9_simhash_tiles,
    "op10_license_signatures": op10_license_signatures,
}
ORACLES: dict[str, str] = {
    "op3_adaptive_rules": _op3_sql(),
    "op5_link_trust": _op5_sql(),
    "op6_suffix_arrays": OP6_SQL,
    "op7_transactions": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
}
