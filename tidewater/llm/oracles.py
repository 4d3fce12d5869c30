"""DuckDB SQL for those corpus queries that SQL can express.

Limits and patterns are stated here again rather than imported from the
operators; only the lists of licence sentences and rules are shared, as data.
"""

from __future__ import annotations

import re

from tidewater.llm.licenses import RULES, SENTENCES

_W = r"[\x20\x09-\x0D]"
_NW = r"[^\x20\x09-\x0D]"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# --- licence scans -----------------------------------------------------------
# The sentence and rule lists are data and enter as VALUES; they are normalised
# here by SQL. Every text is cut, not only those with a cue. RE2 has no look-
# around: the dot of "v. 2" is masked, and line ends are doubled so that known
# stretches of lines can take their own.
_LOWER = "translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORM = "trim(regexp_replace(" + _LOWER + ", '[^a-z0-9]+', ' ', 'g'))"
_PLAIN = {re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ") for _, s in SENTENCES}
_STRETCH = "|".join(k.replace(" ", r"(?: |\n\n)") for k in sorted(_PLAIN, key=len, reverse=True))
LICENSE_SCAN = rf"""
WITH RECURSIVE known AS (
  SELECT DISTINCT name, {_NORM.format(s="s")} AS n FROM (VALUES {_values([*SENTENCES])}) AS t(name, s)
), rules AS (
  SELECT * FROM (VALUES {_values([(k, licence, "".join(f"[{i}]" for i in ids)) for k, (licence, ids) in enumerate(RULES)])}) AS t(k, licence, ids)
), uncommented AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(coalesce(text, ''), '(?m)^([ \t]*)(?:[#*;%!/>''"|<-]+|@?(?:REM|rem)|dnl)([ \t\r]|$)', '\1*\2', 'g') AS t FROM documents
), unlisted AS (
  SELECT r, regexp_replace(t, '(?m)(^[ \t*]*|[:;.][ \t]+)\(?([0-9]{{1,2}}|[A-Za-z]|[ivx]{{2,4}})[.)][ \t]+', E'\\1*\n\\2\n', 'g') AS t FROM uncommented
), masked AS (
  SELECT r, regexp_replace(t, '(\b[vV])\.([ \t\r\n*]+[0-9])', E'\\1\x01\\2', 'g') AS t FROM unlisted
), lists AS (
  SELECT r, regexp_split_to_array(t, '[.!?]+[ \t\r\n]+|\n[ \t\r]*\n') AS l FROM masked
), blocks AS (
  SELECT r, unnest(l) AS block, generate_subscripts(l, 1) AS i FROM lists
), whole AS (
  SELECT b.r, b.i, b.block, k.name FROM blocks b LEFT JOIN known k ON k.n = {_NORM.format(s="b.block")}
), cut AS (
  SELECT r, i, regexp_replace(regexp_replace(chr(10) || regexp_replace({_LOWER.format(s="block")}, '[^a-z0-9\n]+', ' ', 'g') || chr(10), '[ \n]*\n[ \n]*', E'\n\n', 'g'),
         '\n({_STRETCH})\n', E'\x02\\1\x02', 'g') AS t
  FROM whole WHERE name IS NULL AND contains(block, chr(10))
), parts AS (
  SELECT r, i, unnest(string_split(t, E'\x02')) AS part, generate_subscripts(string_split(t, E'\x02'), 1) AS j FROM cut
), named AS (
  SELECT r, i, 0 AS j, coalesce(name, '-') AS name FROM whole WHERE name IS NOT NULL OR NOT contains(block, chr(10))
  UNION ALL SELECT p.r, p.i, p.j, k.name FROM parts p JOIN known k ON k.n = replace(p.part, E'\n\n', ' ') WHERE p.j % 2 = 0
  UNION ALL SELECT r, i, j, '-' FROM parts WHERE j % 2 = 1 AND NOT regexp_full_match(part, '(?:\n+(?:[0-9]{{1,2}}|[a-z]|[ivx]{{2,4}}))*\n*')
), seqs AS (
  SELECT r, regexp_replace(string_agg('[' || name || ']', '' ORDER BY i, j), '(\[-\])+', '[-]', 'g') AS seq
  FROM named GROUP BY r HAVING bool_or(name <> '-')
), folded AS (
  SELECT r, 0 AS k, seq AS rest, '' AS hits FROM seqs
  UNION ALL
  SELECT f.r, f.k + 1, replace(f.rest, u.ids, '[+]'),
         CASE WHEN contains(f.rest, u.ids) AND NOT contains(f.hits || ',', ',' || u.licence || ',') THEN f.hits || ',' || u.licence ELSE f.hits END
  FROM folded f JOIN rules u ON u.k = f.k
), last AS (
  SELECT r, rest, ltrim(hits, ',') AS licenses FROM folded WHERE k = {len(RULES)}
)
SELECT d.doc_id, coalesce(len(regexp_extract_all(s.seq, '\[[A-Za-z]')), 0)::BIGINT AS n_known, coalesce(s.seq, '') AS sentence_ids,
       coalesce(f.licenses, '') AS licenses, coalesce(len(regexp_extract_all(f.rest, '\[[A-Za-z]')), 0)::BIGINT AS n_unmatched
FROM uncommented d LEFT JOIN seqs s USING (r) LEFT JOIN last f USING (r)
"""

# --- quality rules -----------------------------------------------------------
_PUNCT = r"[!-/:-@\[-`{-~]"
_BEYOND = r"[^\x00-\x7F]"


def _held(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


_JS = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))"
QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_NW}+') AS w FROM documents
), base AS (
  SELECT doc_id, lang, length(t) AS size, len(w)::BIGINT AS n_words, {_held("[#*$%&|<>]")} AS n_symbols,
         {_held("[A-Z]")} AS upper, {_held("[0-9]")} AS digit, {_held(_W)} AS blank,
         {_held(_PUNCT)} AS punct, {_held(_BEYOND)} AS beyond
  FROM d
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_NW}') GROUP BY doc_id
), word AS (
  SELECT doc_id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), three AS (
  SELECT doc_id, i, x, lead(x, 1) OVER v AS y, lead(x, 2) OVER v AS z FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM three WHERE z IS NOT NULL
), rep AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) AS t(o) WHERE n > 1 GROUP BY doc_id
), bins AS (
  SELECT doc_id, lang, size, unnest([size - upper - digit - blank - punct - beyond, upper, digit, blank, punct, beyond]) AS n, unnest([1, 2, 3, 4, 5, 6]) AS bin FROM base
), spoken AS (
  SELECT lang AS of, * EXCLUDE (lang) FROM bins WHERE lang IS NOT NULL UNION ALL SELECT NULL, * EXCLUDE (lang) FROM bins
), class_ref AS (
  SELECT of, bin, sum(n)::DOUBLE / sum(size)::DOUBLE AS q FROM spoken GROUP BY of, bin HAVING sum(size) > 0
), class_js AS (
  SELECT b.doc_id, {_JS} AS js FROM (SELECT doc_id, n::DOUBLE / size AS p, q FROM bins JOIN class_ref ON lang IS NOT DISTINCT FROM of AND bins.bin = class_ref.bin WHERE size >= 200) b GROUP BY doc_id
), counted AS (
  SELECT lang, x, count(*) AS n FROM word GROUP BY lang, x
), each AS (
  SELECT lang AS of, x, n FROM counted WHERE lang IS NOT NULL UNION ALL SELECT NULL, x, sum(n)::BIGINT FROM counted GROUP BY x
), totals AS (
  SELECT of, sum(n) AS total FROM each GROUP BY of
), common AS (
  SELECT r.of, x, n::DOUBLE / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY of ORDER BY n DESC, x) AS r FROM each) r JOIN totals t ON r.of IS NOT DISTINCT FROM t.of WHERE r.r <= 40
), mine AS (
  SELECT doc_id, x, count(*) AS n FROM word GROUP BY doc_id, x
), pq AS (
  SELECT b.doc_id, coalesce(m.n, 0)::DOUBLE / b.n_words AS p, c.q FROM base b JOIN common c ON b.lang IS NOT DISTINCT FROM c.of LEFT JOIN mine m ON m.doc_id = b.doc_id AND m.x = c.x WHERE b.n_words >= 100
), pq_rest AS (
  SELECT doc_id, p, q FROM pq UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM pq GROUP BY doc_id
), word_js AS (
  SELECT doc_id, {_JS} AS js FROM pq_rest GROUP BY doc_id
), r AS (
  SELECT b.doc_id, b.n_words, (size - blank)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, c.js AS cjs, w.js AS wjs
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN class_js c USING (doc_id) LEFT JOIN word_js w USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       round(cjs, 6) AS class_distance, round(wjs, 6) AS word_distance,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(cjs, 0) <= 0.2 AND coalesce(wjs, 0) <= 0.35 AS kept
FROM r
"""

# --- exact dedup -------------------------------------------------------------
EXACT_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_W}', '', 'g')) AS h FROM documents
), r AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS c, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep FROM d
)
SELECT doc_id, keep AS keep_id, c::BIGINT AS group_size, doc_id = keep AS kept, h AS text_sha256 FROM r
"""

# --- mixing ------------------------------------------------------------------
# The level is found by trying every source as the first that isn't full.
SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NW}+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), levels AS (
  SELECT a.source_size * 3.0 / a.weight AS full_at,
         sum(CASE WHEN b.source_size * 3.0 / b.weight < a.source_size * 3.0 / a.weight THEN b.source_size * 3 ELSE 0 END) AS used,
         sum(CASE WHEN b.source_size * 3.0 / b.weight < a.source_size * 3.0 / a.weight THEN 0 ELSE b.weight END) AS weights,
         sum(b.source_size) AS everything
  FROM s a CROSS JOIN s b GROUP BY a.source, a.source_size, a.weight
), level AS (
  SELECT (everything - used)::BIGINT AS num, weights::BIGINT AS den FROM levels
  WHERE full_at * weights > everything - used ORDER BY full_at LIMIT 1
), t AS (
  SELECT s.source, source_size, CASE WHEN source_size * 3 * den <= weight * num THEN (source_size * 3)::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target
  FROM s LEFT JOIN level ON true
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), q AS (
  SELECT d.doc_id, d.size, p.source, source_size, target, whole, target - whole * source_size AS rest, floor(sqrt(d.size))::DOUBLE AS odd,
         (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), classes AS (
  SELECT source, odd, rest, sum(size)::BIGINT AS words, odd * sum(size)::BIGINT AS mass FROM q GROUP BY source, odd, rest
), cumulated AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY odd DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
         sum(mass) OVER (PARTITION BY source ORDER BY odd ROWS UNBOUNDED PRECEDING) AS upto FROM classes
), judged AS (
  SELECT *, rest > 0 AND words > 0 AND odd * (rest - above) >= upto AS certain FROM cumulated
), opened AS (
  SELECT *, rest - coalesce(sum(words) FILTER (WHERE certain) OVER w, 0)::BIGINT AS room, coalesce(sum(mass) FILTER (WHERE NOT certain) OVER w, 0.0) AS open
  FROM judged WINDOW w AS (PARTITION BY source)
), chances AS (
  SELECT source, odd, certain, room, p / greatest(1 - p, 1e-300) AS odds FROM (SELECT *, CASE WHEN open > 0 THEN room / open * odd ELSE 0.0 END AS p FROM opened)
), ranked AS (
  SELECT q.*, c.certain, c.room, u / (u + c.odds * (1 - u)) AS rank FROM q JOIN chances c ON q.source IS NOT DISTINCT FROM c.source AND q.odd = c.odd
), r AS (
  SELECT *, CASE WHEN certain THEN true ELSE 2 * sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY certain, rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size <= 2 * room END AS extra
  FROM ranked
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

# --- URL filters -------------------------------------------------------------
_HOST = r"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_QUERY = r"regexp_extract({u}, '^[^?#]*(\?[^#]*)?', 1)"
_SCHEME = r"translate(split_part({u}, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WALK = ("list_reduce(list_prepend('', string_split(substr({p}, 2), '/')), lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
         " || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END")


def _node(u: str) -> str:
    path = _PATH.format(u=u)
    whole = f"coalesce(nullif(CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {_WALK.format(p=path)} ELSE {path} END, ''), '/')"
    return f"CASE WHEN contains({u}, '://') THEN {_SCHEME.format(u=u)} || '://' || {_HOST.format(u=u)} || {whole} || {_QUERY.format(u=u)} END"


_RULES = "(VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, rh, rp)"
_FITS = "(n.host = t.rh OR ends_with(n.host, '.' || t.rh)) AND starts_with(n.path, t.rp)"
_BEST = "{which}(t.{col}, length(t.rh || t.rp))"

URL_FILTER = rf"""
WITH RECURSIVE pg AS (
  SELECT page_id, url, html, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path, {_node('url')} AS node FROM pages
), tags AS (
  SELECT url, node, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*>')) AS tag, 1 AS kind FROM pg
  UNION ALL SELECT url, node, unnest(regexp_extract_all(html, '(?i)<meta\s[^>]*>')), 2 FROM pg
), hrefs AS (
  SELECT url, node, replace(CASE kind WHEN 1 THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END, '&amp;', '&') AS href
  FROM tags WHERE (kind = 1 AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')) OR (kind = 2 AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh\b'))
), dst AS (
  SELECT node AS a, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN href
    WHEN starts_with(href, '//') THEN split_part(node, '://', 1) || ':' || href
    WHEN starts_with(href, '/') THEN split_part(node, '://', 1) || '://' || {_HOST.format(u='url')} || href
    WHEN starts_with(href, '?') OR starts_with(href, '#') THEN split_part(node, '://', 1) || '://' || {_HOST.format(u='url')} || {_PATH.format(u='url')} || href
    ELSE split_part(node, '://', 1) || '://' || {_HOST.format(u='url')} || coalesce(nullif(regexp_replace({_PATH.format(u='url')}, '[^/]*$', ''), ''), '/') || href END AS target
  FROM hrefs WHERE href <> '' AND node IS NOT NULL
), e AS (
  SELECT a, {_node('target')} AS b FROM dst
), both_ways AS (
  SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), nodes AS (
  SELECT DISTINCT b AS node, {_HOST.format(u='b')} AS host, {_PATH.format(u='b')} AS path FROM reach
), ruled AS (
  SELECT n.node, arg_max(t.verdict, length(t.rh || t.rp)) AS verdict FROM nodes n JOIN {_RULES} ON {_FITS} GROUP BY n.node
), passed AS (
  SELECT r.a AS node, bool_or(x.verdict = 'allow') AS allowed FROM reach r JOIN ruled x ON r.b = x.node GROUP BY r.a
), own AS (
  SELECT n.host, n.path, arg_max(t.verdict, length(t.rh || t.rp)) AS verdict, arg_max(t.rh || t.rp, length(t.rh || t.rp)) AS rule
  FROM (SELECT DISTINCT host, path FROM pg) n JOIN {_RULES} ON {_FITS} GROUP BY n.host, n.path
)
SELECT pg.page_id, pg.host, pg.path, own.rule,
       coalesce(own.verdict, CASE WHEN passed.allowed THEN 'allow' WHEN NOT passed.allowed THEN 'block' END, 'allow') AS verdict
FROM pg LEFT JOIN own ON own.host = pg.host AND own.path = pg.path LEFT JOIN passed ON passed.node = pg.node
"""

# --- line dedup --------------------------------------------------------------
_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE_DEDUP = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d
), keyed AS (
  SELECT r, i, line, {_KEY} AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM keyed WHERE k NOT IN (SELECT k FROM often) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

# --- fill in the middle ------------------------------------------------------
FILL_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), h AS (
  SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS x FROM d
), c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {"op1_license_scan": LICENSE_SCAN, "op7_quality_rules": QUALITY_RULES, "op5_exact_dedup": EXACT_DEDUP, "op9_source_mix": SOURCE_MIX,
                       "op10_url_filter": URL_FILTER, "op12_line_dedup": LINE_DEDUP, "op13_fill_middle": FILL_MIDDLE}
