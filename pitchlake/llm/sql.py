"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op4_decontaminate"] = rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM benchmark),
  win AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, p, p + 12) AS g FROM b, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS u(p)),
  pos AS (SELECT uid, p, w FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
  pre AS (SELECT uid, p, w, w[p] AS f FROM pos WHERE w[p] IN (SELECT g[1] FROM win)),
  hit AS (SELECT pre.uid, pre.p, win.n, win.item FROM pre JOIN win ON pre.f = win.g[1] AND list_slice(pre.w, pre.p, pre.p + win.n - 1) = win.g),
  words AS (SELECT uid, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY uid),
  items AS (SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)"""

_MIX = rf"""s AS (SELECT {{keep}}, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM {{docs}}),
  src AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s GROUP BY source),
  lev AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src
    WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source)),
  goal AS (SELECT source, source_size, least(cap, max(level) OVER () * weight)::DOUBLE AS target FROM lev),
  cut AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
  mixed AS (SELECT *, CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken FROM cut)"""

ORACLES["op6_mix_sources"] = f"WITH {_MIX.format(keep='doc_id', docs='documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"

ORACLES["op2_repeats"] = rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  win AS (SELECT uid, doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS u(p) WHERE doc_id IS NOT NULL),
  least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
  gone AS (SELECT DISTINCT uid, q FROM win JOIN least USING (h), unnest(range(p, p + 50)) AS u(q) WHERE m < doc_id),
  removed AS (SELECT uid, list(q) AS qs FROM gone GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN removed USING (uid)"""

ORACLES["op13_filter_audit"] = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  least AS (SELECT text, min(doc_id) AS m FROM t GROUP BY text),
  lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_value(len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(m < t.doc_id, false)) AS fails
    FROM t LEFT JOIN least USING (text) LEFT JOIN lab ON t.doc_id = lab.doc_id),
  letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
  s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS earlier FROM o, unnest(range(1, 6)) AS u(step)),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
  x AS (SELECT part, filter_order, step, n, good, toxic, fails[own] AS fail, step > 1 AND len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
      len(list_filter(fails, lambda b: b)) = 1 AS only_one FROM g, s),
  r AS (SELECT part, filter_order, step, sum(n) FILTER (NOT fail AND NOT gone) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant,
      sum(n) FILTER (fail AND only_one) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r"""

_LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op12_ranked_search"] = rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '{_LETTERS}') AS w FROM documents),
  i AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '{_LETTERS}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
  q AS (SELECT qid, item_id, term, count(*) AS times FROM i, unnest(w) AS u(term) GROUP BY ALL),
  p AS (SELECT uid, doc_id, len(w) AS n, term, count(*)::BIGINT AS tf FROM d, unnest(w) AS u(term) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * df + 1)))::BIGINT AS w FROM f, c),
  s AS (SELECT qid, item_id, uid, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0) WHERE r <= 10"""
