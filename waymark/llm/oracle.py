"""SQL for the queries of this subpackage that SQL can say."""

from __future__ import annotations

from waymark.llm.url_filter import RULES, split_rule

WORD = "[^\\x20\\x09-\\x0D]+"
PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2() -> str:
    """Shingles as lists of words, overlaps of all pairs that share one, components by walking the links."""
    return f"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM words),
    size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    sets AS MATERIALIZED (SELECT doc_id, n, sum(hash(s)::HUGEINT) AS sum FROM sh JOIN size USING (doc_id) GROUP BY ALL),
    least AS MATERIALIZED (SELECT n, sum, min(doc_id) AS rep FROM sets GROUP BY ALL),
    rep AS MATERIALIZED (SELECT sh.doc_id, s, n FROM sh JOIN least ON sh.doc_id = rep),
    links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM rep a JOIN rep b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    walk AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT walk.a, l.b FROM walk JOIN both_ways l ON walk.b = l.a),
    comp AS MATERIALIZED (SELECT a, min(b) AS c FROM walk GROUP BY a)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(comp.c, l.rep, d.doc_id) AS component_id FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN least l ON s.n = l.n AND s.sum = l.sum LEFT JOIN comp ON comp.a = l.rep"""


def op3() -> str:
    """Windows as strings of words; the words of a document that any occurrence covers."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({FOLD}, '{PLAIN}') AS w FROM documents),
    i AS MATERIALIZED (SELECT item_id, regexp_extract_all({FOLD}, '{PLAIN}') AS w FROM benchmark),
    win AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
    place AS MATERIALIZED (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
    occ AS MATERIALIZED (SELECT doc_id, item_id, k, m FROM place JOIN win USING (m, s)),
    hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS at FROM (SELECT DISTINCT doc_id, k, m FROM occ)) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


def op8(support: float = 0.005, confidence: float = 0.8) -> str:
    """The list by CASE; mined rules as combinations of up to three tokens, counted and pruned."""
    host = "translate(CASE WHEN contains(u, '://') THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "CASE WHEN contains(u, '://') THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    rule = verdict = "NULL"
    for what, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        h, p = split_rule(text)
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    words = lambda source, sign: f"list_transform(list_filter({source}, lambda t: len(t) > 0 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: '{sign}' || t)"
    tokens = f"""list_distinct({words("string_split(lower(host), '.')", "h:")} || {words("string_split(array_to_string(list_filter(string_split(lower(host), '.'), lambda t: contains(t, '-')), '-'), '-')", "w:")} || {words("string_split_regex(lower(path), '[/._-]')", "p:")}
      || list_transform(list_filter(list_transform(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda t: regexp_extract(t, '^([^=]*)', 1)), lambda t: len(t) > 0), lambda t: 'q:' || t))"""
    return f"""WITH base AS MATERIALIZED (SELECT page_id, coalesce(url, '') AS u, row_number() OVER () AS r FROM pages), parts AS MATERIALIZED (SELECT *, {host} AS host, {path} AS path FROM base),
    judged AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS listed, {tokens} AS tokens FROM parts),
    total AS (SELECT count(*) AS n FROM judged), tok AS MATERIALIZED (SELECT r, coalesce(listed, 'open') AS label, unnest(tokens) AS t FROM judged),
    freq AS (SELECT t, count(*) AS n, sum(hash(r)::HUGEINT) AS w FROM tok GROUP BY t HAVING count(*) >= {support} * (SELECT n FROM total)),
    chosen AS MATERIALIZED (SELECT min(t) AS t FROM freq GROUP BY n, w), it AS MATERIALIZED (SELECT r, label, t FROM tok JOIN chosen USING (t)),
    combos AS MATERIALIZED (SELECT r, label, [t] AS a FROM it UNION ALL SELECT x.r, x.label, [x.t, y.t] FROM it x JOIN it y ON x.r = y.r AND x.t < y.t
      UNION ALL SELECT x.r, x.label, [x.t, y.t, z.t] FROM it x JOIN it y ON x.r = y.r AND x.t < y.t JOIN it z ON x.r = z.r AND y.t < z.t),
    every AS MATERIALIZED (SELECT a, count(*) AS n FROM combos GROUP BY a), by_label AS (SELECT a, label, count(*) AS c FROM combos WHERE label <> 'open' GROUP BY ALL),
    rules AS MATERIALIZED (SELECT a, label AS v, c / every.n AS conf, c / total.n AS sup FROM by_label JOIN every USING (a), total WHERE c >= {support} * total.n AND c / every.n >= {confidence}),
    kept AS MATERIALIZED (SELECT * FROM rules x WHERE NOT EXISTS (SELECT 1 FROM rules y WHERE y.v = x.v AND len(y.a) < len(x.a) AND list_has_all(x.a, y.a) AND y.conf >= x.conf)),
    met AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY conf DESC, sup DESC, len(a) DESC, a, v) AS k FROM combos JOIN kept USING (a) WHERE label = 'open')
    SELECT page_id, host, path, rule, coalesce(listed, v, 'allow') AS verdict FROM judged LEFT JOIN (SELECT r, v FROM met WHERE k = 1) USING (r)"""


ORACLE_SQL = {"op2_ngram_jaccard_join": op2(), "op3_benchmark_decontamination": op3(), "op8_url_filters": op8()}
