"""SQL for DuckDB of the corpus queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as rules


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quality_rules_sql(min_words: int = 20, repeat_percent: int = 30, guard_words: int = 20, reference_words: int = 1000) -> str:
    """The counts, the histograms, the references and the Jensen-Shannon distances of operator 10."""
    escaped = lambda chars: "".join(f"\\x{ord(c):02x}" for c in chars)
    chars = [f"len(regexp_replace(text, '[^{escaped(c)}]+', '', 'g'))" for c in rules.CLASSES]
    common = "CASE " + " ".join(f"WHEN lang = '{lang}' THEN {_list(words)}" for lang, words in rules.COMMON_WORDS.items()) + f" ELSE {_list(rules.COMMON_WORDS['en'])} END"
    distance = lambda kind: f"""(SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far
        FROM (SELECT h.doc_id, h.n / nullif(sum(h.n) OVER (PARTITION BY h.doc_id), 0) AS p, r.share AS q FROM {kind} h JOIN {kind}_reference r ON h.lang = r.lang AND h.k = r.k) GROUP BY doc_id)"""  # noqa: E731
    space = r"[^\x09-\x0D\x20]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{space}') AS ws FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS at FROM twice, range(8) t(k)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{space}') GROUP BY doc_id),
b AS (SELECT w.doc_id, w.lang, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\\x09-\\x0D\\x20]+', '', 'g'))::BIGINT AS word_chars,
        {chars[rules.CLASSES.index(rules.SYMBOLS)]}::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
c AS (SELECT doc_id, lang, [{', '.join(chars)}] AS named, len(text) AS n FROM d),
chars AS (SELECT doc_id, lang, k, CASE WHEN k <= len(named) THEN named[k] ELSE n - list_sum(named) END::DOUBLE AS n FROM c, range(1, {len(chars) + 2}) t(k)),
chars_reference AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS share FROM chars GROUP BY lang, k),
f AS (SELECT doc_id, lang, string_split_regex(lower(text), '[\\x20\\x09-\\x0D.,;:!?]+') AS bare, {common} AS listed FROM d),
named AS (SELECT doc_id, lang, len(bare) AS n, [len(list_filter(bare, lambda x: x = y)) FOR y IN listed] AS named FROM f),
common AS (SELECT doc_id, lang, k, CASE WHEN k <= len(named) THEN named[k] ELSE n - list_sum(named) END::DOUBLE AS n FROM named, range(1, {max(map(len, rules.COMMON_WORDS.values())) + 2}) t(k)),
common_reference AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS share FROM common GROUP BY lang, k),
size AS (SELECT lang, sum(n_words) AS n FROM b GROUP BY lang),
v AS (SELECT b.*, size.n AS reference_words, x.far AS char_far, y.far AS word_far,
        n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words AS base_failed, 1 / sqrt(greatest(n_words, 1)) AS noise
      FROM b JOIN size USING (lang) LEFT JOIN {distance('chars')} x USING (doc_id) LEFT JOIN {distance('common')} y USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= {guard_words} AND reference_words >= {reference_words} AND (coalesce(char_far, 0) > 0.2 + 0.8 * noise OR coalesce(word_far, 0) > 0.17 + 1.3 * noise)) AS kept
FROM v"""


URL_FILTERS_SQL = """
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours((page_id % 720)::INT) AS t,
        nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host AS k, ('0x' || substr(md5(host), 1, 1))::INT AS a, ('0x' || substr(md5(host), 2, 1))::INT AS b, ('0x' || substr(md5(host), 3, 1))::INT AS c FROM p WHERE host IS NOT NULL),
e0 AS (SELECT k, 'block' AS action, b AS d FROM h WHERE a < 7 UNION ALL SELECT k, 'remove', b + 1 + c FROM h WHERE a < 5
    UNION ALL SELECT k, 'block', 0 FROM h WHERE a = 7 UNION ALL SELECT k, 'allow', b FROM h WHERE a = 7
    UNION ALL SELECT k || '/en', 'block', b FROM h WHERE a IN (8, 9)
    UNION ALL SELECT array_to_string(list_slice(string_split(k, '.'), -3, -1), '.'), 'block', 20 FROM h WHERE c < 2),
e1 AS (SELECT k, d, max_by(action, list_position(['remove', 'block', 'allow'], action)) AS action FROM e0 GROUP BY k, d),
e2 AS (SELECT k, action, TIMESTAMP '2024-01-01' + to_days(d::INT) AS f, TIMESTAMP '2024-01-01' + to_days((lead(d) OVER (PARTITION BY k ORDER BY d))::INT) AS u FROM e1),
s AS (SELECT page_id, t, host, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '')[1:4] AS s FROM p WHERE host IS NOT NULL),
c AS (SELECT DISTINCT page_id, t, k FROM (
    SELECT page_id, t, array_to_string(l[i:], '.') AS k FROM s, range(1, 20) r(i) WHERE i <= greatest(len(l) - 1, 1)
    UNION ALL SELECT page_id, t, host || '/' || array_to_string(s[1:i], '/') FROM s, range(1, 5) r(i) WHERE i <= len(s))),
m AS (SELECT page_id, c.k, action FROM c JOIN e2 USING (k) WHERE action <> 'remove' AND t >= f AND (u IS NULL OR t < u)),
v AS (SELECT page_id, count(*) AS n, max_by(k, {'a': length(k), 'b': list_position(['remove', 'block', 'allow'], action), 'c': k}) AS entry,
        max_by(action, {'a': length(k), 'b': list_position(['remove', 'block', 'allow'], action), 'c': k}) AS top FROM m GROUP BY page_id)
SELECT p.page_id, url, coalesce(n, 0)::BIGINT AS n_active, entry, coalesce(top = 'block', false) AS blocked FROM p LEFT JOIN v USING (page_id)"""


HARD_NEGATIVES_SQL = """WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
