"""SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from tickwarden.llm import quality, urls

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ((coalesce(doc_id, -1) % 1000003 + 1000003) % 1000003 * 7919) % 64 AS part FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS pos,
             ((SELECT sum(source_size) FROM s)::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT min_by(level, pos) AS common FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(common * w, cap)) AS target FROM l, c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.part, d.doc_id NULLS FIRST) AS place,
             ('0x' || left(md5('7:' || coalesce(d.source, '')), 5))::INT / 1048576.0::DOUBLE AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (floor(place * rate + start) - floor((place - 1) * rate + start))::INT AS copies FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM k
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, min([floor(64 * x::DOUBLE)::BIGINT for x in embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_UNWANTED = " OR ".join(rf"regexp_matches(lower(host || path), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in urls.UNWANTED)
URLS = rf"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, h, p, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
a AS (SELECT DISTINCT host, path FROM u),
m AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
      FROM a JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, m.rule, coalesce(m.v, CASE WHEN {_UNWANTED.replace('host', 'u.host').replace('path', 'u.path')} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path
"""

_VOTES = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 2 ELSE 1 END" for r in quality.RULES)
_N = len(quality.RULES)
_START = ", ".join(f"0.0::DOUBLE - ln({r.least}::DOUBLE), 0.0::DOUBLE, {quality.START_GOOD_VOTE}::DOUBLE" for r in quality.RULES)
_LEAST = ", ".join(f"ln({r.least}::DOUBLE)" for r in quality.RULES)
_SHARE = f"greatest({quality.SHARES[0]}::DOUBLE, least({quality.SHARES[1]}::DOUBLE, g / n))"
_LOGIT = "list_sum([s.prior] || [s.w[3 * r + p.votes[r + 1] + 1] for r in range({n})])".replace("{n}", str(_N))
QUALITY = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT row_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g),
c AS (SELECT row_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
      FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM h WHERE n > 1) GROUP BY row_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(body, '[^!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN c USING (row_id)),
v AS (SELECT *, [{_VOTES}] AS votes FROM m),
p AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
e AS (
  SELECT 0 AS turn, {{'prior': ln({quality.START_SHARE}::DOUBLE / (1 - {quality.START_SHARE}::DOUBLE)), 'w': [{_START}]}} AS s
  UNION ALL
  SELECT turn + 1, {{'prior': ln({_SHARE} / (1 - {_SHARE})),
     'w': [CASE (k - 1) % 3 WHEN 0 THEN greatest(-{quality.MOST_BAD}::DOUBLE, least(-[{_LEAST}][(k - 1) // 3 + 1], x))
                      WHEN 2 THEN greatest(0.0::DOUBLE, least({quality.MOST_GOOD}::DOUBLE, x)) ELSE 0.0::DOUBLE END
           for x, k in [ln(((list_sum([0.0::DOUBLE] || [x.g for x in ps if x.votes[k // 3 + 1] = k % 3]) + 1) / (g + 3))
            / ((list_sum([0.0::DOUBLE] || [x.n - x.g for x in ps if x.votes[k // 3 + 1] = k % 3]) + 1) / (n - g + 3))) for k in range({3 * _N})]]}}
  FROM (SELECT turn, list({{'votes': votes, 'n': n, 'g': gg}} ORDER BY votes) AS ps, sum(gg) AS g, sum(n) AS n
        FROM (SELECT turn, p.votes, p.n, p.n / (1 + exp(-{_LOGIT})) AS gg FROM e, p WHERE turn < {quality.ROUNDS}) GROUP BY turn)),
f AS (SELECT s FROM e WHERE turn = (SELECT max(turn) FROM e)),
q AS (SELECT p.*, round(1 / (1 + exp(-{_LOGIT})), 6) AS quality, p.n_words < 10 OR 100 * p.n_repeat_words > 20 * p.n_words AS base_failed FROM v p, f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, quality FROM q
"""

_GAP = "(list_dot_product(x, x) - 2 * list_dot_product(x, e) + list_dot_product(e, e))::BIGINT"


def _code_round(n: int) -> str:
    """Nearest entries by the codebooks b{n - 1}, then the codebooks b{n} that follow from them."""
    return f"""
a{n} AS (SELECT rid, part, min({_GAP} * 64 + entry) % 64 AS entry, any_value(x) AS x FROM p JOIN b{n - 1} USING (part) GROUP BY rid, part),
s{n} AS (SELECT part, entry, j, sum(c)::BIGINT AS s, count(*) AS n
        FROM (SELECT part, entry, unnest(x)::BIGINT AS c, unnest(range(len(x))) AS j FROM a{n}) GROUP BY part, entry, j),
m{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS e FROM s{n} GROUP BY part, entry),
b{n} AS (SELECT part, entry, coalesce(m.e, o.e) AS e FROM b{n - 1} o LEFT JOIN m{n} m USING (part, entry)),"""


CODES = f"""
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM k, range(16) t(part)),
f AS (SELECT min(rid) AS rid, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM k GROUP BY vec_id),
b0 AS (SELECT part, entry, x AS e FROM f JOIN p USING (rid) WHERE entry < 64),{_code_round(1)}{_code_round(2)}
z AS (SELECT rid, part, min({_GAP} * 64 + entry) AS best FROM p JOIN b2 USING (part) GROUP BY rid, part),
c AS (SELECT rid, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string([i::BIGINT for i in e], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (rid), h
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS gram FROM d),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
e AS (SELECT c.a, c.b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.rid <> y.rid GROUP BY x.rid, y.rid) c
      JOIN n na ON na.rid = c.a JOIN n nb ON nb.rid = c.b WHERE 100 * c.c >= 90 * (na.n + nb.n - c.c)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m ON m.a = d.rid LEFT JOIN n ON n.rid = d.rid
"""

PHRASES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS phrase
      FROM w, range(1, 6) s(size) WHERE len(w) >= size),
c AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= 100),
p AS (SELECT DISTINCT x.lang, x.phrase FROM c y,
        LATERAL (SELECT y.lang AS lang, unnest([y.phrase[strpos(y.phrase, ' ') + 1:], array_to_string(string_split(y.phrase, ' ')[:y.size - 1], ' ')]) AS phrase) i
        JOIN c x ON x.lang = i.lang AND x.phrase = i.phrase WHERE y.size > 2 AND x.a = y.a),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c ANTI JOIN p USING (lang, phrase) WHERE size > 1),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM k JOIN t USING (lang) JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(string_split(k.phrase, ' ')[:k.k], ' ')
      JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(string_split(k.phrase, ' ')[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
