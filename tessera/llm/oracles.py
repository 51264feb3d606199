"""SQL for DuckDB that gives the same rows as some of the queries, written from their contracts alone."""

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), {WORDS}) AS w FROM benchmark WHERE text IS NOT NULL),
j AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM j)),
size AS (SELECT item_id, count(*) AS q FROM own GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) AS w FROM documents),
dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM j) WHERE len(w) >= k),
seen AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dk))
SELECT doc_id, item_id, count(*) AS n_shared, q AS n_shingles, count(*)::DOUBLE / q AS containment
FROM seen JOIN own USING (k, s) JOIN size USING (item_id) GROUP BY doc_id, item_id, q HAVING count(*) >= 0.8 * q - 1e-9
"""

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM win JOIN least USING (s), range(50) r(k) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def _strength(table: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL OR g < 2 OR k = 0 OR k = n THEN 1000.0
WHEN NOT room > 0 OR between_ / room <= 1.0 / 1001 THEN 1000.0 ELSE greatest(2.0, (1 - between_ / room) / (between_ / room)) END::DOUBLE AS s
FROM (SELECT *, (kk - n * (k / n) * (k / n)) / nullif((k / n) * (1 - k / n), 0) - (g - 1) AS between_, n - nn / n - (g - 1) AS room
FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum(k)::DOUBLE AS k, sum(k::DOUBLE * k / n) AS kk FROM {table})))"""


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_LOW = "mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1))"
SECOND = "('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'ne.jp', 'or.jp', 'com.br', 'com.cn', 'com.mx', 'co.in', 'co.za', 'co.kr', 'com.tr', 'com.tw', 'com.sg')"
_LAST = "(CASE WHEN len(string_split({h}, '.')) <= {n} THEN {h} ELSE array_to_string(string_split({h}, '.')[-{n}:], '.') END)"


def _last(n: int, h: str = "host") -> str:
    return _LAST.format(n=n, h=h)


def _suffix(h: str = "host") -> str:
    return f"(CASE WHEN {_last(2, h)} IN {SECOND} THEN {_last(2, h)} ELSE {_last(1, h)} END)"


def _domain(h: str = "host") -> str:
    return f"(CASE WHEN {_last(2, h)} IN {SECOND} THEN {_last(3, h)} ELSE {_last(2, h)} END)"


OP4 = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
y AS (SELECT doc_id, max(greatest(1 - coalesce(quality, 1), coalesce(toxic, 0))) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
o AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html?)?/?$', 1), '') AS BIGINT) AS doc_id FROM p) JOIN y USING (doc_id)),
h AS (SELECT host, {_domain()} AS domain, {_suffix()} AS suffix, count(*) AS n, sum(bad)::BIGINT AS k FROM o GROUP BY 1),
d AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY 1, 2),
x AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY 1),
t AS (SELECT (coalesce(sum(k), 0) + 0.5)::DOUBLE / (coalesce(sum(n), 0) + 1) AS overall FROM h),
sx AS {_strength('x')}, sd AS {_strength('d')}, sh AS {_strength('h')},
px AS (SELECT x.*, s, (k + overall * s) / (n + s) AS mean FROM x, t, sx),
pd AS (SELECT d.*, sd.s, (d.k + px.mean * sd.s) / (d.n + sd.s) AS mean FROM d JOIN px USING (suffix), sd),
ph AS (SELECT h.*, sh.s, (h.k + pd.mean * sh.s) / (h.n + sh.s) AS mean FROM h JOIN pd USING (domain), sh),
bh AS (SELECT host, n, mean, {_LOW} AS low FROM ph WHERE host <> ''), bd AS (SELECT domain, mean, {_LOW} AS low FROM pd WHERE domain <> ''), bx AS (SELECT suffix, mean, {_LOW} AS low FROM px WHERE suffix <> ''),
j AS (SELECT page_id, host, path, coalesce(bh.n, 0) AS n_outcomes, coalesce(bh.mean, bd.mean, bx.mean) AS mean, coalesce(bh.low, bd.low, bx.low) AS low,
CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p LEFT JOIN bh USING (host) LEFT JOIN bd ON bd.domain = {_domain('p.host')} LEFT JOIN bx ON bx.suffix = {_suffix('p.host')}),
v AS (SELECT *, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS by_reputation FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE by_reputation END AS verdict, by_reputation, n_outcomes, round(mean, 9) AS posterior, round(low, 9) AS posterior_low FROM v
"""


def op6(templates: tuple, phrases: tuple) -> str:
    """The licence scan: every block of every notice by counting alone, without prefixes or other filters."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notices = ", ".join(f"({i}, {quoted(t.label)}, {quoted(t.text)})" for i, t in enumerate(templates))
    said = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in phrases)
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold.format("coalesce(text, '')")}, {WORDS}) AS w FROM documents),
ph AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {said}) v(p, label)),
b AS (SELECT r, i - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), ph WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
bs AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list_distinct(list(label)) AS labels FROM b GROUP BY 1),
t0 AS (SELECT i, label, regexp_extract_all({fold.format('text')}, {WORDS}) AS ws FROM (VALUES {notices}) v(i, label, text)),
t AS (SELECT i, label, list_distinct(ws) AS tokens, len(list_distinct(ws)) AS size, greatest(8, pow(2, ceil(log2(len(ws)))))::BIGINT AS width FROM t0),
m AS (SELECT r, label, size, k * width AS lo, (k + 2) * width AS hi, len(list_intersect(list_distinct(w[k * width + 1 : (k + 2) * width]), tokens)) AS both_ FROM (SELECT r, w, label, tokens, size, width, unnest(range(0, (len(w) - 1) // width + 1)) AS k FROM d, t WHERE len(w) > 0)),
f AS (SELECT r, label, size, lo, hi, both_::DOUBLE / size AS share FROM m WHERE both_ >= ceil(0.8 * size - 1e-9)),
best AS (SELECT DISTINCT r, label FROM f a WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.r = a.r AND o.lo < a.hi AND a.lo < o.hi AND (o.share > a.share OR o.share = a.share AND o.size > a.size))),
own AS (SELECT r, list(label) AS labels FROM best GROUP BY 1), top AS (SELECT r, max(share) AS share FROM f GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, bs.lo::BIGINT AS first_word, bs.hi::BIGINT AS last_word, array_to_string(list_sort(coalesce(bs.labels, [])), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(own.labels, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN own USING (r) LEFT JOIN top USING (r)
"""
