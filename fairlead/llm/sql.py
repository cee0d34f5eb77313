"""DuckDB SQL for the contract queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), found AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm
)
SELECT r.doc_id, f.keep_id, CAST(f.group_size AS BIGINT) AS group_size,
       r.doc_id IS NOT DISTINCT FROM f.keep_id AS kept, sha256(r.norm) AS text_sha256
FROM rows r JOIN found f ON r.norm = f.norm
"""


def _positions(kind: str, pattern: str, extra: str = "") -> str:
    """SQL for the matches of one pattern with code-point positions: doc_id, kind, m, s, e."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, h[i] AS m,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT) AS e
  FROM (SELECT doc_id, h, g, unnest(generate_series(1, len(h))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM docs) WHERE len(h) > 0)
  {extra}"""


_LUHN = """list_sum(list_transform(generate_series(1, length(d)), lambda i:
    CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)
         WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(m[5:] || m[1:4], ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
    lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""

ORACLES["op2_pii"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
email AS ({_positions("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}),
ip AS ({_positions("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}),
card AS ({_positions("card", r"[0-9](?:[\x20-]?[0-9])+")}),
phone AS ({_positions("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}),
iban AS ({_positions("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]+")}),
ssn AS ({_positions("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]")}),
spans AS (
  SELECT doc_id, kind, s, e, 1 AS rank, 70 AS base, 'mail|contact|@' AS good, 'example|noreply|no-reply' AS bad FROM email
  UNION ALL SELECT doc_id, kind, s, e, 2, 60, 'ip|address|host|server', 'version|release|section' FROM ip WHERE list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
  UNION ALL SELECT doc_id, kind, s, e, 3, 70, 'card|visa|credit|payment', 'order|tracking|serial|isbn' FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM card) WHERE length(d) BETWEEN 12 AND 19 AND {_LUHN}
  UNION ALL SELECT doc_id, kind, s, e, 4, 50, 'phone|tel|call|mobile', 'order|tracking|serial' FROM phone WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15
  UNION ALL SELECT doc_id, kind, s, e, 5, 80, 'iban|account|bank|konto', 'example|sample' FROM iban WHERE length(m) BETWEEN 15 AND 34 AND {_MOD97}
  UNION ALL SELECT doc_id, kind, s, e, 6, 30, 'ssn|social|security', 'order|tracking|serial' FROM ssn WHERE m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'
),
scored AS (
  SELECT doc_id, kind, s, e, rank, base + CASE WHEN regexp_matches(near, good) THEN 25 ELSE 0 END - CASE WHEN regexp_matches(near, bad) THEN 25 ELSE 0 END AS score
  FROM (SELECT spans.*, lower(substr(text, greatest(s - 40, 0) + 1, least(s, 40))) AS near FROM spans JOIN docs USING (doc_id))
),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores
  FROM scored WHERE rank <= 4 OR score >= 50 GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN lists USING (doc_id)
"""


def _cased(names: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names)


_SCOPE = "len(string_split(substr(text, 1, CAST(s AS BIGINT)), chr(10) || chr(10)))"
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGNED_ID = r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]+"""
_NAMES, _IDS = _cased("password|passwd|secret|token|api_?key"), _cased("client_id|access_id|key_id|username|login")


def _value(names: str, value: str) -> str:
    return ("regexp_extract(m, '^(?:" + names + r""")["'']?\x20*[:=]\x20*["'']?(""" + value + ")$', 1)")


ORACLES["op3_secrets"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
assign AS ({_positions("assign", "(?:" + _NAMES + ")" + _ASSIGNED)}),
access AS ({_positions("access", "AKIA[A-Z0-9]+")}),
hex AS ({_positions("hex", "[0-9a-f]+")}),
ids AS ({_positions("id", "(?:" + _IDS + ")" + _ASSIGNED_ID)}),
keys AS ({_positions("key", "[A-Za-z0-9+/_=-]+")}),
ends AS ({_positions("endpoint", "https?://[A-Za-z0-9./_:?&=%#@-]+")}),
strong AS (
  SELECT doc_id, kind, s, e, 'secret' AS role, 1 AS rank FROM assign WHERE length({_value(_NAMES, "[A-Za-z0-9+/_.=-]+")}) >= 12
  UNION ALL SELECT doc_id, kind, s, e, 'access', 2 FROM access WHERE length(m) >= 18
  UNION ALL SELECT doc_id, kind, s, e, 'secret', 3 FROM hex WHERE length(m) >= 16
),
named AS (
  SELECT * FROM (SELECT doc_id, kind, s, e, 'access' AS role, 4 AS rank FROM ids WHERE length({_value(_IDS, "[A-Za-z0-9+/_.=@-]+")}) >= 4
                 UNION ALL SELECT doc_id, kind, s, e, 'endpoint', 6 FROM ends) w
  WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.doc_id = w.doc_id AND b.s < w.e AND b.e > w.s)
),
loose AS (
  SELECT doc_id, kind, s, e, 'secret' AS role, 5 AS rank FROM keys w
  WHERE length(m) >= 20 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, s, e FROM strong UNION ALL SELECT doc_id, s, e FROM named) b WHERE b.doc_id = w.doc_id AND b.s < w.e AND b.e > w.s)
),
parts AS (
  SELECT p.*, {_SCOPE} AS scope FROM (SELECT * FROM strong UNION ALL SELECT * FROM named UNION ALL SELECT * FROM loose) p JOIN docs USING (doc_id)
),
spans AS (
  SELECT doc_id, kind, s, e, rank FROM parts p
  WHERE rank <= 3 OR EXISTS (
    SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.scope = p.scope AND o.s - p.e <= 200 AND p.s - o.e <= 200
      AND CASE WHEN p.kind = 'key' THEN o.role <> 'secret' ELSE o.role = 'secret' END)
),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_decontaminate"] = rf"""
WITH docs AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, k)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op7_url_filter"] = r"""
WITH raw AS (
  SELECT page_id, CAST(page_id * 37 % 365 AS INTEGER) AS day,
         regexp_replace(regexp_replace(lower(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)(?:[:/?#]|$)', 1))), '\.$', ''), '^www\.', '') AS h
  FROM pages
),
captures AS (SELECT page_id, day, CASE WHEN h <> '' AND length(h) <= 253 THEN h END AS host FROM raw),
hosts AS (SELECT DISTINCT host AS name, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n FROM captures WHERE host IS NOT NULL),
intervals AS (
  SELECT name, 'hosts' AS list, 'block' AS action, n % 150 AS valid_from, n % 150 + 90 AS valid_to FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT name, 'hosts', 'block', n % 150 + 180, NULL FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT name, 'spam', 'block', 0, NULL FROM hosts WHERE contains(name, 'spam')
  UNION ALL SELECT 'example.org', 'domains', 'allow', 100, 250
  UNION ALL SELECT 'example.net', 'domains', 'block', 300, NULL
),
found AS (
  SELECT c.page_id, i.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.name) DESC, CASE WHEN i.action = 'allow' THEN 0 ELSE 1 END, i.valid_from DESC, i.list) AS r
  FROM captures c JOIN intervals i ON (c.host = i.name OR ends_with(c.host, '.' || i.name)) AND i.valid_from <= c.day AND (i.valid_to IS NULL OR i.valid_to > c.day)
)
SELECT c.page_id, c.host, c.day, coalesce(f.action, 'none') AS verdict, f.name AS matched, f.list, CAST(f.valid_from AS INTEGER) AS listed_on
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id AND f.r = 1
"""

ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, w, len(w) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0
), grams AS (
  SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase
  FROM (SELECT lang, w, d, unnest(generate_series(1, m - d + 1)) AS i FROM lists, (VALUES (1), (2), (3)) AS depth(d) WHERE m >= d)
), found AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM found WHERE d = 1 GROUP BY lang),
candidates AS (SELECT lang, d, phrase, string_split(phrase, ' ') AS w, f AS a FROM found WHERE d > 1 AND f >= 10),
sides AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, d - 1)) AS k FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM sides c JOIN found l ON l.lang = c.lang AND l.phrase = c.head JOIN found r ON r.lang = c.lang AND r.phrase = c.rest
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, array_to_string(w[1:d - 1], ' ') AS phrase, a FROM candidates WHERE d > 2
    UNION ALL SELECT lang, array_to_string(w[2:d], ' '), a FROM candidates WHERE d > 2) GROUP BY ALL
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT k.*, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) AS rank
      FROM lowest k LEFT JOIN longer o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 50 * a)
JOIN totals USING (lang) WHERE rank <= 2000
"""
