"""DuckDB SQL for the training-data queries that SQL can express. The others (packing, language, SimHash, classifier) have tests."""

from __future__ import annotations

from wanescope.llm.url_filter import HREF, IS_CANONICAL, IS_REFRESH, LINK_TAG, META_TAG, REFRESH_URL, RULES

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')".format

_ITEM_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format
DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {_ITEM_WORDS(LOW("coalesce(text, '')"))} AS w FROM documents),
bw AS (SELECT item_id, {_ITEM_WORDS(LOW("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dg JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

_GONE = "(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{0}', '', 'g')))".format
QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, text, {WORDS("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM r) GROUP BY 1),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, {_GONE('[#*$%&|<>]')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, {_GONE('[^\\p{L}\\x20\\x09-\\x0D]')} AS others, {_GONE('\\p{Lu}')} AS upper_chars, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\t]*[-*\\x{2022}]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{2026})[\\x20\\t]*$'))) AS dots FROM d LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT (base_failed OR n_words > 100000 OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > 3 * n_words OR 10 * others > 3 * word_chars OR 2 * upper_chars > word_chars OR 10 * bullets > 9 * n_lines OR 10 * dots > 3 * n_lines) AS kept FROM f"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, i, said, list_distinct({WORDS("said")}) AS w FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS pos FROM l),
c AS (SELECT list_sort(w) AS s, min(pos) AS pos, len(list_sort(w)) AS n FROM o WHERE len(w) >= 1 GROUP BY 1, 3),
t AS (SELECT pos, n, unnest(s) AS tok FROM c),
p AS (SELECT b.pos, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.tok = b.tok AND a.pos < b.pos AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.pos, b.pos, a.n, b.n),
later AS (SELECT DISTINCT pos FROM p WHERE 9 * k >= 4 * (na + nb)),
gone AS (SELECT o.doc_id, o.i FROM o JOIN c ON list_sort(o.w) = c.s WHERE o.pos <> c.pos OR c.pos IN (SELECT pos FROM later)),
kept AS (SELECT doc_id, string_agg(said, chr(10) ORDER BY i) AS text, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(n, 0) END AS BIGINT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)"""

CHAT = """
WITH s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL),
r AS (SELECT c.conv_id, perspective, turn, role, text, coalesce(role = perspective, false) AS trained, CASE WHEN coalesce(role = perspective, false) THEN '<|assistant|>' ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' END || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment FROM conversations c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, perspective, turn, role, trained, segment, CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS start, CAST(sum(length(segment)) OVER w AS BIGINT) AS "end" FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)"""


def _rule(host: str, path: str, value: str) -> str:
    cases = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, value)}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)))
    return f"CASE {cases} END"


_PART = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', {1})".format
def _led(tag: str, has: str, value: str) -> str:
    tag, has, value = (x.replace("'", "''") for x in (tag, has, value))
    return f"list_transform(list_filter(regexp_extract_all(html, '{tag}', 1), lambda x: regexp_matches(x, '{has}')), lambda x: regexp_extract(x, '{value}', 1))"


_UNDOTTED = "CASE WHEN contains(path, '/.') THEN array_to_string(list_reduce(list_transform(string_split(CASE WHEN regexp_matches(path, '/\\.{1,2}$') THEN path || '/' ELSE path END, '/'), lambda s: [s]), lambda kept, s: CASE WHEN s[1] = '.' THEN kept WHEN s[1] = '..' THEN CASE WHEN len(kept) > 1 THEN kept[:len(kept) - 1] ELSE kept END ELSE list_concat(kept, s) END), '/') ELSE path END"
URL_FILTER = f"""
WITH RECURSIVE p AS (SELECT page_id, {LOW(_PART('url', 1))} AS host, {_PART('url', 2)} AS path, {_PART('url', 3)} AS query, coalesce(html, '') AS html FROM pages),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE {_UNDOTTED} END || CASE WHEN query = '?' THEN '' ELSE query END END AS node FROM p),
h AS (SELECT node, host, path, replace(unnest(list_concat({_led(LINK_TAG, IS_CANONICAL, HREF)}, {_led(META_TAG, IS_REFRESH, REFRESH_URL)})), '&amp;', '&') AS href FROM n),
a AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') THEN NULL WHEN starts_with(href, '//') THEN 'x:' || href WHEN starts_with(href, '/') THEN 'x://' || host || href WHEN starts_with(href, '?') THEN 'x://' || host || path || href ELSE 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target FROM h WHERE href <> ''),
e1 AS (SELECT node AS u, {LOW(_PART('target', 1))} AS host, {_PART('target', 2)} AS path, {_PART('target', 3)} AS query FROM a),
e2 AS (SELECT u, host || CASE WHEN path = '' THEN '/' ELSE {_UNDOTTED} END || CASE WHEN query = '?' THEN '' ELSE query END AS v FROM e1 WHERE host <> '' AND u IS NOT NULL),
e AS (SELECT u, v FROM e2 UNION SELECT v, u FROM e2),
reach AS (SELECT DISTINCT u AS node, u AS other FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON r.other = e.u),
fit AS (SELECT node, {_rule("regexp_extract(other, '^[^/]*', 0)", "regexp_extract(other, '^[^/]*([^?]*)', 1)", "verdict")} AS f FROM reach),
shared AS (SELECT node, CASE WHEN bool_or(f = 'allow') THEN 'allow' WHEN bool_or(f = 'block') THEN 'block' END AS s FROM fit GROUP BY 1)
SELECT page_id, n.host, n.path, {_rule('n.host', 'n.path', 'name')} AS rule, coalesce({_rule('n.host', 'n.path', 'verdict')}, s, 'allow') AS verdict FROM n LEFT JOIN shared ON n.node = shared.node"""

_PATTERNS = [
    ("assign", """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("live", "[A-Za-z0-9+/_=-]{20,}", 0, 20),
]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, coalesce(source, '') AS repo, {i} AS kind, '{k}' AS name, {m} AS least_chars, regexp_extract_all(coalesce(text, ''), '{p}', 0) AS ms, regexp_extract_all(coalesce(text, ''), '{p}', {g}) AS vs, string_split_regex(coalesce(text, ''), '{p}') AS gs FROM documents" for i, (k, p, g, m) in enumerate(_PATTERNS))
_LEN = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)".format
SECRETS = f"""
WITH f AS ({_FOUND}),
x AS (SELECT * EXCLUDE (i), {_LEN('gs[1:i]')} + {_LEN('ms[1:i - 1]')} AS s, ms[i] AS m, vs[i] AS v FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)),
y AS (SELECT doc_id, repo, kind, name, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v, length(v) >= 20 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 10 AND NOT regexp_matches(v, '(?i)example|placeholder|changeme|xxxx|your') AS lively FROM x WHERE length(v) >= least_chars),
z AS (SELECT * FROM y WHERE kind < 3 UNION ALL SELECT * FROM y WHERE kind = 3 AND lively AND NOT EXISTS (SELECT 1 FROM y b WHERE b.doc_id = y.doc_id AND b.kind < 3 AND b.s < y.e AND y.s < b.e)),
own AS (SELECT v, count(DISTINCT split_part(repo, '/', 1)) AS owners FROM z GROUP BY 1),
k AS (SELECT * FROM z JOIN own USING (v) WHERE kind < 3 OR (lively AND owners < 3)),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS everything FROM k GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(everything, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""

# CRC-32 by the reflected polynomial: the table of a byte's eight steps is made from the rule
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)".format

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
g AS (SELECT k, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER w AS r, sum(s) OVER () - sum(s) OVER w + s AS rest FROM g WINDOW w AS (ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING)),
a AS MATERIALIZED (SELECT *, bool_and(s * (17 - r) > rest) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS alone FROM o),
own AS (SELECT count(*) FILTER (WHERE alone) AS n FROM a),
e AS MATERIALIZED (SELECT k, row_number() OVER w AS i, CAST(sum(s) OVER w AS BIGINT) AS e FROM a WHERE NOT alone WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
least_of AS (SELECT 1 AS m, i, e, e AS c FROM e
  UNION ALL SELECT f.m + 1, e.i, e.e, min(greatest(f.c, e.e - f.e)) FROM least_of f JOIN e ON f.i <= e.i, own WHERE f.m < 16 - own.n GROUP BY 1, 2, 3),
cap AS MATERIALIZED (SELECT c FROM least_of, own WHERE m = 16 - n AND i = (SELECT max(i) FROM e)),
cuts AS (SELECT 0 AS m, CAST(0 AS BIGINT) AS p UNION ALL SELECT m + 1, max(e.e) FROM cuts, cap, e WHERE m < 16 AND e.e <= p + c AND p < (SELECT max(e) FROM e) GROUP BY 1),
placed AS (SELECT k, r - 1 AS shard FROM a WHERE alone UNION ALL SELECT k, (SELECT n FROM own) + count(*) - 1 FROM e JOIN cuts ON cuts.p < e.e GROUP BY 1)
SELECT doc_id, size, CAST({_CRC('t')} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN placed USING (k), crc"""


def _tree(nodes: str, name: str, rounds: int) -> str:
    """CTEs name_1 ... name_<rounds>: the levels above nodes (tree, idx, h); a tree of one node stays as it is."""
    out, below = [], nodes
    for i in range(1, rounds + 1):
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT tree, idx // 3 AS idx, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE max(h) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {below}) GROUP BY 1, 2)")
        below = f"{name}_{i}"
    return ", ".join(out)


def _climb(rows: str, nodes: str, name: str, rounds: int, out: str) -> str:
    """CTEs that take rows (tree, at, folded, proof, ...) up the levels of nodes, name_1, ..."""
    steps, before = [], rows
    for i in range(1, rounds + 1):
        below = nodes if i == 1 else f"{name}_{i - 1}"
        steps.append(f"{out}_{i} AS MATERIALIZED (SELECT r.id, r.tree, r.at // 3 AS at, CASE WHEN any_value(c.n) > 1 THEN sha256(coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < r.at), '') || r.folded || coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > r.at), '')) ELSE r.folded END AS folded, r.proof || coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx <> r.at), '') AS proof FROM {before} r JOIN (SELECT tree, count(*) AS n FROM {below} GROUP BY 1) c ON r.tree = c.tree JOIN {below} b ON b.tree = r.tree AND b.idx // 3 = r.at // 3 GROUP BY r.id, r.tree, r.at, r.folded, r.proof)")
        before = f"{out}_{i}"
    return ", ".join(steps)


def _record(text: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END".format
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels that are enough for 3^12 records a source, and 3^7 sources.
_DEEP, _HIGH = 12, 7
MERKLE = f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, coalesce('=' || source, '-') AS tree, {_record('text')} AS leaf, CASE WHEN CAST({_CRC('CAST(doc_id AS VARCHAR)')} AS BIGINT) % 2 = 0 THEN {_record("replace(text, chr(10), '')")} ELSE {_record('text')} END AS tampered FROM documents, crc),
n0 AS MATERIALIZED (SELECT id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h FROM d),
{_tree('n0', 'n', _DEEP)},
s0 AS MATERIALIZED (SELECT 'all' AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, h, t.tree AS name FROM n_{_DEEP} t JOIN (SELECT DISTINCT tree, source FROM d) USING (tree)),
{_tree('s0', 's', _HIGH)},
l0 AS (SELECT d.id, d.tree, n0.idx AS at, d.tampered AS folded, '' AS proof FROM d JOIN n0 USING (id)),
{_climb('l0', 'n0', 'n', _DEEP, 'l')},
u0 AS (SELECT l.id, 'all' AS tree, s0.idx AS at, l.folded, l.proof FROM l_{_DEEP} l JOIN s0 ON s0.name = l.tree),
{_climb('u0', 's0', 's', _HIGH, 'u')}
SELECT doc_id, leaf, s0.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.h AS verified FROM d JOIN u_{_HIGH} u USING (id) JOIN s0 ON s0.name = d.tree, s_{_HIGH} r"""

_ROUNDS = 6
_FAR = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _vector_rounds() -> str:
    out = []
    for r in range(_ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, p, min({{'d': {_FAR}, 'e': e}}) AS m FROM x JOIN c{r} c USING (p) GROUP BY 1, 2)")
        if r < _ROUNDS:
            out.append(f"m{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n) ORDER BY pos) AS v FROM (SELECT p, m.e AS e, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS n FROM (SELECT id, p, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM x) JOIN a{r} USING (id, p) GROUP BY ALL) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (p, e))")
    return ", ".join(out)


VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM k, range(8) AS r(p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM x WHERE id <= 16),
{_vector_rounds()},
f AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{_ROUNDS} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM c{_ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM k JOIN f USING (id), h"""
