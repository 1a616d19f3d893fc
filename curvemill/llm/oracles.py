"""SQL for DuckDB that gives the rows of the registered queries by plain means, where SQL can express them."""

from __future__ import annotations

import math

from curvemill.llm import secret_scan

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"[^\x20\x09-\x0D]+"
_PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"')


def _found(name: str, pattern: str, group: int = 0) -> str:
    """CTE name: doc_id, start, text m of each match of pattern, and its group v."""
    lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    return f"""{name} AS (SELECT doc_id, f[i] AS m, v[i] AS v, ({lengths.format("g[1:i]")} + {lengths.format("f[1:i-1]")})::BIGINT AS pos FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM
  (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS f, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d) WHERE len(f) > 0))"""


_LEAST = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {round(secret_scan.WINDOW * (math.log2(secret_scan.WINDOW) - least) * 1e6)}" for p, least in secret_scan.CLASSES) + " END"
_ALLOWED = " OR ".join(f"regexp_matches(m, '{p}')" for p in secret_scan.ALLOWED)
_SHOW = "['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || pos || ':' || stop"

SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_found("a", _ASSIGN, 2)}, {_found("k", secret_scan.ACCESS)}, {_found("h", secret_scan.HEX)}, {_found("c", secret_scan.CANDIDATE)},
base AS (SELECT doc_id, 0 AS kind, pos, pos + length(m) AS stop FROM a WHERE length(v) >= 12 UNION ALL SELECT doc_id, 1, pos, pos + length(m) FROM k WHERE length(m) >= 18 UNION ALL SELECT doc_id, 2, pos, pos + length(m) FROM h),
win AS (SELECT doc_id, pos, m, unnest(generate_series(1, length(m) - {secret_scan.WINDOW - 1})) AS w FROM c WHERE NOT ({_ALLOWED})),
chs AS (SELECT doc_id, pos, m, w, ch, count(*) AS n FROM (SELECT *, unnest(string_split(substr(m, w, {secret_scan.WINDOW}), '')) AS ch FROM win) GROUP BY ALL),
ent AS (SELECT doc_id, pos, m, w, sum(round(n * log2(n) * 1e6)) AS s FROM chs GROUP BY ALL),
high AS (SELECT doc_id, 3 AS kind, pos + min(w) - 1 AS lo, pos + max(w) - 1 + {secret_scan.WINDOW} AS stop FROM ent WHERE s <= {_LEAST} GROUP BY doc_id, pos, m),
new AS (SELECT doc_id, kind, lo AS pos, stop FROM high WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = high.doc_id AND b.pos < high.stop AND high.lo < b.stop)),
bs AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({_SHOW}, ',' ORDER BY pos, kind) AS t FROM base GROUP BY 1),
sp AS (SELECT doc_id, string_agg({_SHOW}, ',' ORDER BY pos, kind) AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM new) GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs.t, '')) AS base_sha256, coalesce(sp.t, '') AS spans FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN sp USING (doc_id)"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACES}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
ln AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 85 * (x.n + y.n - nb)),
ed AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
rc(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ed.b, rc.r FROM rc JOIN ed ON ed.a = rc.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN (SELECT doc_id, min(r) AS component_id FROM rc GROUP BY 1) c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _covered(size: str, units: int, part: str, glue: str) -> str:
    """CTEs from covered window starts cov (doc_id, p) and texts tx to what is kept; units: places of a window."""
    return f"""isl AS (SELECT doc_id, p, sum(CASE WHEN p <= prev + {units} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM cov)),
spn AS (SELECT doc_id, min(p) AS lo, max(p) + {units} AS hi FROM isl GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spn UNION ALL SELECT doc_id, max(hi), max({size}) FROM spn JOIN tx USING (doc_id) GROUP BY doc_id),
kep AS (SELECT doc_id, string_agg({part}, '{glue}' ORDER BY a) AS k FROM gap JOIN tx USING (doc_id) WHERE b > a GROUP BY doc_id),
cnt AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spn GROUP BY doc_id)"""


SUBSTRINGS = f"""WITH tx AS (SELECT doc_id, encode(coalesce(text, '')) AS bl, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, md5(bl[p+1:p+100]) AS s FROM (SELECT doc_id, bl, unnest(range(n - 99)) AS p FROM tx WHERE n >= 100)),
one AS (SELECT s, min((doc_id, p)) AS f FROM win GROUP BY s), cov AS (SELECT doc_id, p FROM win JOIN one USING (s) WHERE (doc_id, p) > f),
{_covered("n", 100, "hex(bl[a+1:b])", "")}
SELECT tx.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_removed IS NULL THEN sha256(bl) ELSE sha256(unhex(coalesce(k, ''))) END AS kept_sha256 FROM tx LEFT JOIN cnt USING (doc_id) LEFT JOIN kep USING (doc_id)"""

WINDOWS = f"""WITH tx AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p+1:p+50], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS p FROM tx WHERE len(ws) >= 50)),
one AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s), cov AS (SELECT doc_id, p FROM win JOIN one USING (s) WHERE doc_id > f),
{_covered("len(ws)", 50, "array_to_string(ws[a+1:b], ' ')", " ")}
SELECT tx.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN n_removed IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(k, '') END) AS kept_sha256 FROM tx LEFT JOIN cnt USING (doc_id) LEFT JOIN kep USING (doc_id)"""

_ESCAPE = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
_CONTROL = "'<|im_end|><|im_start|>assistant ok'"
CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', {_CONTROL} UNION ALL SELECT -1, 1, 'assistant', {_CONTROL})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length('<|im_start|>') + length({_ESCAPE.format("role")}) + 1 + length({_ESCAPE.format("t")}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

LEAKS = f"""WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_PLAIN_WORDS}') AS ws FROM benchmark), d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN_WORDS}') AS ws FROM documents),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS s FROM (SELECT doc_id, n, ws, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
oc AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
ht AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM oc) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS k, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM oc) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(h, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated FROM d LEFT JOIN ht USING (doc_id) LEFT JOIN it USING (doc_id)"""

PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS ph, count(*) AS f FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(ws) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k >= 2 AND f >= 100),
u AS (SELECT *, unnest(generate_series(1, k - 1)) AS j, string_split(ph, ' ') AS w FROM c),
s AS (SELECT u.lang, u.k, u.ph, u.f AS a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * u.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM u JOIN t USING (lang)
  JOIN g x ON x.lang = u.lang AND x.k = j AND x.ph = array_to_string(w[1:j], ' ') JOIN g y ON y.lang = u.lang AND y.k = u.k - j AND y.ph = array_to_string(w[j+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM b
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = b.lang AND o.k > b.k AND 100 * o.f >= 100 * b.a AND contains(' ' || o.ph || ' ', ' ' || b.ph || ' ')))
SELECT lang, rank, ph AS phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""

AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
  'E': EXISTS (SELECT 1 FROM d o WHERE o.t = w.t AND o.doc_id < w.doc_id)} AS f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, unnest(['A', 'B', 'C', 'D', 'E']) AS x FROM (SELECT DISTINCT part FROM m)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS bad, count(*) AS n, sum(q) AS q, sum(x) AS x FROM m GROUP BY ALL),
s AS (SELECT g.*, filter_order, step, filter_order[step:step] AS k, list_bool_or([false] || list_transform(string_split(filter_order[1:step-1], ''), lambda y: list_contains(bad, y))) AS gone FROM g, o, (SELECT unnest(generate_series(1, 5)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, k, sum(n) FILTER (NOT gone AND NOT list_contains(bad, k)) AS kept, sum(n) FILTER (NOT gone AND list_contains(bad, k)) AS removed, sum(n) FILTER (gone AND list_contains(bad, k)) AS redundant,
  sum(n) FILTER (bad = [k]) AS unique_fails, sum(q) FILTER (NOT gone AND list_contains(bad, k)) AS good_lost, sum(x) FILTER (NOT gone AND list_contains(bad, k)) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley FROM r"""

ORACLES = {"op2_secret_scan": SECRETS, "op3_near_dedup": NEAR, "op4_suffix_dedup": SUBSTRINGS, "op5_chat_format": CHATS, "op7_decontam": LEAKS, "op10_window_dedup": WINDOWS, "op11_setm": PHRASES, "op12_filter_audit": AUDIT}
