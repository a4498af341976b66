"""SQL (DuckDB) for the corpus queries whose rows SQL can express."""

from __future__ import annotations

from meterlake.llm.url_filter import LIMIT, RULES, STRONGEST, WEAKEST, Z

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Shingles of two words, links by a join on them, components by the least id reached.
OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || chr(32) || w[i + 1] END AS g FROM d, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, doc_id = m.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

#: A word goes if a window over it starts in a document with a smaller id.
OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], chr(32)) AS g FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM v), range(50) AS k(j) WHERE lo < doc_id),
each AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, chr(32) ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_CASE = " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{{}}'" for h, p, _ in _BY_LENGTH)
_RULE, _RULING = ("CASE " + _CASE.format(*column) + " END" for column in ([h + p for h, p, _ in _BY_LENGTH], [v for _, _, v in _BY_LENGTH]))


def _shrunk(level: str, parent: str, on: str, keys: str) -> str:
    """The posterior of ``level`` given the means of ``parent``: method of moments for the prior's strength."""
    return f"""SELECT {keys}, a / (a + b) AS m, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM (
 SELECT {keys}, bad + s * m AS a, n - bad + s * (1 - m) AS b FROM {level} JOIN {parent} USING ({on}) JOIN (
 SELECT {on}, greatest({WEAKEST}, least({STRONGEST}, coalesce(CASE WHEN v > 0 THEN p * (1 - p) / v - 1 ELSE {STRONGEST} END, {STRONGEST}))) AS s FROM (
 SELECT {on}, p, (q - N * p * p - (k - 1) * p * (1 - p)) / nullif(N - n2 / nullif(N, 0), 0) AS v FROM (
 SELECT {on}, CAST(sum(n) AS DOUBLE) AS N, sum(bad) / nullif(CAST(sum(n) AS DOUBLE), 0) AS p, count(*) AS k, sum(bad * bad / nullif(CAST(n AS DOUBLE), 0)) AS q, sum(n * n) AS n2 FROM {level} GROUP BY ALL))) USING ({on}))"""


OP6 = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
o AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM q LEFT JOIN o USING (page_id) GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
top AS (SELECT 0 AS one, (sum(bad) + 0.5) / (sum(n) + 1.0) AS m FROM suffixes),
by_suffix AS (SELECT suffix, m FROM ({_shrunk("suffixes", "top", "one", "suffix")})),
by_domain AS (SELECT domain, suffix, m FROM ({_shrunk("domains", "by_suffix", "suffix", "domain, suffix")})),
by_host AS ({_shrunk("hosts", "by_domain", "domain, suffix", "host")})
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_RULING}, CASE WHEN m - {Z} * sd > {LIMIT} THEN 'block' END, 'allow') AS verdict FROM q JOIN by_host USING (host)"""

_START = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= 8)"""
#: A round: every vector to its nearest centroid, then the floor of the mean of each component.
_ROUND = """a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY 1, 2)"""
_MEANS = """c{j} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM (SELECT cluster, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(k) GROUP BY 1, 2) GROUP BY 1) USING (cluster))"""
OP11 = ", ".join([_START, *[x.format(i=i, j=i + 1) for i in range(10) for x in (_ROUND, _MEANS)], _ROUND.format(i=10)]) + """
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (cluster)"""

#: crc32 bit by bit, the polynomial's bits reversed; the least (cost, label string) by grammar state, turn by turn from the first on.
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0])), lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295)"
_LAST = r"right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
OP12 = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(text="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM t, range(2) AS c(i) WHERE f <> 0 AND (i = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM m),
q AS (SELECT *, left(role, 1) AS ini, {_LAST} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
r AS MATERIALIZED (SELECT *, blank OR again AS must, NOT blank AND NOT again AND {_LAST} NOT IN ('.', '!', '?') AS cut FROM q),
gram AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS x(g, o, h)),
ins AS (SELECT * FROM (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 5), (1, 2, 'I', 5), (2, 3, 'I', 5), (3, 2, 'I', 5), (0, 3, 'II', 10), (1, 3, 'II', 10), (2, 2, 'II', 10), (3, 3, 'II', 10)) AS x(g, h, a, c)),
edit AS (SELECT * FROM (VALUES ('K', 0), ('R', 1), ('D', 2)) AS x(e, c)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, ins.h AS g, ins.c AS c, ins.a AS a FROM (SELECT DISTINCT conv_id FROM r), ins WHERE ins.g = 0
 UNION ALL
 SELECT conv_id, n, g, min(c) AS c, arg_min(a, (c, a)) AS a FROM (
 SELECT dp.conv_id, r.n, ins.h AS g, dp.c + edit.c + ins.c + CASE WHEN r.cut AND e <> 'D' THEN 5 ELSE 0 END AS c, dp.a || e || ins.a AS a
 FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n + 1 CROSS JOIN edit
 LEFT JOIN gram ON gram.g = dp.g AND (e = 'K' AND o = ini OR e = 'R' AND o IN ('u', 'a')) JOIN ins ON ins.g = CASE WHEN e = 'D' THEN dp.g ELSE gram.h END
 WHERE e = 'D' OR NOT must AND gram.h IS NOT NULL) GROUP BY 1, 2, 3),
best AS MATERIALIZED (SELECT conv_id, CAST(min(c) AS BIGINT) AS cost, arg_min(a, (c, a)) AS audit FROM dp JOIN (SELECT conv_id AS of, max(n) AS last FROM r GROUP BY 1) ON of IS NOT DISTINCT FROM conv_id AND last = n WHERE g IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, i, audit[i] AS e, length(replace(audit[1:i], 'I', '')) AS n, length(replace(audit[1:i], 'D', '')) AS j FROM best, unnest(range(1, length(audit) + 1)) AS u(i)),
said AS (SELECT letters.conv_id, j, e, role, text, j = 1 AND e = 'K' AND ini = 's' AS sys FROM letters LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM letters.conv_id AND r.n = letters.n AND e <> 'I' WHERE e <> 'D'),
turned AS (SELECT *, CASE WHEN (j - CASE WHEN max(sys) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END AS made FROM said),
hashed AS (SELECT conv_id, sha256(string_agg(CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN made || ':' || text ELSE made || ':' END, chr(10) ORDER BY j)) AS h FROM turned GROUP BY 1),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
 count(*) FILTER (n > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) w LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM w.conv_id"""

ORACLE_SQL = {"op1_near_dedup": OP1, "op6_url_filter": OP6, "op10_substring_dedup": OP10, "op11_centroids": OP11, "op12_conversation_repair": OP12}
