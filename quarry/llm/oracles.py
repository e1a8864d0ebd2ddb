"""DuckDB SQL for those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
links AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS t FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM pages
),
bases AS (
  SELECT url, replace(t, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM links WHERE t <> '' AND NOT starts_with(t, '#')
),
resolved AS (
  SELECT url AS s, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN root || t
    WHEN ends_with(folder, '/') THEN folder || t ELSE folder || '/' || t END AS d FROM bases
),
urls AS (SELECT url AS u FROM pages UNION SELECT s FROM resolved UNION SELECT d FROM resolved),
parts AS (
  SELECT u, translate(regexp_extract(u, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM urls WHERE contains(u, '://')
),
named AS (SELECT u, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node FROM parts),
rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
edges AS (
  SELECT DISTINCT a.node AS s, b.node AS d FROM resolved JOIN named a ON a.u = resolved.s JOIN named b ON b.u = resolved.d WHERE a.node <> b.node
),
ways AS (SELECT s, d FROM edges UNION SELECT d, s FROM edges),
reach AS (SELECT DISTINCT s AS n, s AS o FROM ways UNION SELECT reach.n, ways.d FROM reach JOIN ways ON ways.s = reach.o),
fits AS (
  SELECT n.node, arg_max(r.action, length(r.host || r.path)) AS action FROM (SELECT DISTINCT node, host, path FROM named) n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY 1
),
aliases AS (
  SELECT reach.n, COUNT(*) FILTER (action = 'block') > 0 AND COUNT(*) FILTER (action = 'allow') = 0 AS blocked FROM reach LEFT JOIN fits ON fits.node = reach.o GROUP BY 1
),
own AS (
  SELECT p.page_id, p.url, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL
)
SELECT page_id, own.host, own.path, rule, COALESCE(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN named ON named.u = own.url LEFT JOIN aliases ON aliases.n = named.node
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix|' || COALESCE(doc_id::VARCHAR, '')) AS k FROM documents
),
t AS (SELECT source, SUM(size)::BIGINT AS s FROM d GROUP BY 1),
n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM t),
w AS (SELECT *, ([1, 2, 3][i % 3 + 1])::DOUBLE AS w, 3 * s AS cap FROM n),
l AS (
  SELECT *, CAST(SUM(s) OVER () - COALESCE(SUM(cap) OVER b, 0) AS DOUBLE) / (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (SELECT source, s, LEAST(CAST(cap AS DOUBLE), MAX(level) OVER () * w) AS target FROM l),
b AS (
  SELECT d.doc_id, d.size, g.s, g.target, LEAST(3 * g.s, CAST(ROUND(g.target) AS BIGINT)) AS budget,
    COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source
),
e AS (SELECT *, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, s AS source_size, target, CAST(size * epochs + LEAST(size, GREATEST(0, budget - epochs * s - before)) AS BIGINT) AS taken FROM e
"""

OP8 = r"""
WITH h AS (SELECT doc_id, length(COALESCE(text, '')) AS c, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, FIRST_VALUE(doc_id) OVER w AS keep_id, COUNT(*) OVER (PARTITION BY s) AS group_size, ROW_NUMBER() OVER w = 1 AS kept, s AS text_sha256
FROM h WINDOW w AS (PARTITION BY s ORDER BY c DESC, doc_id NULLS LAST)
"""

OP9 = r"""
WITH c AS (SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
d AS (SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c q, c WHERE q.id % 20 = 0 AND c.id <> q.id),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance FROM d)
SELECT * FROM r WHERE rank <= 10
"""

def _op11() -> str:
    """Cheapest edits by a forward program over all rows, with the least letters and the repaired lines of each last role."""

    def added(state: str, cost: str, letters: str, lines: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 'l': {state}.l || {lines}}}"

    def kept(role: str, name: str, ways: dict[str, str]) -> str:
        """The least way to be after this row with this last role: ``ways`` has what is inserted after each earlier one."""
        letter, fee = f"IF(r.kind = '{role}', 'K', 'R')", f"r.extra + IF(r.kind = '{role}', 0, 1)" if role != "s" else "r.extra + IF(r.kind = 's', 0, 1000000000)"
        line = f"[IF(r.kind = '{role}', r.role, '{name}') || ':' || r.text]"
        options = [added(f"p.{role}", "2", "'D'", "[]::VARCHAR[]")]
        for state, more in ways.items():
            options.append(added(f"p.{state}", f"{5 * bool(more)} + {fee}", f"{chr(39) + 'I' * bool(more) + chr(39)} || {letter}", (f"['{more}:'] || " if more else "") + line))
        return f"list_sort([{', '.join(options)}])[1]"

    far = "{'c': 1000000000::BIGINT, 'a': '', 'l': []::VARCHAR[]}"
    return rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)
  ), 4294967295::BIGINT) % 20 AS f FROM conversations
),
damaged AS (
  SELECT conv_id, turn, IF(f = 4, 'user', role) AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit
),
ordered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[ 	-]+$', '') AS shown, IF(role = '', '?', left(role, 1)) AS kind FROM damaged
),
faults AS (
  SELECT *, CASE WHEN shown = '' THEN 1 WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    COALESCE(LAG(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind NOT IN ('su', 'ua', 'au'), FALSE) AS odd FROM ordered
),
rows AS (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS extra FROM faults),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS n, {far} AS s, {far} AS u, {far} AS a FROM conversations
  UNION ALL
  SELECT p.conv_id, r.i, {added("p.n", "2", "'D'", "[]::VARCHAR[]")}, {kept("s", "-", {"n": ""})},
    {kept("u", "user", {"n": "", "s": "", "a": "", "u": "assistant"})},
    {kept("a", "assistant", {"n": "user", "s": "user", "a": "user", "u": ""})}
  FROM steps p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
),
ends AS (
  SELECT conv_id, list_sort([n, {added("s", "10", "'II'", "['user:', 'assistant:']")}, {added("u", "5", "'I'", "['assistant:']")}, a])[1] AS best FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM steps
  ) WHERE last = 1
),
counts AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 1) AS blank, COUNT(*) FILTER (fault = 2) AS duplicate,
    COUNT(*) FILTER (fault = 3) AS truncated, COUNT(*) FILTER (odd) AS illegal FROM rows GROUP BY 1
)
SELECT e.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(COALESCE(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _op13(clusters: int = 16, rounds: int = 3) -> str:
    """Plain rounds: every vector meets every centroid."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, n, v, arg_min(c, d * 1000 + c)::INTEGER AS c, MIN(d)::BIGINT AS d FROM (
    SELECT x.vec_id, x.n, x.v, y.c, list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{r} y
  ) GROUP BY ALL
)"""
    move = """
s{r} AS (SELECT c, i, SUM(e)::BIGINT AS s, COUNT(*)::BIGINT AS k FROM (SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT c, list(s // k - CASE WHEN s % k < 0 THEN 1 ELSE 0 END ORDER BY i) AS v FROM s{r} GROUP BY 1),
c{n} AS MATERIALIZED (SELECT c{r}.c, COALESCE(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)"""
    steps = [
        """
x AS MATERIALIZED (
  SELECT vec_id, ROW_NUMBER() OVER () AS n, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
)""",
        f"""
c0 AS MATERIALIZED (
  SELECT (ROW_NUMBER() OVER (ORDER BY k, v) - 1)::INTEGER AS c, v FROM (SELECT sha256('1:' || vec_id) AS k, v FROM x WHERE vec_id IS NOT NULL ORDER BY k, v LIMIT {clusters})
)""",
    ]
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, n=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""
WITH {",".join(steps)},
h AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, c AS cluster, d AS distance, (SUM(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (SUM(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


ORACLES = {"op2_urls": OP2.strip(), "op4_mix": OP4.strip(), "op8_exact": OP8.strip(), "op9_top_k": OP9.strip(), "op11_repair": _op11().strip(), "op13_clusters": _op13().strip()}
