"""DuckDB SQL for the queries of this subpackage that SQL can express; each is a plain, independent statement of the contract."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w)
), n AS (
  SELECT w.doc_id, coalesce(c.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c USING (doc_id)
), e AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON n.doc_id = c.a
""".replace("{lower}", _LOWER)

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER k, 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS left_weight,
         3 * source_size / weight AS fill FROM s
  WINDOW k AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT left_size / left_weight AS level FROM f WHERE left_size * weight <= 3 * source_size * left_weight ORDER BY fill, source NULLS LAST LIMIT 1
), g AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0 AS u FROM f, l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS share,
         row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size = 0 THEN 1 ELSE floor(log2(size)) + 1 END, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % n.cells, 0), size, doc_id NULLS LAST) AS k
  FROM (SELECT greatest(64, ceil(count(*) / 65536.0)::BIGINT) AS cells FROM d) n, d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       ((floor(u::DOUBLE + share * k) - floor(u::DOUBLE + share * (k - 1)))::BIGINT * size)::BIGINT AS taken
FROM r
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)
), k AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1
), e AS (
  SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 1 ELSE 0 END AS cut FROM k
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run
), p AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS done FROM r
), q AS (
  SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(d.x, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept
  FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(q.kept || substr(d.x, 2 * q.last + 1), d.x))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""

OP9 = r"""
WITH t AS (
  SELECT item_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT item_id, ws[i:i+9] AS win FROM (
    SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, least(len(ws), 1)))) AS i FROM t)
), d AS (
  SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d
), m AS (
  SELECT pos.doc_id, pos.i, len(p.win) AS n, p.item_id
  FROM pos JOIN p ON pos.word = p.win[1] JOIN d ON d.doc_id = pos.doc_id WHERE d.ws[pos.i:pos.i + len(p.win) - 1] = p.win
), h AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
""".replace("{lower}", _LOWER)

OP1 = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)
), l AS (
  SELECT line, translate(line, 'éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍáúÁÚàÀâî', {codes}) AS bytes, length(line) AS n, min((doc_id, no)) AS first
  FROM o WHERE length(line) >= 20 GROUP BY line
), e AS MATERIALIZED (
  SELECT x.line AS a, y.line AS b FROM l x JOIN l y ON y.n BETWEEN x.n - 2 AND x.n + 2 AND x.line <> y.line
  WHERE abs(length(replace(x.line, 'e', '')) - length(replace(y.line, 'e', ''))) <= 2
    AND abs(length(replace(x.line, 't', '')) - length(replace(y.line, 't', ''))) <= 2
    AND levenshtein(x.bytes, y.bytes) <= 2
), r AS (
  SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT l.line, coalesce(min(f.first), min(l.first)) AS stay, (SELECT count(*) FROM e WHERE e.a = l.line) AS links
  FROM l LEFT JOIN r ON r.a = l.line LEFT JOIN l f ON f.line = r.b GROUP BY l.line
), j AS (
  SELECT o.doc_id, o.no, o.raw, k.line IS NOT NULL AS judged, coalesce(k.links, 0) AS links, k.line IS NOT NULL AND (o.doc_id, o.no) <> k.stay AS gone
  FROM o LEFT JOIN k ON k.line = o.line
), d AS (
  SELECT doc_id, count(*) FILTER (judged) AS n_lines, sum(links) AS n_links, count(*) FILTER (gone) AS n_dropped, string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone) AS kept
  FROM j GROUP BY doc_id
)
SELECT t.doc_id, coalesce(d.n_lines, 0)::BIGINT AS n_lines, coalesce(d.n_links, 0)::BIGINT AS n_links, coalesce(d.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(d.kept, '')) AS kept_sha256
FROM documents t LEFT JOIN d USING (doc_id)
""".replace("{codes}", " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 32), *map(ord, "{}~")]))  # one byte for each letter beyond ASCII: levenshtein here counts bytes

OP3 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), v AS (
  SELECT lang, list(w) AS commons FROM (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k, sum(n) OVER (PARTITION BY lang) AS whole
    FROM (SELECT lang, lower(w) AS w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM t) GROUP BY ALL)) WHERE k <= 20 AND n >= 0.002 * whole GROUP BY lang
), c AS (
  SELECT t.*, coalesce(v.commons, []::VARCHAR[]) AS commons, [len(regexp_extract_all(text, p)) FOR p IN ['[\x20\x09-\x0D]', '[A-Z]', '[0-9]', '[#*$%&|<>]', '[.,;:!?\x27\x22()\-]', '[^\x00-\x7F]']] AS k FROM t LEFT JOIN v USING (lang)
), g AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times
      FROM (SELECT doc_id, i, ws[i:i+4] AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM t WHERE len(ws) > 5))
    ) WHERE times > 1) GROUP BY doc_id
), h AS (
  SELECT *, list_append(k, length(text) - list_sum(k)) AS classes, list_append(m, len(ws) - coalesce(list_sum(m), 0)) AS hist
  FROM (SELECT *, [len(list_filter(ws, lambda w: lower(w) = x)) FOR x IN commons] AS m FROM c)
), r AS (
  SELECT lang, count(*) AS docs, sum(len(ws)) AS words, list(classes) AS cs, list(hist) AS hs FROM h GROUP BY lang
), q AS (
  SELECT lang, words, [list_sum([x[i] FOR x IN cs]) FOR i IN range(1, len(cs[1]) + 1)] AS qc, [list_sum([x[i] FOR x IN hs]) FOR i IN range(1, len(hs[1]) + 1)] AS qh FROM r
), d AS (
  SELECT h.doc_id, len(ws) AS n, length(text) - k[1] AS word_chars, k[4] AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, q.words,
         [x / list_sum(classes)::DOUBLE FOR x IN classes] AS pc, [x / list_sum(qc)::DOUBLE FOR x IN qc] AS rc,
         [x / list_sum(hist)::DOUBLE FOR x IN hist] AS ph, [x / list_sum(qh)::DOUBLE FOR x IN qh] AS rh
  FROM h JOIN q USING (lang)
), e AS (
  SELECT d.*, coalesce(g.n, 0) AS n_repeat,
         sqrt(greatest(list_sum([CASE WHEN pc[i] > 0 THEN pc[i] * log2(pc[i] / ((pc[i] + rc[i]) / 2)) ELSE 0 END + CASE WHEN rc[i] > 0 THEN rc[i] * log2(rc[i] / ((pc[i] + rc[i]) / 2)) ELSE 0 END FOR i IN range(1, len(pc) + 1)]) / 2, 0)) AS dc,
         sqrt(greatest(list_sum([CASE WHEN ph[i] > 0 THEN ph[i] * log2(ph[i] / ((ph[i] + rh[i]) / 2)) ELSE 0 END + CASE WHEN rh[i] > 0 THEN rh[i] * log2(rh[i] / ((ph[i] + rh[i]) / 2)) ELSE 0 END FOR i IN range(1, len(ph) + 1)]) / 2, 0)) AS dw
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
       n < 10 OR 100 * n_repeat > 20 * n AS base_failed,
       NOT (n < 10 OR 100 * n_repeat > 20 * n) AND (n < 50 OR words < 1000 OR (dc <= 0.14 + 1.3 / sqrt(n) AND dw <= 0.08 + 2.4 / sqrt(n))) AS kept
FROM e
"""



def _kmeans(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """k-means by components: every round compares every vector with every centroid."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}
), p AS MATERIALIZED (
  SELECT vec_id, unnest(range({dims})) AS j, unnest(x) AS x FROM v
), c0 AS MATERIALIZED (
  SELECT n AS cluster, unnest(range({dims})) AS j, unnest(x) AS x
  FROM (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS n, x FROM v) WHERE n < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT vec_id, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM (
      SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM p JOIN c{i} c ON p.j = c.j GROUP BY ALL
    )
  ) WHERE r = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (
  SELECT a.cluster, p.j, sum(p.x)::BIGINT AS s, count(*) AS n FROM p JOIN a{i} a USING (vec_id) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.j, coalesce(m.s // m.n - CASE WHEN m.s % m.n < 0 THEN 1 ELSE 0 END, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster, j)
)"""
            )
    return ", ".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) h USING (cluster)
"""


OP11 = _kmeans()

OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, unnest(range(len(x))) AS j, unnest(x) AS x FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM p q JOIN p c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _repair() -> str:
    """The cheapest edits row by row, forwards: the best (cost, audit, repaired lines) for each of the pattern's states; no row, no entry."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = "range(256)"
    for _ in range(8):
        crc = f"[{bit} FOR c IN {crc}]"
    least = lambda *of: f"list_min([x FOR x IN [{', '.join(of)}] IF x.c IS NOT NULL])"
    more = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}}"
    insert = lambda s, role: more(s, 2, "I", f"[{role!r} || ':']")
    delete = lambda s: more(s, 3, "D", "[]::VARCHAR[]")
    keep = lambda s, initial: more(s, f"CASE WHEN NOT gone AND initial = {initial!r} THEN cut END", "K", "[role || ':' || text]")
    rerole = lambda s, role: more(s, "CASE WHEN NOT gone THEN 2 + cut END", "R", f"[{role!r} || ':' || text]")
    closed = f"""
    SELECT conv_id, i, s0, s1, u AS s2, {least("a0", insert("u", "assistant"))} AS s3
    FROM (SELECT conv_id, i, s0, s1, a0, {least("u0", insert("s0", "user"), insert("s1", "user"), insert("a0", "user"))} AS u FROM"""
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, [ord(b)::BIGINT FOR b IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS how
  FROM conversations, (SELECT {crc} AS t)
), b AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE how <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM b
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o
), f AS MATERIALIZED (
  SELECT *, NOT blank AND nth > 1 AS duplicate, blank OR nth > 1 AS gone,
         CASE WHEN NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n
), dp AS (
  SELECT * FROM ({closed} (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, {{'c': NULL::INTEGER, 'a': '', 'r': []::VARCHAR[]}} AS s1,
           {{'c': NULL::INTEGER, 'a': '', 'r': []::VARCHAR[]}} AS u0, {{'c': NULL::INTEGER, 'a': '', 'r': []::VARCHAR[]}} AS a0 FROM f)))
  UNION ALL
  SELECT * FROM ({closed} (
    SELECT f.conv_id, f.i, {delete("s0")} AS s0, {least(delete("s1"), keep("s0", "s"))} AS s1,
           {least(delete("s2"), keep("s0", "u"), keep("s1", "u"), keep("s3", "u"), rerole("s0", "user"), rerole("s1", "user"), rerole("s3", "user"))} AS u0,
           {least(delete("s3"), keep("s2", "a"), rerole("s2", "assistant"))} AS a0
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)))
), e AS (
  SELECT conv_id, {least("s0", "s3")} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM dp) WHERE back = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12 = _repair()

ORACLES = {"op1_line_dedup": OP1, "op3_quality_rules": OP3, "op5_minhash": OP5, "op7_mixing": OP7, "op8_suffix_dedup": OP8, "op9_decontamination": OP9, "op11_ball_kmeans": OP11, "op12_conversation_repair": OP12, "op13_top_k": OP13}
