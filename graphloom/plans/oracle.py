"""The canon binding once more, in SQL: common table expressions that every oracle starts from."""

from __future__ import annotations


def _node(kind: str, key: str, name: str, path: str, parent: str, layer: str, language: str, source: str) -> str:
    return f"SELECT '{kind}:' || {key} AS id, 'canon' AS parser_id, '{kind}' AS kind, {name} AS name, '{kind}.' || {name} AS qualified_name, {language} AS language, {path} AS path, {parent} AS parent_id, '{layer}' AS layer FROM {source}"


def _edge(kind: str, src: str, dst: str, layer: str, protocol: str, path: str, source: str) -> str:
    return f"SELECT 'canon:{kind}:' || {src} || '->' || {dst} AS id, 'canon' AS parser_id, '{kind}' AS type, {src} AS src, {dst} AS dst, {path} AS path, '{layer}' AS layer, {protocol} AS protocol FROM {source}"


_NULL = "NULL::VARCHAR"
CANON = f"""
WITH RECURSIVE places AS (
  SELECT n_nationkey, n_name, r_regionkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey
), customers AS (
  SELECT c_custkey, c_name, n_nationkey, place || '/' || c_name AS c_path FROM customer JOIN places ON c_nationkey = n_nationkey
), system AS (
  {_node("broker", "r_regionkey", "r_name", "r_name", _NULL, "system", _NULL, "region")}
  UNION ALL {_node("service", "n_nationkey", "n_name", "place", _NULL, "system", _NULL, "places")}
  UNION ALL {_node("external_api", "s_suppkey", "s_name", "place || '/' || s_name", "'service:' || s_nationkey", "system", _NULL, "supplier JOIN places ON s_nationkey = n_nationkey")}
  UNION ALL {_node("http_endpoint", "c_custkey", "c_name", "c_path", "'service:' || n_nationkey", "system", _NULL, "customers")}
  UNION ALL {_node("message_type", "p_partkey", "p_name", "p_brand", _NULL, "system", _NULL, "part")}
), classes AS (
  {_node("class", "o_orderkey", "'Order' || o_orderkey", "c_path || '/Order' || o_orderkey", "'http_endpoint:' || o_custkey", "code", "['typescript', 'python', 'java', 'csharp', 'cpp'][(o_orderkey % 5 + 1)::INT]", "orders JOIN customers ON o_custkey = c_custkey")}
), methods AS (
  SELECT CASE WHEN n = 1 THEN base_id ELSE base_id || ':dup:' || n END AS id, base_id, 'method' AS kind, parent_id, name FROM (
    SELECT 'method:' || l_orderkey || ':' || l_linenumber AS base_id, 'class:' || l_orderkey AS parent_id, l_returnflag AS name,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)
), nodes AS (
  SELECT * FROM system UNION ALL SELECT * FROM classes UNION ALL SELECT id, 'canon', kind, name, 'method.' || name, NULL, NULL, parent_id, 'code' FROM methods
), lines AS (
  SELECT l_suppkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), edges AS (
  {_edge("connects_to", "'service:' || n_nationkey", "'broker:' || r_regionkey", "system", _NULL, _NULL, "places")}
  UNION ALL {_edge("exposes", "'service:' || n_nationkey", "'http_endpoint:' || c_custkey", "system", _NULL, "c_path", "customers")}
  UNION ALL {_edge("http_calls", "'service:' || s_nationkey", "'http_endpoint:' || o_custkey", "system", "CASE WHEN o_custkey % 2 = 0 THEN 'http' END", _NULL, "(SELECT DISTINCT s_nationkey, o_custkey FROM lines JOIN supplier ON l_suppkey = s_suppkey)")}
  UNION ALL {_edge("consumes", "'http_endpoint:' || o_custkey", "'message_type:' || l_partkey", "system", _NULL, _NULL, "(SELECT DISTINCT o_custkey, l_partkey FROM lines)")}
  UNION ALL {_edge("contains", "'http_endpoint:' || o_custkey", "'class:' || o_orderkey", "code", _NULL, _NULL, "orders")}
  UNION ALL {_edge("contains", "parent_id", "id", "code", _NULL, _NULL, "methods")}
), runs AS (
  SELECT 'run:' || day AS id, day AS started_at, ['success', 'partial', 'failed'][(node_count % 3 + 1)::INT] AS status, ['success', 'partial', 'success', 'failed'][(users % 4 + 1)::INT] AS ingest_status,
    node_count, node_count % 2 = 1 AS incremental, users % 3 AS deleted, ['parsers', 'ai'][(users % 2 + 1)::INT] AS graph_builder
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS node_count, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
), ready AS (
  SELECT * FROM runs WHERE status IN ('success', 'partial') AND ingest_status IN ('success', 'partial')
), files AS (
  SELECT path, min_by(mtime_ms, page_id) AS mtime_ms, min_by(size, page_id) AS size, min(page_id) AS page_id FROM (
    SELECT regexp_replace(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '/$', '') AS path, page_id * 1000 AS mtime_ms, length(html) AS size, page_id FROM pages) GROUP BY path
), steps AS (
  SELECT path, unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS a FROM files
), elements AS (
  SELECT 'el:' || path AS id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent_path, type, ['auto_found', 'needed', 'found', 'not_needed', 'ignored'][(n % 5 + 1)::INT] AS status, n % 7 <> 0 AS is_active, n % 3 = 0 AS status_manually_set
  FROM (SELECT path, 'file' AS type, page_id AS n FROM files UNION ALL SELECT DISTINCT a, 'directory', length(a) FROM steps WHERE a NOT IN (SELECT path FROM files))
), up AS (
  SELECT id, unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')) + 1)]) AS a, path FROM elements
)
"""
