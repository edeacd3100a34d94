"""The queries of the catalog in DuckDB's SQL, written from their meaning and not from their code."""

from __future__ import annotations

from lamina.catalog import THRESHOLD

_LOG = """
ev AS (
  SELECT event_id, (user_id % 4)::INT AS image_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS layer_idx, event_type,
    't' || ((user_id // 4) % 5) AS top, 't' || ((user_id // 4) % 5) || '/u' || ((user_id // 20) % 6) AS folder,
    json_extract_string(props, '$.k')::INT AS k, layer_idx::BIGINT * 1000000000000 + event_id AS seq
  FROM events
),
wr AS (
  SELECT image_id, layer_idx, event_id AS entry_idx, seq, (k % 2)::INT AS mode, k,
    CASE event_type WHEN 'click' THEN CASE WHEN k % 5 = 0 THEN top ELSE folder END ELSE folder || '/f' || (k % 4) END AS path,
    CASE event_type WHEN 'click' THEN 'Directory' ELSE 'Regular' END AS kind,
    CASE WHEN event_type = 'click' THEN 0 ELSE k * 10 END::BIGINT AS size,
    CASE WHEN event_type = 'view' AND k % 3 = 0 THEN folder || '/f' || ((k // 4) % 6) END AS target
  FROM ev WHERE event_type IN ('click', 'view', 'purchase')
),
mk AS (
  SELECT image_id, CASE event_type WHEN 'error' THEN folder || '/f' || (k % 4) ELSE folder END AS victim,
    event_type = 'error' AS itself, max(seq) AS done
  FROM ev WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3
),
la AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY image_id, path ORDER BY seq DESC) = 1),
sq AS (
  SELECT la.*, seq > coalesce((
    SELECT max(done) FROM mk WHERE mk.image_id = la.image_id AND (starts_with(la.path, victim || '/') OR itself AND la.path = victim)
  ), -1) AS alive
  FROM la
)"""

_TREE = """
pc AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS image_id, r_name, n_name, c_custkey, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
),
lv AS (
  SELECT image_id, r_name || '/' || n_name || '/' || c_custkey AS path, 'Regular' AS kind, (n % 3)::INT AS mode, (700 * (c_custkey % 5))::BIGINT AS size FROM pc
  UNION ALL
  SELECT image_id, r_name || '/' || n_name, 'Directory', (sum(n) % 2)::INT, 0 FROM pc GROUP BY image_id, r_name, n_name
  UNION ALL
  SELECT DISTINCT image_id, r_name, 'Directory', 0, 0 FROM pc
),
idn AS (SELECT *, path || '|' || kind || '|' || mode || '|' || size AS ident FROM lv)"""

_SIGNED = """
up AS (
  SELECT x.image_id, x.path, x.ident, list_transform(range(1, len(string_split(x.path, '/'))), lambda i: array_to_string(string_split(x.path, '/')[1:i], '/')) AS ups FROM idn x
),
chain AS (SELECT image_id, path, ident, unnest(ups) AS anc FROM up),
sig AS (
  SELECT c.image_id, c.path, string_agg(coalesce(a.ident, '-'), ';' ORDER BY c.anc) AS anc_sig
  FROM chain c LEFT JOIN idn a ON a.image_id = c.image_id AND a.path = c.anc GROUP BY 1, 2
),
sgn AS (SELECT idn.*, coalesce(anc_sig, '') AS anc_sig FROM idn LEFT JOIN sig USING (image_id, path)),
cls AS (SELECT ident, anc_sig, list_sort(list(DISTINCT image_id)) AS m FROM sgn GROUP BY 1, 2)"""

_LAYERS = (
    _TREE
    + ","
    + _SIGNED
    + """,
l0 AS (
  SELECT m, path, kind, mode, size, image_id FROM sgn JOIN cls USING (ident, anc_sig)
  QUALIFY row_number() OVER (PARTITION BY m, path ORDER BY image_id) = 1
)"""
)


def _filled(source: str, out: str) -> str:
    """Back-fill of a layer table."""
    return f"""
{out}_need AS (
  SELECT DISTINCT m, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM {source}
),
{out} AS (
  SELECT * FROM {source}
  UNION ALL
  SELECT n.m, n.path, lv.kind, lv.mode, lv.size, lv.image_id FROM {out}_need n
  JOIN lv ON lv.image_id = n.m[1] AND lv.path = n.path
  WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE s.m = n.m AND s.path = n.path)
)"""


def _sizes(source: str) -> str:
    return f"SELECT m, count(*) AS n_entries, (1024 + sum(512 + CASE WHEN kind = 'Regular' THEN ((size + 511) // 512) * 512 ELSE 0 END))::BIGINT AS bytes FROM {source} GROUP BY m"


def _dissolved(source: str, n: int, out: str) -> str:
    """One level of dissolving."""
    return f"""
{out}_sz AS ({_sizes(source)}),
{out}_small AS (SELECT m FROM {out}_sz WHERE len(m) = {n} AND bytes < {THRESHOLD}),
{out}_img AS (SELECT m, unnest(m) AS i FROM {out}_small),
{out}_dest AS (
  SELECT m, i, coalesce((
    SELECT first(k.m ORDER BY len(k.m) DESC, k.m) FROM {out}_sz k
    WHERE len(k.m) < {n} AND list_contains(k.m, g.i) AND list_has_all(g.m, k.m)), [i]) AS dest
  FROM {out}_img g
),
{out}_all AS (
  SELECT * FROM {source} WHERE m NOT IN (SELECT m FROM {out}_small)
  UNION ALL
  SELECT d.dest, s.path, s.kind, s.mode, s.size, s.image_id FROM {source} s JOIN {out}_dest d ON d.m = s.m
),
{out}_one AS (SELECT * FROM {out}_all QUALIFY row_number() OVER (PARTITION BY m, path ORDER BY image_id) = 1),""" + _filled(f"{out}_one", out)


def _damage(source: str) -> str:
    """What the faults that the query puts into these rows must be found as."""
    return f"""
, dm AS (SELECT image_id, path, (strlen(path) + image_id) % 11 AS n FROM {source})
SELECT image_id, path, CASE n WHEN 1 THEN 'mode' WHEN 2 THEN 'size' WHEN 3 THEN 'mode,size' ELSE 'only left' END AS reason FROM dm WHERE n < 5
UNION ALL SELECT image_id, path || '~', 'only right' FROM dm WHERE n = 4"""


_BACKFILLED = _LAYERS + "," + _filled("l0", "l1")
_SHOW = "array_to_string(m, ',') AS images"
_PAGES = """
pg AS (
  SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS image_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS bare FROM pages
),
pn AS (SELECT page_id, image_id, rtrim(bare, '/') AS path FROM pg)"""

ORACLES = {
    "squash_last_write": """
SELECT conv_id::INT AS image_id, role AS path, turn AS entry_idx, strlen(text)::BIGINT AS size, sha256(text) AS content_hash
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1""",
    "squash_with_tombstones": f"WITH {_LOG} SELECT image_id, path, kind, mode, size, layer_idx, entry_idx FROM sq WHERE alive",
    "shadow_rows": f"WITH {_LOG} SELECT image_id, path, kind, layer_idx, entry_idx FROM sq WHERE NOT alive",
    "children_of_files": f"""
WITH {_LOG}, nk AS (SELECT image_id, path, CASE WHEN mode = 1 THEN 'Regular' ELSE kind END AS kind FROM sq WHERE alive)
SELECT a.image_id, a.path, b.kind AS parent_kind FROM nk a JOIN nk b
ON a.image_id = b.image_id AND b.kind <> 'Directory' AND regexp_replace(a.path, '/[^/]*$', '') = b.path AND a.path <> b.path""",
    "marker_decode": f"""
WITH {_LOG} SELECT image_id, CASE event_type WHEN 'error' THEN 'remove' ELSE 'opaque' END AS action,
  CASE event_type WHEN 'error' THEN folder || '/f' || (k % 4) ELSE folder END AS victim, count(*) AS n
FROM ev WHERE event_type IN ('error', 'signup') GROUP BY ALL""",
    "path_normalise": f"""
WITH {_PAGES} SELECT page_id, path, string_split(path, '/')[-1] AS base,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, len(string_split(path, '/'))::BIGINT AS depth FROM pn""",
    "path_prefixes": f"""
WITH {_PAGES}, ex AS (
  SELECT len(string_split(path, '/')) AS d, unnest(range(1, len(string_split(path, '/')))) AS i, path FROM pn
) SELECT array_to_string(string_split(path, '/')[1:i], '/') AS ancestor, count(*) AS n, max(d - 1 - i)::BIGINT AS farthest FROM ex GROUP BY 1""",
    "path_order": f"""
WITH {_PAGES} SELECT image_id, path, lag(path) OVER (PARTITION BY image_id, string_split(path, '/')[1] ORDER BY string_split(path, '/')) AS before
FROM (SELECT DISTINCT image_id, path FROM pn)""",
    "link_closure": f"""
WITH RECURSIVE {_LOG},
lk AS (SELECT image_id, path, target FROM sq WHERE alive AND target IS NOT NULL),
br AS (SELECT * FROM lk WHERE NOT EXISTS (SELECT 1 FROM sq s WHERE s.alive AND s.image_id = lk.image_id AND s.path = lk.target)),
walk AS (
  SELECT image_id, path, target AS here, 0 AS hop FROM br
  UNION ALL
  SELECT w.image_id, w.path, s.target, hop + 1 FROM walk w JOIN sq s ON s.image_id = w.image_id AND s.path = w.here WHERE s.target IS NOT NULL AND hop < 60
),
fin AS (SELECT image_id, path, here, hop FROM walk QUALIFY row_number() OVER (PARTITION BY image_id, path ORDER BY hop DESC) = 1),
st AS (
  SELECT f.image_id, f.path, CASE WHEN hop >= 60 THEN 'cycle' WHEN s.path IS NULL THEN 'missing' WHEN s.kind <> 'Regular' THEN 'not a regular file' END AS fault
  FROM fin f LEFT JOIN sq s ON s.image_id = f.image_id AND s.path = f.here
)
SELECT lk.image_id, lk.path, lk.target AS link_target, st.fault FROM lk LEFT JOIN st USING (image_id, path)
WHERE st.path IS NULL OR st.fault IS NOT NULL""",
    "link_demotion": f"""
WITH RECURSIVE {_LOG},
lk AS (SELECT image_id, path, target FROM sq WHERE alive AND target IS NOT NULL),
br AS (SELECT * FROM lk WHERE NOT EXISTS (SELECT 1 FROM sq s WHERE s.alive AND s.image_id = lk.image_id AND s.path = lk.target)),
walk AS (
  SELECT image_id, path, target AS here, 0 AS hop FROM br
  UNION ALL
  SELECT w.image_id, w.path, s.target, hop + 1 FROM walk w JOIN sq s ON s.image_id = w.image_id AND s.path = w.here WHERE s.target IS NOT NULL AND hop < 60
)
SELECT w.image_id, w.path, s.mode, s.size, s.layer_idx, s.entry_idx FROM walk w JOIN sq s ON s.image_id = w.image_id AND s.path = w.here
WHERE s.target IS NULL AND s.kind = 'Regular'""",
    "identity_key": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::VARCHAR AS n FROM documents)
SELECT doc_id, sha256('64:' || h || '7:Regular3:4201:01:0' || strlen(n) || ':' || n || '64:' || h || '---0:') AS ident FROM d""",
    "naive_membership": """
WITH g AS (SELECT text, array_to_string(list_sort(list(DISTINCT regexp_extract(source, '([0-9]+)$', 1)::INT)), ',') AS images FROM documents GROUP BY text)
SELECT images, count(*) AS n_entries FROM g GROUP BY images""",
    "effective_membership": f"WITH {_TREE}, {_SIGNED} SELECT {_SHOW}, count(*) AS n_classes FROM cls GROUP BY 1",
    "effective_membership_log": f"WITH {_LOG}, idn AS (SELECT image_id, path, path || '|' || kind || '|' || mode || '|' || size AS ident FROM sq WHERE alive), {_SIGNED} SELECT {_SHOW}, count(*) AS n_classes FROM cls GROUP BY 1",
    "subset_layers": f"WITH {_LAYERS} SELECT {_SHOW}, path, kind, mode, size, image_id FROM l0",
    "ancestor_backfill": f"WITH {_BACKFILLED} SELECT {_SHOW}, path, kind, mode, size, image_id FROM l1",
    "ancestor_completeness": f"WITH {_BACKFILLED}, {_filled('l1', 'l2')} SELECT (SELECT count(*) FROM l2) - (SELECT count(*) FROM l1) AS missing",
    "layer_size_estimate": f"WITH {_BACKFILLED}, z AS ({_sizes('l1')}) SELECT {_SHOW}, n_entries, bytes FROM z",
    "size_estimate_texts": """
SELECT regexp_extract(source, '([0-9]+)$', 1)::INT AS image_id, (1024 + sum(512 + ((strlen(coalesce(text, '')) + 511) // 512) * 512))::BIGINT AS bytes
FROM documents GROUP BY 1""",
    "dissolve_small_layers": f"WITH {_BACKFILLED}, {_dissolved('l1', 3, 'l3')}, {_dissolved('l3', 2, 'l2')} SELECT {_SHOW}, path, kind, mode, size, image_id FROM l2",
    "layer_stack": f"""
WITH {_BACKFILLED}, k AS (SELECT DISTINCT m FROM l1), x AS (SELECT unnest(m) AS image_id, m FROM k)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY len(m) DESC, m) - 1 AS position, {_SHOW} FROM x""",
    "dedup_summary": f"""
WITH {_BACKFILLED}, z AS ({_sizes('l1')}), t AS (SELECT sum(len(m) * bytes)::BIGINT AS i, sum(bytes)::BIGINT AS o FROM z)
SELECT i AS inputs_total, o AS outputs_total, i - o AS saved, (((i - o) * 1000 + i // 2) // i)::BIGINT AS saved_permille FROM t""",
    "layer_labels": f"""
WITH {_BACKFILLED}, z AS ({_sizes('l1')})
SELECT CASE len(m) WHEN 1 THEN 'per-image ' ELSE 'shared ' END || chr(123) || array_to_string(m, ',') || chr(125) AS label, bytes,
  CASE len(m) WHEN 1 THEN '—' ELSE '+' || ((len(m) - 1) * bytes) END AS vs_naive FROM z""",
    "set_algebra": f"""
WITH {_BACKFILLED}, s AS (SELECT DISTINCT m FROM l1)
SELECT array_to_string(x.m, ',') AS a, array_to_string(y.m, ',') AS b, array_to_string(list_sort(list_intersect(x.m, y.m)), ',') AS "both",
  list_has_all(y.m, x.m) AS within, array_to_string(list_append(x.m, 7), ',') AS with_7
FROM s x JOIN s y ON list_has_any(x.m, y.m)""",
    "needed_sources": """
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS image_id, l_partkey, l_linenumber AS layer_idx, l_orderkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, l_partkey ORDER BY layer_idx DESC, l_orderkey DESC, l_quantity DESC) = 1)
SELECT DISTINCT image_id, layer_idx FROM w WHERE l_quantity > 0""",
    "squash_volume": """
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS image_id, l_partkey, l_linenumber AS layer_idx, l_orderkey, l_quantity::BIGINT * 10 AS size FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, l_partkey ORDER BY layer_idx DESC, l_orderkey DESC, size DESC) = 1)
SELECT image_id, layer_idx, count(*) AS n, sum(size)::BIGINT AS bytes FROM w GROUP BY 1, 2""",
    "input_accounting": "SELECT source AS image_id, min(lang) AS label, count(*) AS layer_count, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY 1",
    "platform_divergence": """
SELECT field FROM (SELECT 'architecture' AS field, count(DISTINCT lang) > 1 AS d FROM documents
UNION ALL SELECT 'variant', count(DISTINCT doc_id % 2) > 1 FROM documents) WHERE d""",
    "roundtrip_diff": f"WITH {_TREE} {_damage('lv')}",
    "roundtrip_log": f"WITH {_LOG} {_damage('sq WHERE alive')}",
    "mode_bits": """
WITH t AS (SELECT c_custkey, (c_custkey * 37 % 4096)::INT AS m FROM customer)
SELECT c_custkey, m // 2048 % 2 = 1 AS set_uid, m // 1024 % 2 = 1 AS set_gid, m // 512 % 2 = 1 AS sticky,
  m // 256 % 2 = 1 AND m // 32 % 2 = 1 AND m // 4 % 2 = 1 AS all_read,
  (m // 512)::VARCHAR || (m // 64 % 8)::VARCHAR || (m // 8 % 8)::VARCHAR || (m % 8)::VARCHAR AS octal FROM t""",
    "squash_without_meta": f"""
WITH {_LOG.replace("FROM ev WHERE event_type IN ('click', 'view', 'purchase')", "FROM ev WHERE event_type = 'click' OR event_type IN ('view', 'purchase') AND (k < 5 OR event_id % 2 = 1)")}
SELECT image_id, path, kind, size, entry_idx FROM sq WHERE alive""",
    "t0_format": """
WITH t AS (SELECT event_id, least(greatest(epoch_us(ts) // 1000000 * ((event_id % 7 - 3) * 60), -62135596800), 253402300799) AS s FROM events)
SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM t""",
    "scalar_sizes": """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey * 1024 WHEN 2 THEN c_custkey * 1048576 WHEN 3 THEN c_custkey * 1073741824 END::BIGINT AS bytes,
  ((c_custkey + 511) // 512) * 512 AS blocks,
  (SELECT min(n) FROM range(1, 12) r(d), LATERAL (SELECT c_custkey + 2 + d AS n) WHERE strlen(n::VARCHAR) = d)::BIGINT AS record,
  (c_custkey * 1000 + (c_custkey * 3 + 1) // 2) // (c_custkey * 3 + 1) AS permille,
  'sha256:' || substr(sha256(c_custkey::VARCHAR), 1, 12) || '…' AS digest
FROM customer""",
}
