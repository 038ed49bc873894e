"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op8_preference
from .common import table
from .decontaminate import op7_prefix_containment
from .heap_clusters import op11_heap_bounds
from .html_extract import op1_html_extract
from .jaccard_join import op2_combination_prefix
from .language_id import op9_rank_order
from .mixing import op4_hypergeometric_mix
from .mpeg_audio import op3_mpeg_audio
from .quality_outliers import op13_mcd_outliers
from .sharding import op10_minimax_shards
from .suffix_dedup import op5_deep_shallow
from .vector_codes import op12_equal_average
from .warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": lambda s, d: op1_html_extract(table(s, d, "pages")),
    "op2_combination_prefix": lambda s, d: op2_combination_prefix(table(s, d, "documents")),
    "op3_mpeg_audio": lambda s, d: op3_mpeg_audio(table(s, d, "documents")),
    "op4_hypergeometric_mix": lambda s, d: op4_hypergeometric_mix(table(s, d, "documents")),
    "op5_deep_shallow": lambda s, d: op5_deep_shallow(table(s, d, "documents")),
    "op6_warc": lambda s, d: op6_warc(table(s, d, "pages")),
    "op7_prefix_containment": lambda s, d: op7_prefix_containment(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_preference": lambda s, d: op8_preference(table(s, d, "conversations")),
    "op9_rank_order": lambda s, d: op9_rank_order(table(s, d, "documents")),
    "op10_minimax_shards": lambda s, d: op10_minimax_shards(table(s, d, "documents")),
    "op11_heap_bounds": lambda s, d: op11_heap_bounds(table(s, d, "embeddings")),
    "op12_equal_average": lambda s, d: op12_equal_average(table(s, d, "embeddings")),
    "op13_mcd_outliers": lambda s, d: op13_mcd_outliers(table(s, d, "documents")),
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{pattern}')"


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{k // 4 + 1}] >> {15 - 5 * (k % 4)}) & 31) + 1, 1)" for k in range(32))
_PIECE = "'<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10)"

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"


def _integers(scale: int) -> str:
    return f"list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT))"


def _floor_mean(s: str, n: str) -> str:
    """floor(s / n) of integers."""
    return f"CAST(({s} - ({s} % {n} + {n}) % {n}) // {n} AS BIGINT)"


def _far(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _lloyd(rounds: int) -> str:
    """a0, c1, a1, ...: assignments and centroids by turns, from x(vec_id, v) and c0(c, v)."""
    sql = ""
    for k in range(rounds + 1):
        sql += f", a{k} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (SELECT vec_id, x.v, c, {_far('x.v', 'q.v')} AS d FROM x, c{k} q) GROUP BY vec_id)"
        if k < rounds:
            sums = f"SELECT c, list(s ORDER BY j) AS v FROM (SELECT c, j, {_floor_mean('sum(e)', 'count(*)')} AS s FROM (SELECT m.c AS c, unnest(range(1, 65)) AS j, unnest(v) AS e FROM a{k}) GROUP BY 1, 2) GROUP BY c"
            sql += f", c{k + 1} AS MATERIALIZED (SELECT q.c, coalesce(s.v, q.v) AS v FROM c{k} q LEFT JOIN ({sums}) s USING (c))"
    return sql


def _quantized(rounds: int) -> str:
    """a0, b1, a1, ...: codes and codebooks by turns, from parts x(vec_id, p, v) and b0(p, e, v)."""
    sql = ""
    for k in range(rounds + 1):
        sql += f", a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min({{'d': d, 'e': e}}) AS m FROM (SELECT vec_id, x.p, x.v, e, {_far('x.v', 'q.v')} AS d FROM x JOIN b{k} q ON x.p = q.p) GROUP BY 1, 2)"
        if k < rounds:
            sums = f"SELECT p, e, list(s ORDER BY j) AS v FROM (SELECT p, e, j, {_floor_mean('sum(y)', 'count(*)')} AS s FROM (SELECT p, m.e AS e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS y FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2"
            sql += f", b{k + 1} AS MATERIALIZED (SELECT q.p, q.e, coalesce(s.v, q.v) AS v FROM b{k} q LEFT JOIN ({sums}) s ON q.p = s.p AND q.e = s.e)"
    return sql


ORACLE_SQL: dict[str, str] = {
    "op2_combination_prefix": f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (x) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)""",
    "op5_deep_shallow": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS s, unnest([substr(h, 2 * s + 1, 100) FOR s IN range(0, length(h) // 2 - 49)]) AS x FROM d),
 g AS (SELECT doc_id, s FROM w JOIN (SELECT x, min(doc_id) AS m FROM w GROUP BY 1) USING (x) WHERE m < doc_id),
 i AS (SELECT doc_id, s, CASE WHEN s > coalesce(max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM g),
 j AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i),
 spans AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM j GROUP BY doc_id, k),
 cuts AS (SELECT doc_id, b AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS q FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (coalesce(q, length(h) // 2) - p)), '' ORDER BY p) AS k FROM cuts JOIN d USING (doc_id) GROUP BY 1),
 t AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY 1)
 SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_warc": f"""WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
 q AS (SELECT *, [CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) FOR k IN range(0, 8)] AS v, min(page_id) OVER (PARTITION BY h) AS m FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to, url FROM q""",
    "op7_prefix_containment": f"""WITH d AS (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
 i AS (SELECT item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS x FROM i, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(s) WHERE len(w) > 0),
 dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest([array_to_string(w[s:s + n - 1], ' ') FOR s IN range(1, len(w) - n + 2)]) AS x FROM d, (SELECT DISTINCT n FROM win)),
 h AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (x, n)),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY 1),
 l AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op8_preference": f"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM conversations WHERE conv_id IS NOT NULL),
 a AS (SELECT conv_id, k, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS m FROM o WHERE role = 'assistant'),
 x AS (SELECT a.conv_id, a.k, b.conv_id AS other, b.text AS answer FROM a JOIN a b ON xor(a.conv_id, 1) = b.conv_id AND b.back = 1 WHERE a.nth = ((a.conv_id % a.m) + a.m) % a.m + 1),
 t AS (SELECT conv_id AS pair_id, 0 AS side, k, role, text FROM o UNION ALL SELECT o.conv_id, 1, o.k, o.role, o.text FROM o JOIN x ON o.conv_id = x.conv_id AND o.k < x.k UNION ALL SELECT conv_id, 1, k, 'assistant', answer FROM x),
 q AS (SELECT *, {_PIECE} AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM t),
 n AS (SELECT pair_id, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS least FROM q GROUP BY 1),
 m AS (SELECT c.pair_id, min(c.k) - 1 AS m FROM q c JOIN q d ON c.pair_id = d.pair_id AND c.k = d.k AND c.side = 0 AND d.side = 1 WHERE c.role IS DISTINCT FROM d.role OR c.text IS DISTINCT FROM d.text GROUP BY 1),
 p AS (SELECT n.pair_id, coalesce(m, least) AS np, other FROM n LEFT JOIN m USING (pair_id) LEFT JOIN x ON x.conv_id = n.pair_id),
 u AS (SELECT q.*, np, coalesce(sum(CASE WHEN k > np THEN length(head) + length(body) END) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM q JOIN p USING (pair_id)),
 v AS (SELECT pair_id, string_agg(head || body, '' ORDER BY k) FILTER (side = 0 AND k <= np) AS prompt, string_agg(head || body, '' ORDER BY k) FILTER (side = 0 AND k > np) AS c, string_agg(head || body, '' ORDER BY k) FILTER (side = 1 AND k > np) AS r,
  string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ' ' ORDER BY k) FILTER (side = 0 AND k > np AND role = 'assistant') AS cm, string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ' ' ORDER BY k) FILTER (side = 1 AND k > np AND role = 'assistant') AS rm FROM u GROUP BY 1)
 SELECT pair_id, pair_id AS chosen_id, other AS rejected_id, CAST(np AS INTEGER) AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(c, '') AS chosen, CASE WHEN other IS NOT NULL THEN coalesce(r, '') END AS rejected, coalesce(cm, '') AS chosen_mask, CASE WHEN other IS NOT NULL THEN coalesce(rm, '') END AS rejected_mask FROM p JOIN v USING (pair_id)""",
    "op11_heap_bounds": f"""WITH x AS MATERIALIZED (SELECT vec_id, {_integers(1024)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('3:' || vec_id) AS h FROM x ORDER BY h LIMIT 8)){_lloyd(10)},
 h AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c10)
 SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a10 JOIN h ON h.c = m.c""",
    "op12_equal_average": f"""WITH k AS MATERIALIZED (SELECT vec_id, label, {_integers(256)} AS v FROM embeddings WHERE {_FINITE}),
 x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM k, unnest(range(0, 16)) t(p)),
 b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)){_quantized(2)},
 r AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY 1),
 s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
 SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), s""",
}
