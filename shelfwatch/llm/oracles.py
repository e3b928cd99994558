"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from shelfwatch.llm import decontaminate as d
from shelfwatch.llm.exact_dedup import OP1_SQL
from shelfwatch.llm.filter_audit import OP11_SQL
from shelfwatch.llm.grid_order import OP12_SQL
from shelfwatch.llm.suffix_trees import OP5_SQL


def _tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _seeds(table: str, key: str) -> str:
    """Seeds of every position under every mask."""
    parts = []
    for mask in d.MASKS:
        used = " || ' ' || ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")
        parts.append(
            f"SELECT {key}, i, '{mask}' AS mask, {used} AS seed FROM "
            f"(SELECT {key}, w, unnest(range(1, len(w) - {d.SPAN - 2})) AS i FROM {table} WHERE len(w) >= {d.SPAN})"
        )
    return " UNION ALL ".join(parts)


OP4_SQL = rf"""
WITH docs AS (SELECT doc_id, {_tokens('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT item_id, {_tokens('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
hits AS (
  SELECT DISTINCT doc_id, item_id, s.i - b.i AS shift
  FROM ({_seeds('docs', 'doc_id')}) s JOIN ({_seeds('items', 'item_id')}) b USING (mask, seed)
), laid AS (
  SELECT doc_id, item_id, least({d.WINDOW}, len(items.w)) AS n, len(items.w) AS item_length,
         [CASE WHEN docs.w[p + shift] = items.w[p] THEN 1 ELSE 0 END
          FOR p IN range(greatest(1, 1 - shift), least(len(items.w), len(docs.w) - shift) + 1)] AS eq
  FROM hits JOIN docs USING (doc_id) JOIN items USING (item_id)
), judged AS (
  SELECT *, list_max([list_sum(eq[s:s + n - 1]) FOR s IN range(1, greatest(1, len(eq) - n + 1) + 1)]) AS matches FROM laid
)
SELECT doc_id, item_id, max(n)::BIGINT AS "window", max(matches)::BIGINT AS matches, max(list_sum(eq))::BIGINT AS overlap,
       max(item_length)::BIGINT AS item_length
FROM judged WHERE matches >= ceil(n * {d.SIMILARITY}) GROUP BY doc_id, item_id
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), s AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100
), k AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM k) WHERE first_id < doc_id
), m AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM r
), g AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, a, b, b - a AS gone, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(gone) AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
  FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), near AS (
  SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT near.y, reach.other FROM reach JOIN near ON reach.doc_id = near.x
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_prefix_doubling": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_grid_order": OP12_SQL,
}
