"""DuckDB answers for plans/gridding.py."""

from __future__ import annotations

from specgate.oracle import base as B

P = "doc_id, page"
N = B.NUM
I = f"WITH {B.ITEMS}"
# The six columns of the content grid, as values.
CG = f"""{I}, cg AS (SELECT doc_id, page, item_seq AS line_no, [CASE WHEN item_seq % 3 = 1 THEN name ELSE '' END,
   CASE item_seq % 4 WHEN 0 THEN '+100' WHEN 1 THEN '-100/+200' ELSE '' END, coalesce(method, ''), CASE WHEN unit IS NULL THEN '' ELSE '(' || unit || ')' END,
   CASE item_seq % 6 WHEN 0 THEN '' WHEN 1 THEN 'Max ' || (item_seq + 20) WHEN 2 THEN item_seq || '~' || (item_seq + 30) WHEN 3 THEN CAST(item_seq AS VARCHAR)
     WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN '≥ ' || item_seq ELSE '≤ ' || (item_seq + 40) END ELSE '7 ± 3' END, coalesce(result, '')] AS cs FROM items),
 hd AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS line_no, ['Item', '', 'Method', 'Unit', 'Specifications', 'Lot No. L' || doc_id] AS cs FROM items WHERE item_seq = 1 AND doc_id % 2 = 0),
 al AS (SELECT * FROM cg WHERE len(list_filter(cs, lambda c: c <> '')) > 0 UNION ALL SELECT * FROM hd),
 lc AS (SELECT doc_id, page, line_no, unnest(range(0, 6)) AS col_no, unnest(cs) AS cell FROM al),
 cl AS (SELECT *, CASE WHEN regexp_matches(cell, '^{N}\\s*([~-]|±)\\s*{N}$') THEN cell END AS spec_raw,
   TRY_CAST(replace(regexp_extract(cell, '^≥\\s*({N})$', 1), ',', '.') AS DOUBLE) AS spec_min,
   coalesce(TRY_CAST(replace(regexp_extract(cell, '^[≤<]\\s*({N})$', 1), ',', '.') AS DOUBLE), TRY_CAST(regexp_extract(cell, '^Max ({N})$', 1) AS DOUBLE)) AS spec_max,
   regexp_matches(cell, '^[+\\-]\\d+(/[+\\-]\\d+)?$') AS mesh, regexp_matches(cell, '^[<>≤≥]?\\s*{N}\\s*%?$') AS num,
   regexp_matches(lower(cell), '\\b(iso|en|gb)\\b|method') AS method, regexp_matches(cell, '^\\(.*\\)$') AS unit FROM lc),
 cx AS (SELECT *, num AND NOT mesh AS bare, spec_raw IS NOT NULL OR spec_min IS NOT NULL OR spec_max IS NOT NULL AS spec FROM cl)"""
ROLE = f"""dt AS (SELECT *, bool_or(spec) OVER (PARTITION BY {P}, line_no) AS hs FROM cx WHERE line_no > 0),
 sc AS (SELECT {P}, col_no, count(*) FILTER (hs AND bare) AS r, count(*) FILTER (bare) AS b, count(*) FILTER (spec) AS s,
   count(*) FILTER (spec_max IS NOT NULL) AS up, count(*) FILTER (spec_min IS NOT NULL AND spec_raw IS NULL AND spec_max IS NULL) AS dn FROM dt GROUP BY ALL),
 rc AS (SELECT {P}, CAST(coalesce(first(col_no ORDER BY r DESC, col_no DESC) FILTER (r >= 2), max(col_no) FILTER (b > 0), 5) AS INT) AS result_col FROM sc GROUP BY ALL),
 sp AS (SELECT {P}, CAST(first(col_no ORDER BY s DESC, col_no) AS INT) AS spec_col, first(up ORDER BY s DESC, col_no) AS up, first(dn ORDER BY s DESC, col_no) AS dn
   FROM sc JOIN rc USING ({P}) WHERE col_no <> result_col AND s > 0 GROUP BY ALL),
 ro AS (SELECT {P}, result_col, spec_col, CASE WHEN up > 0 AND dn = 0 THEN 'upper' WHEN dn > 0 AND up = 0 THEN 'lower' ELSE 'mixed' END AS direction FROM rc LEFT JOIN sp USING ({P}))"""
LG = f"""{I}, lg AS (SELECT doc_id, page, item_seq AS line_no, CASE WHEN item_seq % 4 = 3 THEN '' ELSE name END AS n, CASE WHEN item_seq % 3 > 0 THEN item_seq + 0.5 END AS lo,
   CASE WHEN item_seq % 5 > 0 THEN item_seq + 50 END AS hi, result, unit FROM items),
 ld AS (SELECT doc_id, page, line_no, CASE WHEN n <> '' THEN 0 WHEN lo IS NOT NULL THEN 1 ELSE 2 END AS l FROM lg),
 md AS (SELECT {P}, list_sort(list(l))[CAST(floor(count(*) / 2) AS INT) + 1] AS m, bool_or(line_no = 1) AS f FROM ld GROUP BY ALL),
 hh AS (SELECT {P}, CAST(greatest(doc_id % 2 - m, 0) AS INT) AS shift FROM md WHERE f)"""

SQL = {
    "grid_cells": f"{CG} SELECT {P}, line_no, CAST(col_no AS INT) AS col_no, cell FROM lc",
    "classify_cell": f"{CG} SELECT {P}, line_no, CAST(col_no AS INT) AS col_no, spec_raw, spec_min, spec_max, bare, mesh, method, unit FROM cx",
    "align_header": f"""{LG} SELECT {P}, shift, CASE WHEN doc_id % 2 = 1 AND shift = 0 THEN '|' ELSE '' END || 'Item|Lower limit|Max.|Test results|Unit' ||
        CASE WHEN doc_id % 2 = 0 THEN '|' ELSE '' END AS header FROM hh""",
    "detect_limit_header": f"""{LG}, o AS (SELECT *, CASE WHEN doc_id % 2 = 1 AND shift = 0 THEN 1 ELSE 0 END AS k FROM hh)
        SELECT {P}, 1 + k AS lower_at, 2 + k AS upper_at, 3 + k AS result_at, k AS name_at, CAST(NULL AS INT) AS method_at, 4 + k AS unit_at FROM o""",
    "items_from_limit_grid": f"""{LG}, o AS (SELECT *, CASE WHEN doc_id % 2 = 1 AND shift = 0 THEN 1 ELSE 0 END AS k FROM hh),
        c AS (SELECT lg.*, k, [n, CASE WHEN lo IS NULL THEN '' ELSE line_no || ',5 %' END, CASE WHEN hi IS NULL THEN 'n/a' ELSE CAST(hi AS VARCHAR) END, coalesce(result, ''), coalesce(unit, ''), ''] AS cs FROM lg JOIN o USING ({P})),
        s AS (SELECT *, last_value(CASE WHEN cs[k + 1] <> '' AND NOT regexp_matches(cs[k + 1], '^[+\\-]\\s*\\d+$') THEN cs[k + 1] END IGNORE NULLS) OVER (PARTITION BY {P} ORDER BY line_no) AS name,
          TRY_CAST(replace(regexp_extract(cs[k + 2], '^{N}'), ',', '.') AS DOUBLE) AS a, TRY_CAST(replace(regexp_extract(cs[k + 3], '^{N}'), ',', '.') AS DOUBLE) AS b FROM c)
        SELECT {P}, line_no, name, nullif(cs[k + 5], '') AS unit, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS VARCHAR) AS spec_raw, a AS spec_min, b AS spec_max, nullif(cs[k + 4], '') AS result
        FROM s WHERE name IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL OR cs[k + 4] <> '')""",
    "header_row": f"{CG} SELECT {P}, 'L' || doc_id AS lot_no FROM hd",
    "lot_numbers": f"""{CG}, {LG.removeprefix(I).removeprefix(', ')} SELECT {P}, 'content' AS layout, 'L' || doc_id AS lot_no FROM hd WHERE page = 1
        UNION ALL SELECT {P}, 'limits', CASE WHEN doc_id % 3 = 0 THEN 'M-' || doc_id END FROM hh WHERE page > 1""",
    "result_column": f"{CG}, {ROLE} SELECT {P}, result_col FROM ro",
    "spec_column": f"{CG}, {ROLE} SELECT {P}, spec_col, direction FROM ro",
    "items_from_grid": f"""{CG}, {ROLE}, ix AS (SELECT {P}, line_no, first(result_col) AS r, first(spec_col) AS sc, first(direction) AS dir,
          min(col_no) FILTER (mesh AND col_no <> result_col) AS m, min(col_no) FILTER (method AND col_no <> result_col) AS me,
          min(col_no) FILTER (unit AND col_no <> result_col) AS u FROM dt JOIN ro USING ({P}) GROUP BY {P}, line_no),
        s1 AS (SELECT {P}, line_no, arg_min(struct_pack(raw := spec_raw, lo := spec_min, hi := spec_max), col_no) AS sp FROM dt JOIN ix USING ({P}, line_no)
          WHERE spec AND col_no NOT IN (0, r) AND col_no IS DISTINCT FROM m AND col_no IS DISTINCT FROM me AND col_no IS DISTINCT FROM u GROUP BY ALL),
        a AS (SELECT g.*, ix.* EXCLUDE (doc_id, page, line_no), s1.sp, last_value(CASE WHEN cs[1] <> '' THEN cs[1] END IGNORE NULLS) OVER (PARTITION BY g.doc_id, g.page ORDER BY g.line_no) AS sec
          FROM cg g JOIN ix USING ({P}, line_no) LEFT JOIN s1 USING ({P}, line_no)),
        b AS (SELECT *, CASE WHEN sp IS NULL AND dir <> 'mixed' AND regexp_matches(cs[sc + 1], '^[<>≤≥]?\\s*{N}\\s*%?$') AND NOT regexp_matches(cs[sc + 1], '^[+\\-]\\s*\\d+') THEN TRY_CAST(replace(regexp_extract(cs[sc + 1], '^{N}'), ',', '.') AS DOUBLE) END AS v FROM a),
        c AS (SELECT {P}, line_no, trim(coalesce(sec, '') || ' ' || coalesce(cs[m + 1], '')) AS name, nullif(regexp_replace(cs[u + 1], '[()]', '', 'g'), '') AS unit, cs[me + 1] AS method,
          sp.raw AS spec_raw, coalesce(sp.lo, CASE WHEN dir = 'lower' THEN v END) AS spec_min, coalesce(sp.hi, CASE WHEN dir = 'upper' THEN v END) AS spec_max, nullif(cs[r + 1], '') AS result, 'content' AS layout, CASE WHEN doc_id % 2 = 0 THEN 'L' || doc_id END AS lot_no FROM b)
        SELECT * FROM c WHERE name <> '' AND (spec_raw IS NOT NULL OR spec_min IS NOT NULL OR spec_max IS NOT NULL OR result IS NOT NULL)""",
    "orient_grid": f"""{I}, c AS (SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN k ELSE item_seq END AS row_no, CASE WHEN doc_id % 2 = 0 THEN item_seq ELSE k END AS col_no, cell
          FROM (SELECT doc_id, page, item_seq, unnest([0, 1, 2]) AS k, unnest([name, coalesce(spec_raw, ''), coalesce(result, '')]) AS cell FROM items)),
        f AS (SELECT *, regexp_matches(trim(cell), '^[<>]?\\s*\\d+([.,]\\d+)?\\s*%?$') AS n FROM c),
        r AS (SELECT {P}, max(k) AS rm, count(*) AS nr FROM (SELECT {P}, row_no, count(*) FILTER (n) AS k FROM f GROUP BY ALL) GROUP BY ALL),
        q AS (SELECT {P}, max(k) AS cm, count(*) AS nc FROM (SELECT {P}, col_no, count(*) FILTER (n) AS k FROM f GROUP BY ALL) GROUP BY ALL),
        t AS (SELECT *, nr >= 2 AND nc >= 2 AND rm >= 3 AND rm >= cm + 2 AS t FROM r JOIN q USING ({P}))
        SELECT {P}, CASE WHEN t THEN col_no ELSE row_no END AS row_no, CASE WHEN t THEN row_no ELSE col_no END AS col_no, cell, CASE WHEN t THEN 'transposed' ELSE 'normal' END AS orient FROM f JOIN t USING ({P})""",
    "explode_stacked_rows": f"""{I}, s AS (SELECT doc_id, page, item_seq AS row_no, unnest(CASE WHEN item_seq % 3 = 0 THEN [0] ELSE [0, 1, 2] END) AS sub_row, name, result, spec_raw FROM items)
        SELECT {P}, row_no, CAST(sub_row AS INT) AS sub_row, CASE WHEN row_no % 3 = 0 THEN name || '|a/' || coalesce(result, 'b') || '/c|x/y|' || coalesce(spec_raw, '')
        ELSE name || '|' || ['a', coalesce(result, 'b'), 'c'][sub_row + 1] || '|' || ['1', '2', CAST(row_no AS VARCHAR)][sub_row + 1] || '|' || coalesce(spec_raw, '') END AS line FROM s""",
    "best_table": f"""{I}, t AS (SELECT doc_id, page, CASE WHEN item_seq % 2 = 0 THEN 'lines' ELSE 'text' END AS source, item_seq % 3 AS table_seq,
          CAST(sum(CAST(name IS NOT NULL AS INT) + CAST(spec_raw IS NOT NULL AS INT) + CAST(result IS NOT NULL AS INT)) AS BIGINT) AS score FROM items GROUP BY ALL)
        SELECT {P}, first(source ORDER BY source, score DESC, table_seq) AS source, first(table_seq ORDER BY source, score DESC, table_seq) AS table_seq, first(score ORDER BY source, score DESC, table_seq) AS score
        FROM t WHERE score >= CASE WHEN source = 'lines' THEN 4 ELSE 6 END GROUP BY {P}""",
}
