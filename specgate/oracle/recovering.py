"""DuckDB answers for plans/recovering.py: every item against every line of its page."""

from __future__ import annotations

from specgate.oracle import base as B
from specgate.oracle.guarding import num_text, sig, toks, val, vals

ID = "doc_id, page, item_seq"
NUM = B.NUM
OVER = f"len(list_filter(s, lambda w: list_contains({sig('line')}, w)))"
NEED = "greatest(2, ceil(len(s) * 0.6))"
LAST = """sl AS (SELECT doc_id, page, item_seq AS line_no, CASE WHEN item_seq % 11 = 0 THEN '' ELSE name END || '  |  ' || coalesce(result, '-') || '  |  ' ||
  coalesce(spec_raw, coalesce(spec_min, spec_max, '-') || CASE WHEN item_seq % 2 = 0 THEN ' Max' ELSE ' Min.' END) ||
  CASE WHEN item_seq % 3 = 0 THEN '  |  Pass' ELSE '' END AS line FROM items)"""
TAIL = rf"({NUM}\s*[-~]\s*{NUM}|\d+(?:[.,]\d+)?\s*(?:Max|Min)\.?|(?:≤|≥|<|>)\s*{NUM})\s*$"
SPECS = rf"""k AS (SELECT *, trim(regexp_replace(replace(line, '|', ' '), '\s+', ' ', 'g')) AS key FROM sl),
 ls AS (SELECT *, trim(regexp_replace(regexp_extract(trim(regexp_replace(trim(regexp_replace(key, '\s*\b(Pass|Success)$', '')), '[^0-9A-Za-z%.~\-≤≥<>=]+$', '')), '(?i){TAIL}', 1), '\s+', ' ', 'g')) AS sp,
   regexp_matches(regexp_replace(key, '(?i){TAIL}', ''), '[A-Za-z]') AS named FROM k),
 en AS (SELECT doc_id, page, key, arg_min(sp, line_no) AS sp, min(line_no) AS line_no FROM ls WHERE sp <> '' AND named GROUP BY ALL)"""


def cands(cells: str, first: bool) -> str:
    skip = "AND NOT (i = 1 AND regexp_matches(cs[1], '^[1-9][0-9]?$'))" if first else ""
    num = "TRY_CAST(CASE WHEN regexp_matches(replace(c, ' ', ''), '^[-+]?\\d+([.,]\\d+)?$') THEN replace(replace(c, ' ', ''), ',', '.') END AS DOUBLE)"
    kept = f"list_filter(range(1, len({cells}) + 1), lambda i: NOT (i = len({cells}) AND regexp_matches(lower(replace({cells}[i], ' ', '')), '^(0|o|x|passed|failed|pass|fail|accept|reject)$')) {skip.replace('cs', cells)})"
    nums = f"list_transform(list_transform({kept}, lambda i: {cells}[i]), lambda c: {num})"
    return f"list_distinct(list_filter({nums}, lambda x: x IS NOT NULL AND len(list_filter(cl, lambda v: abs(v - x) < 1e-9)) = 0 AND NOT list_contains(cd, regexp_replace({num_text('x')}, '\\D', '', 'g'))))"


CELLS = "list_filter(list_transform(CASE WHEN contains(line, '|') THEN string_split(line, '|') ELSE regexp_split_to_array(line, '\\s{2,}') END, lambda c: trim(c)), lambda c: c <> '')"

SQL = {
    "recover_specs": f"""WITH {B.ITEMS}, {LAST}, {SPECS},
      it AS (SELECT * EXCLUDE (spec_raw, spec_min, spec_max), CASE WHEN lost THEN NULL ELSE spec_raw END AS spec_raw, CASE WHEN lost THEN NULL ELSE spec_min END AS spec_min,
        CASE WHEN lost THEN NULL ELSE spec_max END AS spec_max FROM (SELECT *, doc_id % 2 = 0 OR item_seq % 3 = 0 AS lost FROM items)),
      pg AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (spec_raw IS NULL AND spec_min IS NULL AND spec_max IS NULL) AS b FROM it GROUP BY ALL),
      ec AS (SELECT doc_id, page, count(*) AS e FROM en GROUP BY ALL),
      zp AS (SELECT doc_id, page FROM pg JOIN ec USING (doc_id, page) WHERE n = b AND n = e),
      zi AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY item_seq) AS r FROM it JOIN zp USING (doc_id, page)),
      ze AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS r FROM en JOIN zp USING (doc_id, page)),
      zz AS (SELECT zi.doc_id, zi.page, item_seq, sp FROM zi JOIN ze USING (doc_id, page, r)),
      tg AS (SELECT *, {sig('name')} AS s FROM it WHERE spec_raw IS NULL AND spec_min IS NULL AND spec_max IS NULL AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM zp) AND (doc_id, page) IN (SELECT (doc_id, page) FROM ec)),
      nm AS (SELECT tg.doc_id, tg.page, item_seq, min(sp) AS sp FROM tg JOIN ls ON tg.doc_id = ls.doc_id AND tg.page = ls.page WHERE len(s) >= 2 AND sp <> '' AND {OVER} >= {NEED} GROUP BY 1, 2, 3 HAVING count(DISTINCT sp) = 1)
      SELECT {ID}, coalesce(z.sp, m.sp, spec_raw) AS spec_raw FROM it LEFT JOIN zz z USING ({ID}) LEFT JOIN nm m USING ({ID})""",
    "recover_results": f"""WITH {B.ITEMS}, {B.LINES}, it AS (SELECT * EXCLUDE (result), CASE WHEN item_seq % 2 = 0 THEN result END AS result FROM items),
      tg AS (SELECT *, {sig('name')} AS s, {vals("concat_ws(' ', spec_raw, spec_min, spec_max, method, unit, name)")} AS cl,
        list_transform({toks("concat_ws(' ', spec_raw, spec_min, spec_max, method, unit, name)")}, lambda z: regexp_replace(z, '\\D', '', 'g')) AS cd,
        {sig("concat_ws(' ', spec_raw, spec_min, spec_max)")} AS ss FROM it WHERE result IS NULL AND coalesce(spec_raw, spec_min, spec_max) IS NOT NULL),
      sc AS (SELECT tg.*, l.line_no, l.line, {OVER} AS o, {CELLS} AS cs FROM tg JOIN lines l ON tg.doc_id = l.doc_id AND tg.page = l.page WHERE len(s) >= 2),
      be AS (SELECT *, max(o) OVER (PARTITION BY {ID}) AS m FROM sc), an AS (SELECT *, count(*) OVER (PARTITION BY {ID}) AS c FROM be WHERE o = m AND m >= {NEED}),
      d AS (SELECT *, {cands('cs', True)} AS ca FROM an WHERE c = 1),
      sb AS (SELECT b.doc_id, b.page, b.item_seq, b.line_no, regexp_matches(b.line, '^\\d+\\s*[|]') AS st, {cands('b.cs', False).replace('(cl,', '(b.cl,').replace('(cd,', '(b.cd,')} AS ca,
        len(list_filter(b.ss, lambda w: list_contains({sig('b.line')}, w))) >= greatest(1, ceil(len(b.ss) * 0.5)) AS ok
        FROM d JOIN be b ON d.doc_id = b.doc_id AND d.page = b.page AND d.item_seq = b.item_seq AND b.line_no BETWEEN d.line_no + 1 AND d.line_no + 7 WHERE len(d.ca) = 0 AND len(d.ss) >= 1),
      s2 AS (SELECT {ID}, arg_min(ca[1], line_no) FILTER (ok AND len(ca) = 1) AS v, min(line_no) FILTER (ok AND len(ca) = 1) AS ln, min(line_no) FILTER (st) AS stp FROM sb GROUP BY {ID}),
      f AS (SELECT {ID}, ca[1] AS v FROM d WHERE len(ca) = 1 UNION ALL SELECT {ID}, v FROM s2 WHERE ln IS NOT NULL AND (stp IS NULL OR ln < stp))
      SELECT {ID}, coalesce({num_text('v')}, result) AS result, v IS NOT NULL AS recovered FROM it LEFT JOIN f USING ({ID})""",
    "correct_spec_direction": f"""WITH {B.ITEMS}, {LAST}, tg AS (SELECT *, {sig('name')} AS s, coalesce(spec_min, spec_max) AS v FROM items
        WHERE spec_raw IS NULL AND (spec_min IS NULL) <> (spec_max IS NULL)),
      t AS (SELECT {ID}, min(t) AS t FROM (SELECT tg.doc_id, tg.page, item_seq, CASE WHEN regexp_matches(line, '(^|[^0-9.])' || v || '\\s*[Mm]in') THEN v || ' Min.'
        WHEN regexp_matches(line, '(^|[^0-9.])' || v || '\\s*[Mm]ax') THEN v || ' Max.'
        WHEN regexp_matches(line, '(≤|≥|<|>)\\s*' || v || '($|[^0-9.])') THEN regexp_extract(line, '(≤|≥|<|>)\\s*' || v || '($|[^0-9.])', 1) || ' ' || v END AS t
        FROM tg JOIN sl ON tg.doc_id = sl.doc_id AND tg.page = sl.page WHERE len(s) >= 2 AND {OVER} >= {NEED}) WHERE t IS NOT NULL GROUP BY {ID} HAVING count(DISTINCT t) = 1)
      SELECT {ID}, coalesce(t, spec_raw) AS spec_raw, CASE WHEN t IS NULL THEN spec_min END AS spec_min, CASE WHEN t IS NULL THEN spec_max END AS spec_max FROM items LEFT JOIN t USING ({ID})""",
    "apply_direction_hints": f"""WITH {B.ITEMS}, h AS (SELECT doc_id, page, {sig('name')} AS hs, CAST(coalesce(spec_raw, spec_min, spec_max) AS DOUBLE) + CASE WHEN item_seq % 4 = 0 THEN 1 ELSE 0 END AS hv,
        CASE WHEN item_seq % 2 = 0 THEN 'min' ELSE 'max' END AS dir FROM items WHERE (regexp_full_match(spec_raw, '[0-9]+') OR spec_raw IS NULL) AND coalesce(spec_raw, spec_min, spec_max) IS NOT NULL),
      tg AS (SELECT *, {sig('name')} AS s, CAST(coalesce(spec_raw, spec_min, spec_max) AS DOUBLE) AS v FROM items
        WHERE regexp_full_match(spec_raw, '[0-9]+') OR (spec_raw IS NULL AND (spec_min IS NULL) <> (spec_max IS NULL))),
      m AS (SELECT {ID}, min(dir) AS dir, min(v) AS v FROM tg JOIN h USING (doc_id, page) WHERE abs(hv - v) <= greatest(1e-9, abs(v) * 1e-4)
        AND len(list_filter(s, lambda w: list_contains(hs, w))) >= greatest(1, ceil(len(s) * 0.6)) GROUP BY {ID} HAVING count(DISTINCT dir) = 1)
      SELECT {ID}, CASE WHEN dir IS NULL THEN spec_raw ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) || CASE dir WHEN 'min' THEN ' Min.' ELSE ' Max.' END END AS spec_raw,
        CASE WHEN dir IS NULL THEN spec_min END AS spec_min, CASE WHEN dir IS NULL THEN spec_max END AS spec_max FROM items LEFT JOIN m USING ({ID})""",
    "recover_average": f"""WITH {B.ITEMS}, g AS (SELECT *, (item_seq % 7 + 12) || '.50 %' AS cell, item_seq % 7 + 12.5 AS v, lower(coalesce(spec_raw, '')) AS sk,
        regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nk FROM items), ok AS (SELECT doc_id, page FROM g WHERE item_seq % 8 <> 0 AND doc_id % 3 > 0 GROUP BY 1, 2 HAVING count(*) >= 2),
      dt AS (SELECT * FROM g JOIN ok USING (doc_id, page) WHERE item_seq % 8 <> 0),
      a AS (SELECT doc_id, page, sk, min(cell) AS ca FROM dt WHERE sk <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1),
      b AS (SELECT doc_id, page, nk, min(cell) AS cb FROM dt WHERE nk <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1),
      j AS (SELECT g.*, coalesce(ca, cb) AS f, TRY_CAST(replace(trim(regexp_replace(result, '^[<>≥]\\s*', '')), ',', '.') AS DOUBLE) AS cur FROM g LEFT JOIN a USING (doc_id, page, sk) LEFT JOIN b USING (doc_id, page, nk))
      SELECT {ID}, CASE WHEN f IS NOT NULL AND cur IS DISTINCT FROM CAST(replace(f, ' %', '') AS DOUBLE) THEN f ELSE result END AS result,
        f IS NOT NULL AND cur IS DISTINCT FROM CAST(replace(f, ' %', '') AS DOUBLE) AS averaged FROM j""",
    "recover_spec_column": f"""WITH {B.ITEMS}, g AS (SELECT doc_id, page, item_seq * 2 + k + 1 AS line_no, CASE WHEN k = 1 THEN replace(name, 'e', 'c') ELSE name END AS gn,
        CASE WHEN item_seq % 7 > 0 THEN item_seq % 5 + 1 END AS lo, item_seq % 5 + 11 + CASE WHEN item_seq % 6 = 0 THEN k ELSE 0 END AS hi
        FROM items, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 4 > 0 AND NOT regexp_matches(name, '^(lot|spec)\\b', 'i')),
      gk AS (SELECT *, regexp_replace(lower(gn), '[^a-z0-9]', '', 'g') AS gk FROM g), nk AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nk FROM items),
      nn AS (SELECT DISTINCT doc_id, page, nk FROM nk), kk AS (SELECT DISTINCT doc_id, page, gk FROM gk),
      mt AS (SELECT * FROM nn JOIN kk USING (doc_id, page) WHERE gk = nk OR (greatest(length(gk), length(nk)) >= 6 AND
        (((starts_with(gk, nk) OR starts_with(nk, gk)) AND least(length(gk), length(nk)) >= 5) OR levenshtein(gk, nk) / greatest(length(gk), length(nk)) <= 0.34))),
      vt AS (SELECT doc_id, page, nk, lo, hi, count(*) AS n FROM mt JOIN gk USING (doc_id, page, gk) WHERE lo < hi GROUP BY ALL),
      tp AS (SELECT *, max(n) OVER (PARTITION BY doc_id, page, nk) AS b FROM vt),
      ch AS (SELECT doc_id, page, nk, min(lo) AS lo, min(hi) AS hi FROM tp WHERE n = b AND b >= 2 GROUP BY 1, 2, 3 HAVING count(*) = 1),
      fl AS (SELECT DISTINCT doc_id, page, nk, true AS f FROM mt)
      SELECT {ID}, CASE WHEN lo IS NULL OR regexp_full_match(spec_raw, lo || '\\s*[~-]\\s*' || hi) THEN spec_raw ELSE lo || '~' || hi END AS spec_raw,
        CASE WHEN lo IS NULL THEN spec_min END AS spec_min, coalesce(f, false) AS spec_column
      FROM nk LEFT JOIN ch USING (doc_id, page, nk) LEFT JOIN fl USING (doc_id, page, nk)""",
}
