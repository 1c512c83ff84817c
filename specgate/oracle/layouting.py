"""DuckDB answers for plans/layouting.py."""

from __future__ import annotations

from specgate.oracle import base as B

P = "doc_id, page"
ID = "doc_id, page, item_seq"
TK = f"WITH {B.ITEMS}, {B.TOKENS}"
MED = f"md AS (SELECT {P}, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM tokens WHERE y2 > y1 GROUP BY ALL)"


def rows(src: str = "tokens", out: str = "rw", med: str = "md") -> str:
    return f"""{out}0 AS (SELECT t.*, m, CASE WHEN y - lag(y) OVER w <= greatest(8, 0.6 * m) THEN 0 ELSE 1 END AS nw FROM {src} t JOIN {med} USING ({P})
      WINDOW w AS (PARTITION BY {P} ORDER BY y, token_seq)),
      {out} AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY {P} ORDER BY y, token_seq) - 1 AS BIGINT) AS row_no FROM {out}0)"""


TEXT = f"""tl0 AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY {P} ORDER BY token_seq)) <= 2 THEN 0 ELSE 1 END AS nw FROM tokens),
 tl AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY {P} ORDER BY token_seq) - 1 AS BIGINT) AS row_no FROM tl0)"""
ANCH = f"""xa AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY {P} ORDER BY x, token_seq) <= 10 THEN 0 ELSE 1 END AS xn FROM tl),
 xb AS (SELECT *, sum(xn) OVER (PARTITION BY {P} ORDER BY x, token_seq) AS i FROM xa), an AS (SELECT {P}, i, avg(x) AS c FROM xb GROUP BY ALL),
 nr AS (SELECT t.doc_id, t.page, t.row_no, t.token_seq, t.x, t.text, arg_min(i, abs(t.x - c) * 1e6 + i) AS col FROM tl t JOIN an a ON t.doc_id = a.doc_id AND t.page = a.page GROUP BY ALL),
 ce AS (SELECT {P}, row_no, col, trim(string_agg(text, ' ' ORDER BY x, token_seq)) AS cell FROM nr GROUP BY ALL)"""
BANDS = f"""{rows()}, ba AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY {P} ORDER BY x, token_seq) <= greatest(1.5 * m, 16) THEN 0 ELSE 1 END AS bn FROM rw),
 bb AS (SELECT *, sum(bn) OVER (PARTITION BY {P} ORDER BY x, token_seq) - 1 AS i FROM ba), ed AS (SELECT {P}, i, min(x) AS e FROM bb GROUP BY ALL),
 pl AS (SELECT t.doc_id, t.page, row_no, token_seq, x, text, arg_min(e.i, abs(x - e) * 1e6 + e.i) AS col FROM rw t JOIN ed e ON t.doc_id = e.doc_id AND t.page = e.page GROUP BY ALL),
 cc AS (SELECT {P}, row_no, col, string_agg(text, ' ' ORDER BY x, token_seq) AS cell FROM pl GROUP BY ALL),
 mx AS (SELECT {P}, row_no, max(col) AS mc, map_from_entries(list((col, cell))) AS mp FROM cc GROUP BY ALL)"""
SV = f"""WITH {B.ITEMS}, op AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN item_seq * 3 ELSE 100 - item_seq * 3 END AS o FROM items),
 r AS (SELECT {ID}, o, CASE WHEN item_seq % 7 = 6 THEN 'Ash' ELSE 'Particle Size' END AS name, item_seq % 4 + 1.0 AS lo, item_seq % 4 + 21.0 AS hi, item_seq * 2.0 AS v FROM op WHERE item_seq % 5 > 0),
 -- the opening stands first on its own line and the limit follows; a number other than the opening must follow the limit
 j AS (SELECT *, v <> o AS shifted FROM r),
 e AS (SELECT *, CASE WHEN shifted THEN 'SKIP' WHEN o = lo OR o = hi THEN 'SKIP' WHEN o BETWEEN lo AND hi THEN 'PASS' ELSE 'FAIL' END AS st,
   CASE WHEN shifted AND NOT (o = lo OR o = hi) THEN 'COLUMN_SHIFT' WHEN o = lo OR o = hi THEN 'BOUNDARY' WHEN o BETWEEN lo AND hi THEN ''
     WHEN o <> 0 AND ((o / 10 BETWEEN lo AND hi) OR (o / 100 BETWEEN lo AND hi)) THEN 'OUTSIDE_DECIMAL_RISK' ELSE 'OUTSIDE' END AS rc FROM j),
 ok AS (SELECT {P} FROM (SELECT *, o > lag(o) OVER (PARTITION BY {P} ORDER BY item_seq) AS up FROM e WHERE st = 'SKIP' AND shifted AND name = 'Particle Size')
   WHERE doc_id % 4 < 3 AND ({P}) IN (SELECT ({P}) FROM items WHERE item_seq = 1) GROUP BY {P} HAVING NOT coalesce(bool_or(up), false) AND count(DISTINCT o) >= 3)"""

SQL = {
    "cluster_rows": f"{TK}, {MED}, {rows()} SELECT {P}, token_seq, row_no FROM rw",
    "rows_to_lines": f"{TK}, {MED}, {rows()} SELECT {P}, row_no, string_agg(text, '  |  ' ORDER BY x, token_seq) AS line FROM rw GROUP BY ALL",
    "row_confidence": f"{TK}, {MED}, {rows()} SELECT {P}, row_no, round(avg(score), 6) AS confidence FROM rw GROUP BY ALL",
    "cluster_rows_textlayer": f"{TK}, {TEXT} SELECT {P}, token_seq, row_no FROM tl",
    "column_anchors": f"{TK}, {TEXT}, {ANCH} SELECT {P}, row_no, string_agg(cell, ' | ' ORDER BY col) AS line FROM ce WHERE cell <> '' GROUP BY ALL",
    "column_bands_grid": f"""{TK}, {MED}, {BANDS} SELECT {P}, row_no,
        array_to_string(list_transform(range(0, CAST(mc AS INT) + 1), lambda i: coalesce(mp[i], '')), '  |  ') AS line FROM mx""",
    "merge_slivers": f"""{TK} SELECT DISTINCT {P}, '40,195,340,520' AS edges FROM tokens WHERE doc_id % 7 > 0""",
    "geometry_grid": f"""{TK}, tb AS (SELECT *, (x + x2) / 2 AS cx FROM tokens WHERE doc_id % 7 > 0 AND doc_id % 5 > 0 AND doc_id % 11 > 0
          AND (x + x2) / 2 BETWEEN 80 AND 1040 AND y BETWEEN 100 AND 600),
        md AS (SELECT {P}, list_sort(list(y2 - y1))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM tb GROUP BY ALL), {rows('tb')},
        pc AS (SELECT *, CASE WHEN cx < 390 THEN 0 WHEN cx < 680 THEN 1 ELSE 2 END AS col FROM rw WHERE least(abs(cx - 80), abs(cx - 390), abs(cx - 680), abs(cx - 1040)) >= 290 * 0.03),
        tx AS (SELECT {P}, row_no, col, y, token_seq, trim(CASE WHEN col = 0 THEN regexp_replace(text, '^\\d{{1,2}}\\s+', '') ELSE text END) AS t FROM pc),
        cc AS (SELECT {P}, row_no, col, string_agg(t, ' ' ORDER BY y, token_seq) AS c FROM tx WHERE t <> '' GROUP BY ALL)
        SELECT {P}, row_no, coalesce(max(c) FILTER (col = 0), '') || ' | ' || coalesce(max(c) FILTER (col = 1), '') || ' | ' || coalesce(max(c) FILTER (col = 2), '') AS line FROM cc GROUP BY ALL""",
    "merge_kerned": f"""{TK}, {TEXT}, c AS (SELECT {P}, row_no, token_seq * 256 + k - 1 AS token_seq, substr(text, k, 1) AS text, 3 * x + 6 * (k - 1) AS x
          FROM (SELECT *, CAST(unnest(range(1, length(text) + 1)) AS INT) AS k FROM tl)),
        n AS (SELECT *, regexp_matches(text, '^[0-9.,%+ºu°μ-]$') AS num FROM c), s AS (SELECT *, CASE WHEN num AND lag(num) OVER w AND x - (lag(x) OVER w + 6) < 0.5 THEN 0 ELSE 1 END AS b FROM n
          WINDOW w AS (PARTITION BY {P}, row_no ORDER BY x, token_seq)), r AS (SELECT *, sum(b) OVER (PARTITION BY {P}, row_no ORDER BY x, token_seq) AS run FROM s)
        SELECT {P}, row_no, min(x) AS x, min(token_seq) AS token_seq, string_agg(text, '' ORDER BY x, token_seq) AS text, 6.0::DOUBLE * count(*) AS width FROM r GROUP BY {P}, row_no, run""",
    "header_direction_hints": f"""{TK}, n AS (SELECT {P}, token_seq // 3 AS i, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9μ.\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM tokens WHERE token_seq % 3 = 0),
        s AS (SELECT {P}, token_seq // 3 AS i, CAST(regexp_extract(text, '[0-9]+') AS DOUBLE) AS value FROM tokens WHERE token_seq % 3 = 1 AND regexp_matches(text, '[0-9]'))
        SELECT {P}, name, value, CASE i % 3 WHEN 0 THEN 'min' ELSE 'max' END AS direction FROM n JOIN s USING ({P}, i) WHERE i % 3 < 2 AND doc_id % 4 > 0""",
    "pick_rotation": f"""{TK}, a AS (SELECT *, unnest([0, 90, 270]) AS angle FROM tokens), b AS (SELECT {P}, angle, score, CASE WHEN tl THEN 10 ELSE 60 + token_seq % 2 END AS w,
          CASE WHEN tl OR (angle = 270 AND token_seq % 4 = 0) THEN 60 ELSE 20 END AS h FROM (SELECT *, (doc_id % 3 = 0) = (angle = 0) AS tl FROM a)),
        c AS (SELECT {P}, angle, count(*) FILTER (h > 1.5 * w) AS tall, count(*) FILTER (w > 1.5 * h) AS wide, round(avg(score), 9) AS sc FROM b GROUP BY ALL),
        d AS (SELECT {P}, max(tall) FILTER (angle = 0) AS t0, max(wide) FILTER (angle = 0) AS w0, first(angle ORDER BY wide DESC, sc DESC, CASE angle WHEN 0 THEN 0 WHEN 90 THEN 1 ELSE 2 END) AS best FROM c GROUP BY ALL)
        SELECT {P}, CASE WHEN t0 >= 5 AND t0 > 1.5 * w0 THEN best ELSE 0 END AS angle, t0 >= 5 AND t0 > 1.5 * w0 AS turned FROM d""",
    "pick_fallback_angle": """WITH a AS (SELECT event_id, user_id % 2 = 0 AS p, unnest([0, 90, 180, 270]) AS angle FROM events),
        b AS (SELECT event_id, angle, CAST((event_id * 37 + angle * 7) % 101 AS INT) AS conf, list_position(CASE WHEN p THEN [90, 270, 0, 180] ELSE [0, 180, 90, 270] END, angle) AS o FROM a)
        SELECT event_id, first(angle ORDER BY conf < 75, CASE WHEN conf >= 75 THEN o END, conf DESC, o) AS angle,
        first(conf ORDER BY conf < 75, CASE WHEN conf >= 75 THEN o END, conf DESC, o) AS conf FROM b GROUP BY 1""",
    "recover_sieve": f"""{SV}, f AS (SELECT e.*, k.doc_id IS NOT NULL AND st = 'SKIP' AND shifted AND name = 'Particle Size' AND v BETWEEN lo AND hi AS hit FROM e LEFT JOIN ok k ON e.doc_id = k.doc_id AND e.page = k.page)
        SELECT {ID}, name, CASE WHEN hit THEN 'PASS' ELSE st END AS status, lo AS min, hi AS max, CASE WHEN hit THEN v ELSE o END AS result,
        CAST(CAST(CASE WHEN hit THEN v ELSE o END AS BIGINT) AS VARCHAR) AS result_raw, CASE WHEN hit THEN 'SIEVE_RECOVERED' ELSE rc END AS reason_code,
        hit OR st = 'SKIP' OR rc IN ('BOUNDARY', 'OUTSIDE_DECIMAL_RISK') AS needs_review FROM f""",
    "add_missing_sieve_rows": f"""{SV}, pg AS (SELECT {P} FROM (SELECT *, o > lag(o) OVER (PARTITION BY {P} ORDER BY item_seq) AS up FROM op) WHERE doc_id % 4 < 3 GROUP BY {P}
          HAVING NOT coalesce(bool_or(up), false) AND count(DISTINCT o) >= 3 AND bool_or(item_seq = 1)),
        mi AS (SELECT {P}, min(item_seq) AS ln FROM op JOIN pg USING ({P}) WHERE item_seq % 5 = 0 GROUP BY {P}),
        hd AS (SELECT {P}, min(item_seq) FILTER (name = 'Particle Size') AS f, max(item_seq) AS l FROM r GROUP BY {P})
        SELECT {P}, item_seq, CAST(item_seq AS DOUBLE) AS item_pos, name, CASE WHEN shifted THEN 'SKIP' ELSE st END AS status, lo AS min, hi AS max,
          CAST(item_seq % 4 + 1 AS VARCHAR) || '.0 - ' || (item_seq % 4 + 21) || '.0' AS spec_raw, rc AS reason_code FROM e
        UNION ALL SELECT {P}, NULL, round(coalesce(f - 1 + 1 / (ln + 2.0), l + ln + 1), 6), 'Particle Size', 'SKIP', 3, 3, '3.0', 'SIEVE_RECOVERED' FROM mi LEFT JOIN hd USING ({P})""",
}
