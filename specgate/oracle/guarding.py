"""DuckDB answers for plans/guarding.py: every row against every line of its page."""

from __future__ import annotations

from specgate.oracle import base as B

NUM = B.NUM
ID = "doc_id, page, item_seq"
EV = f"WITH {B.ITEMS}, {B.LINES}, {B.evaluated()}"


def toks(e: str) -> str:
    return f"coalesce(regexp_extract_all({e}, '{NUM}'), [])"


def val(t: str) -> str:
    return f"CAST(replace({t}, ',', '.') AS DOUBLE)"


def vals(e: str) -> str:
    return f"list_transform({toks(e)}, lambda z: {val('z')})"


def digs(e: str) -> str:
    return f"list_transform({toks(e)}, lambda z: regexp_replace(z, '\\D', '', 'g'))"


def num_text(c: str) -> str:
    return f"(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END)"


def sig(e: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda t: length(t) >= 2 OR regexp_matches(t, '[0-9]'))")


def matches(t: str) -> str:
    """t: a token string, against the line lists lv (values) and ld (digits)."""
    return f"(list_contains(lv, {val(t)}) OR (length(regexp_replace({t}, '\\D', '', 'g')) >= 2 AND list_contains(ld, regexp_replace({t}, '\\D', '', 'g'))))"


def count_matching(tokens: str) -> str:
    return f"len(list_filter({tokens}, lambda y: {matches('y')}))"


LN = f"ln AS (SELECT *, {vals('line')} AS lv, {digs('line')} AS ld FROM lines)"


def final(hits: str, code: str) -> str:
    return f"""SELECT {ID}, CASE WHEN h THEN 'SKIP' ELSE status END AS status, needs_review OR h AS needs_review,
      CASE WHEN h THEN '{code}' ELSE reason_code END AS reason_code FROM (SELECT *, ({hits}) AS h FROM ev)"""


PASS = f"""p AS (SELECT *, {sig('name')} AS s, {digs('name')} AS nd,
    list_concat({vals('result_raw')}, CASE WHEN value IS NULL THEN [] ELSE [value] END) AS rv,
    CASE WHEN coalesce(min <> max, false) THEN NULL ELSE coalesce(max, min) END AS bd FROM ev WHERE status = 'PASS'),
  pl AS (SELECT p.doc_id, p.page, p.item_seq, p.s, p.nd, p.rv, p.bd, l.line_no, l.line, l.lv, l.ld,
      len(list_filter(s, lambda w: list_contains({sig('line')}, w))) AS tok,
      CASE WHEN length(array_to_string(s, '')) >= 6 AND list_contains(list_transform(
          CASE WHEN contains(line, '|') THEN string_split(line, '|') ELSE regexp_split_to_array(line, '\\s{{2,}}') END,
          lambda c: regexp_replace(lower(c), '[^a-z0-9]+', '', 'g')), array_to_string(s, '')) THEN len(s) ELSE 0 END AS glue,
      len(list_intersect(nd, ld)) > 0 AS has_n FROM p JOIN ln l ON p.doc_id = l.doc_id AND p.page = l.page WHERE len(s) >= 2 AND len(rv) > 0),
  sc AS (SELECT *, CASE WHEN bool_or(has_n) OVER w AND NOT has_n THEN 0 ELSE greatest(tok, glue) END AS score FROM pl WINDOW w AS (PARTITION BY {ID})),
  be AS (SELECT *, max(score) OVER (PARTITION BY {ID}) AS best,
      len(list_filter(lv, lambda z: len(list_filter(rv, lambda q: abs(q - z) < 1e-9)) > 0)) > 0 AND (bd IS NULL OR len(list_filter(lv, lambda z: abs(z - bd) < 1e-9)) > 0) AS ok FROM sc),
  an AS (SELECT *, len(list_filter(ld, lambda z: NOT list_contains(nd, z))) > 0 AS data FROM be WHERE score = best AND best >= greatest(2, ceil(len(s) * 0.6))),
  db AS (SELECT {ID} FROM an GROUP BY {ID} HAVING NOT bool_or(ok) AND bool_or(data)),
  st AS (SELECT a.doc_id, a.page, a.item_seq, a.line_no, min(b.line_no) FILTER (b.ok) AS ok_at,
      min(b.line_no) FILTER (regexp_matches(b.line, '^\\d+\\s*[|]')) AS stop_at FROM an a JOIN be b
      ON a.doc_id = b.doc_id AND a.page = b.page AND a.item_seq = b.item_seq AND b.line_no BETWEEN a.line_no + 1 AND a.line_no + 7 GROUP BY ALL),
  hit AS (SELECT * FROM db EXCEPT SELECT {ID} FROM st WHERE ok_at IS NOT NULL AND (stop_at IS NULL OR ok_at < stop_at))"""

SPLIT = "string_split(line, '  |  ')"
SHIFT = f"""mv AS (SELECT doc_id, page, line_no, CASE WHEN len({SPLIT}) = 3 AND line_no % 2 = 0
      THEN {SPLIT}[3] || '  |  ' || {SPLIT}[2] || '  |  ' || (line_no % 7) ELSE line END AS line FROM lines),
  ce AS (SELECT *, list_filter(list_transform(CASE WHEN contains(line, '|') THEN string_split(line, '|') ELSE regexp_split_to_array(line, '\\s{{2,}}') END,
      lambda c: trim(c)), lambda c: c <> '') AS cs FROM mv),
  one AS (SELECT *, list_transform(cs, lambda c: TRY_CAST(CASE WHEN regexp_matches(replace(c, ' ', ''), '^[-+]?\\d+([.,]\\d+)?$') THEN replace(replace(c, ' ', ''), ',', '.') END AS DOUBLE)) AS sn,
      list_transform(cs, lambda c: list_transform(regexp_extract_all(regexp_replace(regexp_replace(c, '[~±]', ' ', 'g'), '(\\d)\\s*-\\s*(\\d)', '\\1 \\2', 'g'), '{NUM}'), lambda z: {val('z')})) AS cn
      FROM ce WHERE len(cs) >= 3),
  rw AS (SELECT *, trim(coalesce(result_raw, CAST(value AS VARCHAR))) AS raw,
      list_filter(list_concat(coalesce(list_transform(regexp_extract_all(regexp_replace(regexp_replace(spec_raw, '[~±]', ' ', 'g'), '(\\d)\\s*-\\s*(\\d)', '\\1 \\2', 'g'), '{NUM}'), lambda z: {val('z')}), []), [min, max]), lambda z: z IS NOT NULL) AS sp
      FROM ev WHERE status IN ('PASS', 'FAIL')),
  rn AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(replace(raw, ' ', ''), '^[-+]?\\d+([.,]\\d+)?$') THEN replace(replace(raw, ' ', ''), ',', '.') END AS DOUBLE) AS rv FROM rw WHERE raw <> '' AND len(sp) > 0),
  jn AS (SELECT r.doc_id, r.page, r.item_seq, r.rv, o.sn,
      list_filter(range(2, len(cs) + 1), lambda i: len(list_filter(sp, lambda s: len(list_filter(cn[i], lambda x: abs(x - s) < 1e-9)) = 0)) = 0) AS pos
      FROM rn r JOIN one o ON r.doc_id = o.doc_id AND r.page = o.page AND (abs(sn[1] - rv) < 1e-9 OR lower(replace(cs[1], ' ', '')) = lower(replace(raw, ' ', '')))),
  sh AS (SELECT DISTINCT {ID} FROM jn WHERE len(pos) > 0 AND len(list_filter(list_slice(sn, pos[1] + 1, len(sn)), lambda x: x IS NOT NULL AND (rv IS NULL OR abs(x - rv) >= 1e-9))) > 0)"""

GROUND = f"""it AS (SELECT * EXCLUDE (name), CASE WHEN item_seq % 16 = 2 THEN 'Zqbreaker vx' WHEN item_seq % 2 = 0 THEN 'Zq' || item_seq || ' vx' ELSE name END AS name FROM items),
  pt AS (SELECT doc_id, page, replace(lower(string_agg(line, '' ORDER BY line_no)), ' ', '') AS body FROM lines GROUP BY ALL),
  nt AS (SELECT *, list_filter(string_split(regexp_replace(lower(name), '[^a-z]+', ' ', 'g'), ' '), lambda t: length(t) >= 3) AS nw,
      list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2) AS ns,
      {toks('result')} AS rt, {toks("concat_ws(' ', spec_raw, spec_min, spec_max)")} AS st FROM it),
  h1 AS (SELECT DISTINCT {ID} FROM nt JOIN ln USING (doc_id, page) WHERE len(list_filter(nw, lambda w: list_contains(regexp_extract_all(lower(line), '[a-z]{{3,}}'), w))) > 0
      UNION SELECT {ID} FROM nt JOIN pt USING (doc_id, page) WHERE len(list_filter(nw, lambda w: length(w) >= 5 AND contains(body, w))) > 0),
  h2 AS (SELECT DISTINCT {ID} FROM nt JOIN ln USING (doc_id, page) WHERE {count_matching('rt')} > 0 AND {count_matching('st')} > 0),
  bl AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS blk FROM lines WHERE len(string_split(line, '|')) >= 3),
  b2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, blk) AS n FROM bl),
  bt AS (SELECT doc_id, page, blk, string_agg(regexp_replace(lower(line), '[^a-z0-9]+', '', 'g'), '#') AS body FROM b2 WHERE n >= 2 GROUP BY ALL),
  bc AS (SELECT doc_id, page, blk, line_no, unnest(range(2, len(string_split(line, '|')) + 1)) AS col, line FROM b2 WHERE n >= 2),
  bv AS (SELECT doc_id, page, blk, line_no, col, {vals("string_split(line, '|')[col]")} AS cv FROM bc),
  ja AS (SELECT {ID}, blk, col, min(line_no) FILTER (len(list_filter(rt, lambda t: list_contains(cv, {val('t')}))) > 0) AS r,
      min(line_no) FILTER (len(list_filter(st, lambda t: list_contains(cv, {val('t')}))) > 0) AS s FROM nt JOIN bv USING (doc_id, page) GROUP BY {ID}, blk, col),
  h3 AS (SELECT DISTINCT {ID} FROM ja JOIN bt USING (doc_id, page, blk) JOIN nt USING ({ID}) WHERE r <> s AND len(list_filter(ns, lambda w: contains(body, w))) > 0)"""

SQL = {
    "guard_outliers": f"""{EV}, e2 AS (SELECT * EXCLUDE (value), CASE WHEN item_seq % 4 = 0 THEN value * 130 ELSE value END AS value FROM ev)
        {final("status = 'FAIL' AND min IS NOT NULL AND coalesce(max > 0 AND value > max * 100, false)", 'OUTLIER').replace('FROM ev', 'FROM e2')}""",
    "guard_fails": f"""{EV}, {LN}, f AS (SELECT *, list_concat({toks('result_raw')}, CASE WHEN value IS NULL THEN [] ELSE [{num_text('value')}] END) AS rt,
        list_concat({toks('spec_raw')}, CASE WHEN min IS NULL THEN [] ELSE [{num_text('min')}] END, CASE WHEN max IS NULL THEN [] ELSE [{num_text('max')}] END) AS st
        FROM ev WHERE status = 'FAIL'),
        g AS (SELECT f.doc_id, f.page, f.item_seq, bool_or({count_matching('rt')} > 0 AND {count_matching('st')} = len(st)) AS ok
        FROM f JOIN ln ON f.doc_id = ln.doc_id AND f.page = ln.page WHERE len(rt) > 0 AND len(st) > 0 GROUP BY 1, 2, 3)
        {final(f"({ID}) IN (SELECT ({ID}) FROM g WHERE NOT ok)", 'FAIL_GUARD')}""",
    "guard_passes": f"{EV}, {LN}, {PASS} {final(f'({ID}) IN (SELECT ({ID}) FROM hit)', 'PASS_GUARD')}",
    "guard_column_shift": f"{EV}, {SHIFT} {final(f'({ID}) IN (SELECT ({ID}) FROM sh)', 'COLUMN_SHIFT')}",
    "drop_ungrounded": f"""WITH {B.ITEMS}, {B.LINES.replace("lines AS (", "lines0 AS (")},
        lines AS (SELECT doc_id, page, line_no, CASE line_no % 16 WHEN 2 THEN line || ' zqbre' WHEN 3 THEN 'aker ' || line ELSE line END AS line FROM lines0), {LN}, {GROUND}, hh AS (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3)
        SELECT {ID}, ({ID}) IN (SELECT ({ID}) FROM hh) AS kept FROM items""",
}
