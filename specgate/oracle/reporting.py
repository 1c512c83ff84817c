"""DuckDB answers for plans/reporting.py."""

from __future__ import annotations

from specgate.oracle import base as B

ID = "doc_id, page, item_seq"
EV = f"WITH {B.ITEMS}, {B.evaluated()}"
VV = f"WITH {B.ITEMS}, {B.VARIANTS}, {B.evaluated('variants', 'ev')}"
NEAR = """(min IS NULL OR max IS NULL OR value IS NULL OR max - min <= abs(value) * 1e-3
  OR value <= min + (max - min) * 0.05 OR value >= max - (max - min) * 0.05)"""
KEY = "lower(replace(name, ' ', ''))"
WORTH = """status = 'SKIP' AND (coalesce(nullif(trim(spec_raw), ''), CAST(coalesce(min, max) AS VARCHAR)) IS NULL
  OR coalesce(nullif(trim(result_raw), ''), CAST(value AS VARCHAR)) IS NULL
  OR regexp_matches(coalesce(nullif(trim(spec_raw), ''), CAST(coalesce(min, max) AS VARCHAR)), '\\d')
  OR regexp_matches(coalesce(nullif(trim(result_raw), ''), CAST(value AS VARCHAR)), '\\d'))"""
SUMMARY = """s AS (SELECT doc_id, page, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
  count(*) FILTER (status = 'SKIP') AS n_skip, count(*) AS n_total, count(*) FILTER (needs_review) AS n_review FROM ev GROUP BY 1, 2)"""
def beats(p: str, source: str, old: str, new: str, column: str = "variant") -> str:
    """CTEs ending in {p}d: what decides between two readings of a page."""
    return f"""{p}n AS (SELECT doc_id, page, {KEY} AS k, count(*) FILTER (status = 'PASS' AND {column} = '{old}') AS o,
   count(*) FILTER (status = 'PASS' AND {column} = '{new}') AS g FROM {source} GROUP BY 1, 2, 3),
 {p}d0 AS (SELECT doc_id, page, bool_and(g >= o) AS keeps FROM {p}n GROUP BY 1, 2),
 {p}d1 AS (SELECT doc_id, page, count(*) FILTER (status = 'PASS' AND {column} = '{old}') AS old_pass,
   count(*) FILTER (status = 'PASS' AND {column} = '{new}') AS new_pass, count(*) FILTER (status = 'FAIL' AND {column} = '{new}') AS new_fail,
   count(*) FILTER (status = 'SKIP' AND {column} = '{old}') AS old_skip,
   bool_or({column} = '{old}' AND status = 'SKIP' AND reason_code IN ('EQ_COPY','EQ_NO_DIRECTION')) AS collapsed FROM {source} GROUP BY 1, 2),
 {p}d AS MATERIALIZED (SELECT {p}d1.*, new_fail = 0 AND keeps AND new_pass > old_pass AS beats FROM {p}d1 JOIN {p}d0 USING (doc_id, page))"""


WINNER = "w AS MATERIALIZED (SELECT doc_id, page, CASE WHEN beats AND (collapsed OR (doc_id % 2 = 0 AND old_skip > 0)) THEN 'grid' ELSE 'flat' END AS variant FROM d)"
BEATS = f"{beats('', 'ev', 'flat', 'grid')}, {WINNER}"
SECOND = """seconds AS MATERIALIZED (SELECT doc_id, page, variant, item_seq, name, unit, method,
  CASE WHEN variant = 'hq_flat' AND item_seq % 6 = 0 THEN result ELSE spec_raw END AS spec_raw, spec_min, spec_max,
  CASE WHEN variant = 'hq_grid' AND item_seq % 10 = 0 THEN NULL ELSE result END AS result
  FROM items CROSS JOIN (SELECT unnest(['hq_flat', 'hq_grid']) AS variant))"""
SCANNED = "doc_id % 3 <> 0 AND (doc_id + page) % 7 > 0"

SQL = {
    "summarize": f"{EV}, {SUMMARY} SELECT * FROM s",
    "has_collapse": f"""{VV} SELECT doc_id, page, variant, bool_or(status = 'SKIP' AND reason_code IN ('EQ_COPY','EQ_NO_DIRECTION')) AS collapsed
        FROM ev GROUP BY 1, 2, 3""",
    "pass_multiset": f"{EV} SELECT doc_id, {KEY} AS name_key, count(*) AS n_pass FROM ev WHERE status = 'PASS' GROUP BY 1, 2",
    "challenger_beats": f"{VV}, {BEATS} SELECT doc_id, page, old_pass, new_pass, new_fail, beats FROM d",
    "keep_best": f"{VV}, {BEATS} SELECT {ID}, variant, status, spec_raw, needs_review FROM ev JOIN w USING (doc_id, page, variant)",
    "provenance_flags": f"""{VV}, {BEATS}, p AS (SELECT DISTINCT doc_id, page, lower(trim(name)) AS n, min, max, spec_raw, value FROM ev WHERE status = 'PASS' AND variant = 'flat')
        SELECT {ID}, variant, status, needs_review OR (variant = 'grid' AND status = 'PASS' AND (doc_id % 2 = 1 OR {NEAR}) AND NOT EXISTS (
          SELECT 1 FROM p WHERE p.doc_id = e.doc_id AND p.page = e.page AND p.n = lower(trim(e.name)) AND p.min IS NOT DISTINCT FROM e.min
          AND p.max IS NOT DISTINCT FROM e.max AND p.spec_raw IS NOT DISTINCT FROM e.spec_raw AND p.value IS NOT DISTINCT FROM e.value)) AS needs_review
        FROM ev e JOIN w USING (doc_id, page, variant)""",
    "carry_header": f"""WITH {B.ITEMS} SELECT doc_id, page,
        CASE WHEN doc_id % 3 = 0 THEN 'grid ' || page ELSE arg_min(name, item_seq) END AS product,
        CASE WHEN doc_id % 2 = 0 THEN 'lot' ELSE CAST(doc_id AS VARCHAR) END AS lot_no FROM items GROUP BY doc_id, page""",
    "reprocess_queue": f"{EV} SELECT doc_id, page, count(*) AS n_worth FROM ev WHERE {WORTH} AND {SCANNED} GROUP BY 1, 2",
    "keep_best_hq": f"""{VV}, {BEATS}, {SECOND}, {B.evaluated('seconds', 'ev2')}, {beats('h', 'ev2', 'hq_flat', 'hq_grid')},
        hw AS (SELECT doc_id, page, CASE WHEN beats AND collapsed THEN 'hq_grid' ELSE 'hq_flat' END AS variant FROM hd),
        two AS MATERIALIZED (SELECT {ID}, name, variant, status, reason_code, min, max, value, spec_raw, result_raw, 'best' AS r FROM ev JOIN w USING (doc_id, page, variant)
          UNION ALL SELECT {ID}, name, variant, status, reason_code, min, max, value, spec_raw, result_raw, 'second' FROM ev2 JOIN hw USING (doc_id, page, variant)),
        {beats('t', 'two', 'best', 'second', 'r')},
        q AS (SELECT DISTINCT doc_id, page, true AS worth FROM two WHERE r = 'best' AND {WORTH} AND {SCANNED} AND (2 * doc_id + page) % 5 > 0)
        SELECT {ID}, variant, status FROM two JOIN td USING (doc_id, page) LEFT JOIN q USING (doc_id, page)
        WHERE r = CASE WHEN beats AND worth THEN 'second' ELSE 'best' END""",
    "report_verdict": f"""{EV}, {SUMMARY} SELECT *, CASE WHEN n_fail > 0 OR n_total = 0 THEN 'fail' WHEN n_review = 0 THEN 'clean' ELSE 'warn' END AS verdict,
        CASE WHEN doc_id % 2 + 1 > 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'Lot ' || doc_id ELSE 'Page ' || page END END AS label FROM s""",
    "status_share": f"""{EV}, {SUMMARY} SELECT doc_id, page, round(n_pass / n_total * 100, 6) AS pass_pct,
        round(CASE WHEN n_fail = 0 THEN 4 ELSE n_fail / n_total * 100 END, 6) AS fail_pct,
        round(CASE WHEN n_skip = 0 THEN 4 ELSE n_skip / n_total * 100 END, 6) AS skip_pct FROM s""",
    "batch_metrics": f"""{EV} SELECT doc_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
        count(*) FILTER (status = 'SKIP') AS n_skip, count(*) AS n_rows, count(*) FILTER (needs_review) AS n_review,
        CAST(floor(count(*) FILTER (status <> 'SKIP') / count(*) * 100 + 0.5) AS BIGINT) AS verdict_rate FROM ev GROUP BY ROLLUP (doc_id)""",
    "fail_listing": f"{EV} SELECT {ID}, name, value AS result, spec_raw FROM ev WHERE status = 'FAIL'",
    "compare_models": f"""{VV} SELECT doc_id, count(*) FILTER (variant = 'flat' AND status = 'PASS') AS flat_pass,
        count(*) FILTER (variant = 'flat' AND status = 'FAIL') AS flat_fail, count(*) FILTER (variant = 'flat' AND status = 'SKIP') AS flat_skip,
        count(*) FILTER (variant = 'grid' AND status = 'PASS') AS grid_pass, count(*) FILTER (variant = 'grid' AND status = 'FAIL') AS grid_fail,
        count(*) FILTER (variant = 'grid' AND status = 'SKIP') AS grid_skip FROM ev GROUP BY ROLLUP (doc_id)""",
    "regression_diff": f"""{VV}, n AS (SELECT doc_id, page, {KEY} AS k, count(*) FILTER (status = 'PASS' AND variant = 'grid') AS np,
        count(*) FILTER (status = 'PASS' AND variant = 'flat') AS op, count(*) FILTER (status = 'FAIL' AND variant = 'grid') AS nf,
        count(*) FILTER (status = 'FAIL' AND variant = 'flat') AS f, count(*) FILTER (status = 'SKIP' AND variant = 'grid') AS ns,
        count(*) FILTER (status = 'SKIP' AND variant = 'flat') AS os FROM ev GROUP BY 1, 2, 3)
        SELECT doc_id, CAST(sum(np - op) AS BIGINT) AS d_pass, CAST(sum(nf - f) AS BIGINT) AS d_fail, CAST(sum(ns - os) AS BIGINT) AS d_skip,
        CAST(sum(greatest(op - np, 0)) AS BIGINT) AS lost_pass, CAST(sum(greatest(nf - f, 0)) AS BIGINT) AS new_fail FROM n GROUP BY 1""",
    "ground_truth_grade": f"""{EV} SELECT CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS expected, status, count(*) AS n_rows
        FROM ev JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "review_flags": f"""{EV}, t AS (SELECT doc_id, page, trim(name) AS n, bool_or(item_seq % 3 = 0) AS rec, bool_or(item_seq % 3 = 1) AS av,
        bool_or(item_seq % 3 = 2) AS col FROM items WHERE item_seq % 2 = 0 GROUP BY 1, 2, 3)
        SELECT e.doc_id, e.page, item_seq, status, needs_review OR coalesce((rec AND status <> 'SKIP' AND {NEAR}) OR (av AND status = 'PASS' AND {NEAR}) OR (col AND status = 'PASS'), false) AS needs_review
        FROM ev e LEFT JOIN t ON e.doc_id = t.doc_id AND e.page = t.page AND trim(e.name) = t.n""",
    "promote_boundary": f"""{EV}, h AS (SELECT *, coalesce(doc_id % 3 < 2 AND status = 'SKIP' AND min <> max AND (value = min OR value = max), false) AS hit FROM ev)
        SELECT {ID}, CASE WHEN hit THEN 'PASS' ELSE status END AS status, needs_review OR hit AS needs_review,
        CASE WHEN hit THEN 'BOUNDARY_VERIFIED' ELSE reason_code END AS reason_code FROM h""",
    "margin_green": f"""{EV}, m AS (SELECT *, needs_review OR item_seq % 2 = 0 AS nr, coalesce(min, -1e300) AS a, coalesce(max, 1e300) AS b,
          least(coalesce(value - min, 1e300), coalesce(max - value, 1e300)) AS clr FROM ev),
        m2 AS (SELECT *, CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN CASE WHEN value - min <= max - value THEN min ELSE max END ELSE coalesce(max, min) END AS bind FROM m)
        SELECT {ID}, status, nr AND NOT coalesce((doc_id % 4 < 2 OR (doc_id % 4 = 3 AND doc_id % 3 = 0)) AND status = 'PASS' AND value <> 0 AND bind IS NOT NULL AND clr / abs(value) >= 0.3
          AND (value <> floor(value) OR (value/10 BETWEEN a AND b AND value*10 BETWEEN a AND b AND value/100 BETWEEN a AND b AND value*100 BETWEEN a AND b))
          AND (bind = floor(bind) OR contains(result_raw, '.')), false) AS needs_review FROM m2""",
}
