"""SQL building blocks of the DuckDB answers: the derived tables and the limit grammar."""

from __future__ import annotations

NUM = r"-?\d+(?:[.,]\d+)?"

ITEMS = """
b0 AS MATERIALIZED (SELECT l_orderkey // 4 AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page,
         row_number() OVER (PARTITION BY l_orderkey // 4, l_suppkey % 2
                            ORDER BY l_partkey % 4, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), l_extendedprice) AS item_seq,
         l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, p_name, lower(p_type) AS p_type, p_size,
         1 + p_size % 20 AS lo, 26 + p_size % 20 AS hi
       FROM lineitem JOIN part ON l_partkey = p_partkey),
items AS MATERIALIZED (SELECT doc_id, page, item_seq,
       CASE WHEN l_partkey % 29 = 0 THEN 'Lot number ' || item_seq
            ELSE p_name || ' ' || p_type || ' ' || l_partkey END AS name,
       CASE WHEN l_partkey % 5 = 0 THEN '%' WHEN l_partkey % 5 = 1 THEN 'mm' END AS unit,
       CASE WHEN l_partkey % 6 = 0 THEN 'ISO 3310' END AS method,
       CASE l_partkey % 12
         WHEN 0 THEN lo || '-' || hi WHEN 1 THEN lo || ' ~ ' || hi || ' Success'
         WHEN 2 THEN '25 ± ' || lo WHEN 3 THEN '≤ ' || hi || ' %' WHEN 4 THEN hi || ' Max.'
         WHEN 5 THEN lo || ' Min.' WHEN 6 THEN '≥ ' || lo WHEN 7 THEN '< ' || hi
         WHEN 8 THEN CAST(hi AS VARCHAR) WHEN 9 THEN 'White' WHEN 10 THEN NULL
         ELSE lo || '~4S' END AS spec_raw,
       CASE WHEN l_partkey % 12 = 10 AND l_suppkey % 5 > 0 THEN CAST(lo AS VARCHAR) END AS spec_min,
       CASE WHEN l_partkey % 12 = 10 AND l_suppkey % 3 > 0 THEN CAST(hi AS VARCHAR) END AS spec_max,
       CASE (q + l_suppkey) % 11
         WHEN 0 THEN '<' || q WHEN 1 THEN 'White' WHEN 2 THEN NULL WHEN 3 THEN q || ' ' || (q + 2)
         WHEN 4 THEN q || ',5' WHEN 5 THEN '≥ ' || q ELSE CAST(q AS VARCHAR) END AS result
       FROM b0)"""

LINES = """
lines AS MATERIALIZED (SELECT doc_id, page, item_seq AS line_no,
  CASE WHEN item_seq % 9 = 0 THEN 'By : QA Dept.'
       WHEN item_seq % 7 = 0 THEN coalesce(spec_raw, '-') || '  |  ' || coalesce(result, '-')
       ELSE name || '  |  ' || coalesce(spec_raw, coalesce(spec_min,'') || '~' || coalesce(spec_max,'')) || '  |  ' ||
            CASE WHEN item_seq % 5 = 0 THEN '77' ELSE coalesce(result, '13') END END AS line
  FROM items)"""

TOKENS = """
cell AS (SELECT doc_id, page, item_seq, 0 AS col, name AS text FROM items
      UNION ALL SELECT doc_id, page, item_seq, 1, coalesce(spec_raw, spec_min || '~' || spec_max) FROM items
      UNION ALL SELECT doc_id, page, item_seq, 2, result FROM items),
tokens AS MATERIALIZED (SELECT doc_id, page, item_seq * 3 + col AS token_seq, text,
  CAST((80 + item_seq % 20) / 100.0 AS DOUBLE) AS score,
  CAST(100 + 300 * col + item_seq % 5 AS DOUBLE) AS x, CAST(100 + 40 * item_seq + col * 2 AS DOUBLE) AS y,
  CAST(100 + 40 * item_seq + col * 2 - 10 - item_seq % 2 AS DOUBLE) AS y1,
  CAST(100 + 40 * item_seq + col * 2 + 10 AS DOUBLE) AS y2,
  CAST(100 + 300 * col + item_seq % 5 + 10 * length(text) AS DOUBLE) AS x2
  FROM cell WHERE text IS NOT NULL)"""

VARIANTS = """
variants AS MATERIALIZED (SELECT doc_id, page, variant, item_seq, name, unit, method,
  CASE WHEN variant = 'flat' AND item_seq % 3 = 0 THEN result ELSE spec_raw END AS spec_raw,
  spec_min, spec_max, result
  FROM items CROSS JOIN (SELECT unnest(['flat', 'grid']) AS variant))"""


def parsed_specs(source: str, columns: list[str], prefix: str = "sp") -> str:
    """CTEs ending in {prefix}(x, op, min, max, value, raw): one row per distinct notation."""
    union = " UNION ".join(f"SELECT {c} AS x FROM {source}" for c in columns)
    units = r"g/cm3?|kg/cm2?|g/10\s*min|g/l|m2/g|[μµ]m|um|mm|ppm|cm|kg|wt|sec|min|\(m/m\)"
    words = "success(ful)?|pass(ed)?|accept(ed|able)?|good|ok|qualified|conform(ed|ing)?"
    two = rf"^({NUM})\s*(±|\+/-|\+-|(?:[~\-–—]\s*)+)\s*({NUM})$"
    sides = r"^(.+?)\s*(?:[~\-–—]\s*)+(.+?)$"
    one = rf"^(≤|≦|<=|≥|≧|>=|<|>)?\s*({NUM})\s*((?i:max|min)\.?)?$"

    def n(e: str) -> str:
        return f"TRY_CAST(replace({e}, ',', '.') AS DOUBLE)"

    def fixed(g: int) -> str:
        return f"TRY_CAST(translate(trim(regexp_extract(u, '{sides}', {g})), 'OoQDIl|ZSGTBg', '0000111256789') AS DOUBLE)"

    return rf"""
{prefix}0 AS (SELECT x, regexp_replace(trim(translate(x, '～〜∼', '~~~')), '\s*\b({words})\b[\s.]*$', '', 'i') AS y
        FROM (SELECT DISTINCT x FROM ({union})) WHERE x IS NOT NULL),
{prefix}1 AS (SELECT x, trim(y) AS o,
        trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(y), '\s+', ' ', 'g'), '[%℃°]', '', 'g'),
             'min\.', '#@.', 'gi'), '{units}', '', 'gi'), '#@', 'min')) AS u
        FROM {prefix}0 WHERE trim(y) <> ''),
{prefix}2 AS (SELECT x, o, regexp_matches(u, '{two}') AS t, regexp_extract(u, '{two}', 2) AS sep,
        {n(f"regexp_extract(u, '{two}', 1)")} AS a, {n(f"regexp_extract(u, '{two}', 3)")} AS b,
        regexp_matches(regexp_extract(u, '{sides}', 1), '\d') AND regexp_matches(regexp_extract(u, '{sides}', 2), '\d') AS g,
        {fixed(1)} AS ga, {fixed(2)} AS gb,
        regexp_extract(u, '{one}', 1) AS sg, {n(f"regexp_extract(u, '{one}', 2)")} AS v,
        lower(regexp_extract(u, '{one}', 3)) AS w FROM {prefix}1),
{prefix} AS (SELECT x, o AS raw,
        CASE WHEN t OR (g AND ga IS NOT NULL AND gb IS NOT NULL) THEN 'between'
             WHEN v IS NULL OR (sg <> '' AND w <> '') THEN NULL
             WHEN sg IN ('≤','≦','<=') OR w LIKE 'max%' THEN 'le' WHEN sg IN ('≥','≧','>=') OR w LIKE 'min%' THEN 'ge'
             WHEN sg = '<' THEN 'lt' WHEN sg = '>' THEN 'gt' ELSE 'eq' END AS op,
        CASE WHEN t AND sep IN ('±','+/-','+-') THEN a - b WHEN t THEN least(a, b)
             WHEN g AND ga IS NOT NULL AND gb IS NOT NULL THEN least(ga, gb) END AS min,
        CASE WHEN t AND sep IN ('±','+/-','+-') THEN a + b WHEN t THEN greatest(a, b)
             WHEN g AND ga IS NOT NULL AND gb IS NOT NULL THEN greatest(ga, gb) END AS max,
        CASE WHEN NOT t AND NOT (g AND ga IS NOT NULL AND gb IS NOT NULL) THEN v END AS value
        FROM {prefix}2)"""


def resolved_items(source: str = "items", out: str = "ri", prefix: str = "sp") -> str:
    """CTEs ending in {out}: the source rows plus s_op, s_min, s_max, s_value, s_raw."""
    return parsed_specs(source, ["spec_raw", "spec_min", "spec_max"], prefix) + f""",
{out} AS (SELECT i.*,
   CASE WHEN r.op <> 'eq' THEN r.op WHEN lo.value IS NOT NULL AND hi.value IS NOT NULL THEN 'between'
        WHEN i.spec_min IS NOT NULL AND i.spec_max IS NULL AND lo.op IS NOT NULL THEN CASE lo.op WHEN 'eq' THEN 'ge' ELSE lo.op END
        WHEN i.spec_max IS NOT NULL AND i.spec_min IS NULL AND hi.op IS NOT NULL THEN CASE hi.op WHEN 'eq' THEN 'le' ELSE hi.op END
        ELSE r.op END AS s_op,
   CASE WHEN r.op <> 'eq' THEN r.min WHEN lo.value IS NOT NULL AND hi.value IS NOT NULL THEN least(lo.value, hi.value)
        WHEN i.spec_min IS NOT NULL AND i.spec_max IS NULL AND lo.op IS NOT NULL THEN lo.min
        WHEN i.spec_max IS NOT NULL AND i.spec_min IS NULL AND hi.op IS NOT NULL THEN hi.min END AS s_min,
   CASE WHEN r.op <> 'eq' THEN r.max WHEN lo.value IS NOT NULL AND hi.value IS NOT NULL THEN greatest(lo.value, hi.value)
        WHEN i.spec_min IS NOT NULL AND i.spec_max IS NULL AND lo.op IS NOT NULL THEN lo.max
        WHEN i.spec_max IS NOT NULL AND i.spec_min IS NULL AND hi.op IS NOT NULL THEN hi.max END AS s_max,
   CASE WHEN r.op <> 'eq' THEN r.value WHEN lo.value IS NOT NULL AND hi.value IS NOT NULL THEN NULL
        WHEN i.spec_min IS NOT NULL AND i.spec_max IS NULL AND lo.op IS NOT NULL THEN lo.value
        WHEN i.spec_max IS NOT NULL AND i.spec_min IS NULL AND hi.op IS NOT NULL THEN hi.value ELSE r.value END AS s_value,
   CASE WHEN r.op <> 'eq' THEN r.raw WHEN lo.value IS NOT NULL AND hi.value IS NOT NULL THEN i.spec_min || '~' || i.spec_max
        WHEN i.spec_min IS NOT NULL AND i.spec_max IS NULL AND lo.op IS NOT NULL THEN CASE lo.op WHEN 'eq' THEN i.spec_min ELSE lo.raw END
        WHEN i.spec_max IS NOT NULL AND i.spec_min IS NULL AND hi.op IS NOT NULL THEN CASE hi.op WHEN 'eq' THEN i.spec_max ELSE hi.raw END
        ELSE CASE WHEN r.op IS NOT NULL THEN r.raw END END AS s_raw
   FROM {source} i LEFT JOIN {prefix} r ON i.spec_raw = r.x LEFT JOIN {prefix} lo ON i.spec_min = lo.x
        LEFT JOIN {prefix} hi ON i.spec_max = hi.x)"""


def with_results(source: str, out: str) -> str:
    """CTEs ending in {out}: the source rows plus r_value, r_raw, r_bound, r_nums."""
    sign = rf"^(<=|≤|≦|<|>=|≥|≧|>)\s*({NUM})$"
    return rf"""
{out}0 AS (SELECT *, trim(result) AS rt,
   list_transform(regexp_extract_all(trim(result), '{NUM}'), lambda z: CAST(replace(z, ',', '.') AS DOUBLE)) AS r_nums,
   regexp_extract(trim(result), '{sign}', 1) AS r_sign,
   TRY_CAST(replace(regexp_extract(trim(result), '{sign}', 2), ',', '.') AS DOUBLE) AS r_lim FROM {source}),
{out} AS MATERIALIZED (SELECT * EXCLUDE (rt, r_sign, r_lim, r_nums),
   CASE WHEN r_lim IS NOT NULL THEN CASE WHEN r_sign = '<' THEN 'lt' WHEN r_sign IN ('<=','≤','≦') THEN 'le'
        WHEN r_sign = '>' THEN 'gt' ELSE 'ge' END END AS r_bound,
   CASE WHEN r_lim IS NOT NULL THEN r_lim
        WHEN regexp_matches(rt, '^[-+.0-9]') AND len(r_nums) > 0
        THEN list_reduce(list_prepend(0.0::DOUBLE, r_nums), lambda p, z: p + z) / len(r_nums) END AS r_value,
   CASE WHEN r_lim IS NOT NULL THEN [r_lim] WHEN regexp_matches(rt, '^[-+.0-9]') THEN r_nums END AS r_nums,
   rt AS r_text FROM {out}0)"""


def evaluated(source: str = "items", out: str = "ev") -> str:
    """CTEs ending in {out}: judged rows."""
    inside = "((s_op='between' AND {v} BETWEEN s_min AND s_max) OR (s_op='le' AND {v}<=s_value) OR (s_op='lt' AND {v}<s_value) OR (s_op='ge' AND {v}>=s_value) OR (s_op='gt' AND {v}>s_value) OR (s_op='eq' AND {v}=s_value))"
    d = {f"i{k}": inside.format(v=v) for k, v in (("", "r_value"), ("10", "(r_value/10)"), ("100", "(r_value/100)"))}
    return resolved_items(source, f"{out}r", f"{out}s") + "," + with_results(f"{out}r", f"{out}q") + f""",
{out}1 AS (SELECT *,
   CASE WHEN s_op IS NULL THEN 'NO_SPEC' WHEN r_value IS NULL THEN 'NO_RESULT'
     WHEN r_bound IS NOT NULL THEN CASE WHEN
        (r_bound IN ('lt','le') AND s_op='le' AND r_value<=s_value) OR (r_bound='lt' AND s_op='lt' AND r_value<=s_value)
        OR (r_bound='le' AND s_op='lt' AND r_value<s_value) OR (r_bound IN ('gt','ge') AND s_op='ge' AND r_value>=s_value)
        OR (r_bound='gt' AND s_op='gt' AND r_value>=s_value) OR (r_bound='ge' AND s_op='gt' AND r_value>s_value)
        THEN 'BOUND_OK' ELSE 'BOUND_UNKNOWN' END
     WHEN s_op='between' AND (r_value=s_min OR r_value=s_max) THEN 'BOUNDARY'
     WHEN s_op='eq' THEN CASE WHEN r_value=s_value THEN 'EQ_COPY' ELSE 'EQ_NO_DIRECTION' END
     WHEN {d['i']} THEN CASE WHEN r_value=floor(r_value) AND r_value<>0 AND s_op IN ('ge','gt') AND NOT ({d['i10']} AND {d['i100']}) THEN 'DECIMAL_RISK' ELSE '' END
     WHEN r_value=floor(r_value) AND r_value<>0 AND ({d['i10']} OR {d['i100']}) THEN 'OUTSIDE_DECIMAL_RISK'
     ELSE 'OUTSIDE' END AS reason_code FROM {out}q),
{out} AS MATERIALIZED (SELECT * EXCLUDE (name, unit, method, spec_raw, spec_min, spec_max),
   CASE WHEN trim(coalesce(name,'')) = '' THEN '(unknown)' ELSE trim(name) END AS name,
   nullif(trim(unit),'') AS unit, nullif(trim(method),'') AS method,
   coalesce(s_raw, spec_raw) AS spec_raw, CASE WHEN r_value IS NOT NULL THEN r_text ELSE result END AS result_raw,
   CASE WHEN s_op='between' THEN s_min WHEN reason_code IN ('NO_SPEC','NO_RESULT') THEN NULL
        WHEN s_op IN ('ge','gt') THEN s_value WHEN s_op='eq' AND r_bound IS NULL THEN s_value END AS min,
   CASE WHEN s_op='between' THEN s_max WHEN reason_code IN ('NO_SPEC','NO_RESULT') THEN NULL
        WHEN s_op IN ('le','lt') THEN s_value WHEN s_op='eq' AND r_bound IS NULL THEN s_value END AS max,
   CASE WHEN reason_code NOT IN ('BOUND_OK','BOUND_UNKNOWN') THEN r_value
        WHEN reason_code IN ('NO_SPEC') THEN r_value END AS value,
   CASE WHEN reason_code IN ('BOUND_OK','DECIMAL_RISK','') THEN 'PASS'
        WHEN reason_code IN ('OUTSIDE','OUTSIDE_DECIMAL_RISK') THEN 'FAIL' ELSE 'SKIP' END AS status,
   reason_code IN ('BOUND_UNKNOWN','BOUNDARY','EQ_COPY','EQ_NO_DIRECTION','DECIMAL_RISK','OUTSIDE_DECIMAL_RISK') AS needs_review
   FROM {out}1)"""
