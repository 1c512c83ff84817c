"""DuckDB answers for plans/judging.py."""

from __future__ import annotations

from specgate.oracle import base as B

ID = "doc_id, page, item_seq"
EV = f"WITH {B.ITEMS}, {B.evaluated()}"


def _tok(keep: str, cond: str, src: str = "name") -> str:
    return (
        f"array_to_string(list_filter(string_split(regexp_replace(lower({src}), '[^{keep}]+', ' ', 'g'), ' '), "
        f"lambda t: {cond}), ' ')"
    )


_units = r"g/cm3?|kg/cm2?|g/10\s*min|g/l|m2/g|[μµ]m|um|mm|ppm|cm|kg|wt|sec|min|\(m/m\)"
_num_text = "CASE WHEN z = floor(z) THEN CAST(CAST(z AS BIGINT) AS VARCHAR) ELSE CAST(z AS VARCHAR) END"


def _show(c: str) -> str:
    return f"(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END)"


def _codes(*codes: str) -> str:
    wanted = ", ".join(f"'{c}'" for c in codes)
    return f"{EV} SELECT {ID}, reason_code, status, min, max, value AS result, needs_review FROM ev WHERE reason_code IN ({wanted})"


SQL = {
    "normalize_specs": f"""WITH {B.ITEMS}, {B.parsed_specs('items', ['spec_raw'])}
        SELECT {ID}, op, CASE WHEN op IS NOT NULL THEN min END AS lo, CASE WHEN op IS NOT NULL THEN max END AS hi,
        CASE WHEN op IS NOT NULL THEN value END AS value, CASE WHEN op IS NOT NULL THEN raw END AS raw
        FROM items LEFT JOIN sp ON spec_raw = x""",
    "resolve_spec": f"""WITH {B.ITEMS}, {B.resolved_items()}
        SELECT {ID}, s_op AS op, s_min AS lo, s_max AS hi, s_value AS value, s_raw AS raw FROM ri""",
    "normalize_results": f"""WITH {B.ITEMS}, {B.with_results('items', 'r')}
        SELECT {ID}, r_value AS value, CASE WHEN r_value IS NULL THEN NULL WHEN len(r_nums) > 1 THEN 'all_values' ELSE 'single' END AS source,
        CASE WHEN len(r_nums) > 1 THEN CAST(len(r_nums) AS INT) END AS n_values,
        CASE WHEN r_value IS NOT NULL THEN r_text END AS raw, r_bound AS bound FROM r""",
    "numeric_cells": rf"""WITH {B.ITEMS}
        SELECT {ID}, TRY_CAST(CASE WHEN contains(result, ',') THEN replace(result, ',', '.') ELSE result END AS DOUBLE) AS result_num,
        translate(spec_raw, 'OoQDIl|ZSGTBg', '0000111256789') AS repaired,
        TRY_CAST(CASE WHEN regexp_matches(replace(result, ' ', ''), '^[-+]?\d+([.,]\d+)?$') THEN replace(replace(result, ' ', ''), ',', '.') END AS DOUBLE) AS single,
        TRY_CAST(replace(regexp_extract(replace(result, ' ', ''), '^(?:[<>≤≥≦≧]=?)?([-+]?\d+(?:[.,]\d+)?)$', 1), ',', '.') AS DOUBLE) AS aperture,
        coalesce(array_to_string(list_transform(list_transform(regexp_extract_all(regexp_replace(regexp_replace(spec_raw, '[~±]', ' ', 'g'), '(\d)\s*-\s*(\d)', '\1 \2', 'g'), '-?\d+(?:[.,]\d+)?'),
            lambda z: CAST(replace(z, ',', '.') AS DOUBLE)), lambda z: {_num_text}), ','), '') AS cell_nums,
        coalesce(array_to_string(list_transform(regexp_extract_all(result, '-?\d+(?:[.,]\d+)?'), lambda z: regexp_replace(z, '\D', '', 'g')), ','), '') AS digits
        FROM items""",
    "name_signatures": rf"""WITH {B.ITEMS} SELECT {ID},
        {_tok('a-z', 'length(t) >= 3')} AS name_tokens,
        {_tok('a-z0-9', "length(t) >= 2 OR regexp_matches(t, '[0-9]')")} AS signature,
        {_tok('a-z0-9', 'length(t) >= 2')} AS signal,
        regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name_key, lower(coalesce(spec_raw, '')) AS spec_key,
        regexp_replace(spec_raw, '\s*\bsuccess$', '', 'i') AS no_judgement,
        trim(replace(regexp_replace(regexp_replace(regexp_replace(spec_raw, '[%℃°]', '', 'g'), 'min\.', '#@.', 'gi'), '{_units}', '', 'gi'), '#@', 'Min')) AS no_units,
        coalesce(spec_raw, '') AS glyphs FROM items""",
    "display_values": f"""{EV} SELECT {ID}, coalesce(nullif(spec_raw, ''), {_show('min')} || '~' || {_show('max')}, '<=' || {_show('max')}, '>=' || {_show('min')}, '-') AS spec_text,
        coalesce({_show('min')} || '~' || {_show('max')}, '<=' || {_show('max')}, '>=' || {_show('min')}, '-') AS bounds_text,
        CASE WHEN value IS NULL THEN '-' ELSE regexp_replace(printf('%.3f', floor(value / 8 * 1000 + 0.5) / 1000), '\\.?0+$', '') END AS eighth_text FROM ev""".replace("\\\\", "\\"),
    "spec_format_coverage": rf"""WITH {B.ITEMS}, {B.parsed_specs('items', ['spec_raw'])}
        SELECT coalesce(op, 'none') AS op, regexp_replace(spec_raw, '\d+', '9', 'g') AS notation,
        CAST(count(*) AS BIGINT) AS n_items, CAST(count(DISTINCT spec_raw) AS BIGINT) AS n_notations
        FROM items LEFT JOIN sp ON spec_raw = x WHERE spec_raw IS NOT NULL GROUP BY 1, 2""",
    "evaluate": f"""{EV} SELECT {ID}, name, unit, method, min, max, value AS result, status, reason_code, spec_raw, result_raw, needs_review FROM ev""",
    "evaluate_bound": f"""{EV} SELECT {ID}, r_bound AS bound, s_op AS op, status = 'PASS' AS proved FROM ev WHERE r_bound IS NOT NULL AND s_op IS NOT NULL""",
    "boundary_guard": _codes("BOUNDARY"),
    "bare_eq_guard": _codes("EQ_COPY", "EQ_NO_DIRECTION"),
    "decimal_risk": _codes("DECIMAL_RISK", "OUTSIDE_DECIMAL_RISK"),
    "filter_metadata_rows": f"""WITH {B.ITEMS}, {B.resolved_items()}
        SELECT {ID}, name, NOT (name LIKE 'Lot number%' AND s_op IS NULL) AS kept FROM ri""",
}
