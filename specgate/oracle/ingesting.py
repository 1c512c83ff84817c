"""DuckDB answers for plans/ingesting.py."""

from __future__ import annotations

from specgate.oracle import base as B

P = "doc_id, page"
I = f"WITH {B.ITEMS}"
EV = f"{I}, {B.evaluated()}"
PG = """pg AS (SELECT doc_id // 4 AS doc_id, CAST(doc_id % 4 + 2 AS INT) AS page, source, text FROM documents
  UNION ALL SELECT doc_id // 4, 1, source, ' ' FROM documents WHERE doc_id % 8 = 0
  UNION ALL SELECT -1 - doc_id // 4, CAST(doc_id % 4 + 1 AS INT), source, ' ' FROM documents WHERE doc_id // 4 IN (3, 5))"""
CH = "length(regexp_replace(text, '\\s+', '', 'g'))"
SRC = "CASE doc_id % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'vector-geom' ELSE 'none' END"
GR = f"g AS (SELECT DISTINCT {P}, CASE WHEN doc_id % 2 = 0 THEN 'a | b ' || page ELSE '' END AS grid, {SRC} AS source, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 6 END AS n FROM items)"
CNT = """count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'SKIP') AS n_skip, count(*) AS n_total"""

SQL = {
    "upload_names": """SELECT doc_id, source || '_' || lang || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' ELSE '.jpeg' END AS filename FROM documents WHERE doc_id % 4 < 3""",
    "dedupe_by_content": """SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents
        WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1""",
    "dedupe_stream": "SELECT DISTINCT sha256(event_type || '|' || user_id || '|' || props) AS sha256 FROM events",
    "tokens_from_json": f"""{I}, {B.TOKENS} SELECT {P}, token_seq // 3 AS block,
        CAST(row_number() OVER (PARTITION BY {P}, token_seq // 3 ORDER BY token_seq) - 1 AS INT) AS token_seq, text, x, y FROM tokens""",
    "lines_of": r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split_regex(text, '\r?\n')))) AS line_no, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents)
        SELECT doc_id, CAST(line_no AS INT) AS line_no, line, CAST(len(list_filter(CASE WHEN contains(line, '|') THEN string_split(line, '|') ELSE string_split_regex(line, '\s{2,}') END,
          lambda c: regexp_replace(c, '\s', '', 'g') <> '')) AS INT) AS n_cells FROM l""",
    "parse_extractions": f"""{I} SELECT {P}, item_seq AS part, CAST(NULL AS VARCHAR) AS product, CAST(doc_id AS VARCHAR) AS lot_no, CAST(1 AS BIGINT) AS item_seq,
        name, unit, method, spec_raw, spec_min, spec_max, result FROM items WHERE item_seq % 10 NOT IN (3, 4)""",
    "quarantine": f"{I} SELECT {P}, item_seq AS part, CASE WHEN item_seq % 10 IN (3, 4) THEN 'bad' ELSE 'good' END AS route FROM items",
    "rejected_extractions": f"{I} SELECT {P}, item_seq AS part, CASE item_seq % 10 WHEN 3 THEN 'not json' ELSE 'no items' END AS reason FROM items WHERE item_seq % 10 IN (3, 4)",
    "rejected_tokens": f"{I} SELECT {P}, item_seq, CASE item_seq % 5 WHEN 0 THEN 'not json' ELSE 'no tokens' END AS reason FROM items WHERE item_seq % 5 < 3",
    "rejected_grids": f"{I}, {GR} SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'no table' WHEN 2 THEN 'no pages' ELSE 'not json' END AS reason FROM g WHERE doc_id % 5 < 4",
    "missing_images": f"WITH {PG} SELECT {P}, 'page has no image' AS error FROM pg WHERE page = 4 AND doc_id % 7 = 0",
    "read_grids": f"""{I}, {GR} SELECT {P}, grid, source, 'normal' AS orient, n AS n_edges, 600.0::DOUBLE AS page_width, CASE WHEN doc_id % 5 = 0 THEN 90 ELSE 0 END AS page_rotation FROM g""",
    "write_reports_json": f"{EV} SELECT {P}, count(*) OVER (PARTITION BY {P}) AS n_total, item_seq, name, status FROM ev",
    "write_relational": f"{EV} SELECT sha256(doc_id || '|' || page) AS report_id, {P}, {CNT}, count(*) AS n_items FROM ev GROUP BY {P}",
    "public_view": f"WITH {PG} SELECT {P}, source, CASE WHEN page = 1 THEN 'tesseract' ELSE 'text-layer' END AS ocr_engine FROM pg",
    "usable_text": f"WITH {PG} SELECT {P}, {CH} >= 300 AS as_text_layer, {CH} >= 50 AS as_ocr FROM pg",
    "select_page_text": f"""WITH {PG}, p2 AS (SELECT *, true AS fallback FROM pg UNION ALL SELECT doc_id // 4, 7, source, 'thin', false FROM documents WHERE doc_id // 4 % 9 = 4 AND doc_id % 4 = 0),
        c AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND {CH} >= 300 THEN 'text-layer' WHEN (doc_id + page) % 5 <> 0 AND {CH} >= 50 THEN 'rapidocr' WHEN fallback THEN 'tesseract' END AS engine FROM p2)
        SELECT {P}, engine, CASE WHEN engine IS NOT NULL THEN text END AS text,
        CASE WHEN engine IS NULL THEN 'no readable text' WHEN engine = 'tesseract' THEN 'primary recognition missing or thin' END AS error FROM c""",
    "drop_blank_pages": f"""WITH {PG} SELECT {P}, text, false AS placeholder FROM pg WHERE trim(text) <> ''
        UNION ALL SELECT doc_id, 1, '', true FROM pg GROUP BY doc_id HAVING max(length(trim(text))) = 0""",
    "page_alignment": f"""WITH {PG}, r AS (SELECT doc_id, count(*) AS t, count(*) FILTER (NOT (page = 4 AND doc_id % 7 = 0)) AS n FROM pg GROUP BY 1)
        SELECT doc_id, t AS text_pages, n AS rendered_pages, t - n AS missing_images, t = n AS aligned FROM r""",
    "first_text_page": f"""WITH {PG} SELECT doc_id, first(page ORDER BY trim(text) = '', page) AS page, first(text ORDER BY trim(text) = '', page) AS text FROM pg GROUP BY 1""",
    "routing_summary": f"""WITH {PG} SELECT doc_id, CAST(sum({CH}) AS BIGINT) AS n_chars, count(*) AS n_pages,
        CASE WHEN sum({CH}) >= 300 THEN 'text-layer' ELSE 'ocr-fallback' END AS route FROM pg GROUP BY 1""",
    "attach_grid": f"""{I}, {GR} SELECT {P}, CASE WHEN page = 1 THEN 'text-layer' ELSE 'rapidocr' END AS engine,
        CASE WHEN page = 1 AND source <> 'none' AND grid <> '' THEN 'structural' WHEN page = 2 AND source = 'vector-geom' THEN 'scanned-vector' END AS grid_source,
        CASE WHEN page = 1 AND source <> 'none' AND grid <> '' THEN grid END AS grid_text, CASE WHEN page = 2 AND source = 'vector-geom' THEN n END AS n_edges FROM g""",
}
