"""Queries over sources, sinks and page selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate import fixtures as fx
from specgate.operators import pages as P
from specgate.operators import reports as R
from specgate.operators import verdict as V
from specgate.plans.layouting import geometry
from specgate.session import checkpoint_dir, materialize
from specgate.sources import readers as S
from specgate.sources import writers as W
from specgate.streaming import ingest as I

PAGE, ID = fx.PAGE, fx.ITEM


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages two to five of their files; beside them a blank first page in every second file, and two files of
    blank pages only."""
    d = fx.table(spark, sf, "documents").select("doc_id", "source", "text")
    real = d.selectExpr("doc_id div 4 AS doc_id", "CAST(doc_id % 4 + 2 AS INT) AS page", "source", "text")
    first = d.where("doc_id % 8 = 0").selectExpr("doc_id div 4 AS doc_id", "1 AS page", "source", "' ' AS text")
    blank = d.where("doc_id div 4 IN (3, 5)").selectExpr("-1 - doc_id div 4 AS doc_id", "CAST(doc_id % 4 + 1 AS INT) AS page", "source", "' ' AS text")
    return real.unionByName(first).unionByName(blank)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three engines for every page, text missing from some; beside them seventh pages without a fallback reading."""
    p = _pages(spark, sf).withColumn("engine", F.explode(F.array(*[F.lit(e) for e in ("text-layer", "rapidocr", "tesseract")])))
    gone = "(engine = 'text-layer' AND doc_id % 3 <> 0) OR (engine = 'rapidocr' AND (doc_id + page) % 5 = 0)"
    thin = fx.table(spark, sf, "documents").where("doc_id div 4 % 9 = 4 AND doc_id % 4 = 0").selectExpr(
        "doc_id div 4 AS doc_id", "7 AS page", "source", "'thin' AS text", "explode(array('text-layer', 'rapidocr')) AS engine")
    return p.withColumn("text", F.expr(f"CASE WHEN {gone} THEN '' ELSE text END")).unionByName(thin)


def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(doc_id, '-', source, ' ', lang, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' ELSE '.txt' END) AS name")
    return d.where(S.accepted_name(F.col("name"))).select("doc_id", S.clean_name(F.col("name")).alias("filename"))


def dedupe_by_content(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return S.dedupe_by_content(d, d.where("doc_id % 10 = 0"), "doc_id")


def dedupe_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    keyed = stream.select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256).alias("sha256"))
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return I.ingest_available(keyed, f"{base}/out", f"{base}/state", "event_id").select("sha256")


def tokens_from_json(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tokens(spark, sf)
    fields = F.struct("text", "score", "x", "y", "y1", "y2", "x2")
    listed = t.groupBy(*PAGE, F.floor(F.col("token_seq") / 3).alias("block")).agg(F.sort_array(F.collect_list(F.struct("token_seq", fields.alias("t")))).alias("l"))
    j = listed.select(*PAGE, "block", F.to_json(F.transform("l", lambda s: s["t"])).alias("json"))
    return S.tokens_from_json(j).select(*PAGE, "block", "token_seq", "text", "x", "y")


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    d = S.lines_of(fx.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    return d.select("doc_id", "line_no", "line", F.size("cells").alias("n_cells"))


def _extraction_json(items: DataFrame) -> DataFrame:
    i = F.struct("name", "unit", "method", F.col("spec_raw").alias("specRaw"), F.col("spec_min").alias("specMin"),
                 F.col("spec_max").alias("specMax"), "result")
    doc = F.to_json(F.struct(F.col("doc_id").cast("string").alias("lotNo"), F.array(i).alias("items")))
    broken = F.when(F.col("item_seq") % 10 == 3, F.lit("not json")).when(F.col("item_seq") % 10 == 4, F.lit('{"items": 5}'))
    return items.select(*PAGE, F.col("item_seq").alias("part"), F.coalesce(broken, doc).alias("json"))


def parse_extractions(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_extractions(_extraction_json(fx.items(spark, sf)))


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    d = _extraction_json(fx.items(spark, sf))
    good, bad = S.quarantine(d, F.from_json("json", S.EXTRACTION)["items"].isNull())
    return good.select(*PAGE, "part", F.lit("good").alias("route")).unionByName(bad.select(*PAGE, "part", F.lit("bad").alias("route")))


def rejected_extractions(spark: SparkSession, sf: str) -> DataFrame:
    return S.rejected_extractions(_extraction_json(fx.items(spark, sf)))


def rejected_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.items(spark, sf).select(*PAGE, "item_seq", F.expr("""CASE item_seq % 5 WHEN 0 THEN '[' WHEN 1 THEN '[]'
        WHEN 2 THEN '5' ELSE to_json(array(struct(name AS text, 1.0D AS x))) END""").alias("json"))
    return S.rejected_tokens(t)


def rejected_grids(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid_json(spark, sf).withColumn("json", F.expr("""CASE doc_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN '{"error": "no table"}'
        WHEN 2 THEN '{"engine": "x"}' WHEN 3 THEN NULL ELSE json END"""))
    return S.rejected_grids(g)


def _grid_json(spark: SparkSession, sf: str) -> DataFrame:
    g = geometry(fx.tokens(spark, sf))
    page = F.struct(
        "page", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a | b "), F.col("page"))).alias("grid"),
        F.when(F.col("doc_id") % 3 == 0, "lines").when(F.col("doc_id") % 3 == 1, "vector-geom").alias("source"),
        F.lit("normal").alias("orient"), F.col("col_edges").alias("col_edges_pt"), "page_width", "page_rotation", "table_bbox")
    return g.select("doc_id", F.to_json(F.struct(F.lit("pdfplumber").alias("engine"), F.array(page).alias("pages"))).alias("json"))


def read_grids(spark: SparkSession, sf: str) -> DataFrame:
    g = S.read_grids(_grid_json(spark, sf))
    return g.select("doc_id", "page", "grid", "source", "orient", F.size("col_edges").alias("n_edges"), "page_width", "page_rotation")


def _reports(spark: SparkSession, sf: str):
    rows = materialize(V.evaluate(fx.items(spark, sf)))
    return R.summarize(rows, PAGE), rows


def write_reports_json(spark: SparkSession, sf: str) -> DataFrame:
    reports, rows = _reports(spark, sf)
    path = f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    W.write_reports_json(reports, rows, path)
    back = spark.read.schema("doc_id bigint, page int, n_total bigint, rows array<struct<item_seq:bigint,name:string,status:string>>").json(path)
    return back.select(*PAGE, "n_total", F.inline("rows"))


def write_relational(spark: SparkSession, sf: str) -> DataFrame:
    reports, rows = _reports(spark, sf)
    path = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    W.write_relational(reports, rows, path)
    r = spark.read.parquet(f"{path}/reports").select("report_id", *PAGE, "n_pass", "n_fail", "n_skip", "n_total")
    n = spark.read.parquet(f"{path}/items").groupBy("report_id").agg(F.count(F.lit(1)).alias("n_items"))
    return r.join(n, "report_id")


def public_view(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select(*PAGE, "source", F.struct(
        F.when(F.col("page") == 1, "tesseract").otherwise("text-layer").alias("ocr_engine"), F.col("text").alias("ocr_text")).alias("debug"))
    return W.public_view(p)


def usable_text(spark: SparkSession, sf: str) -> DataFrame:
    from specgate.functions.text import usable_text as usable

    t = F.col("text")
    return _pages(spark, sf).select(*PAGE, usable(t, P.TEXT_LAYER_CHARS).alias("as_text_layer"), usable(t, P.OCR_CHARS).alias("as_ocr"))


def select_page_text(spark: SparkSession, sf: str) -> DataFrame:
    good, refused = P.strict_split(P.select_page_text(_candidates(spark, sf)))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(refused)


def drop_blank_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.drop_blank_pages(_pages(spark, sf)).select(*PAGE, "text", "placeholder")


def page_alignment(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return P.page_alignment(p, p.where("NOT (page = 4 AND doc_id % 7 = 0)"))


def missing_images(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return P.missing_images(p, p.where("NOT (page = 4 AND doc_id % 7 = 0)"))


def first_text_page(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_text_page(_pages(spark, sf))


def routing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.routing_summary(_pages(spark, sf), "doc_id")


def attach_grid(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.items(spark, sf).select(*PAGE).distinct().withColumn(
        "engine", F.when(F.col("page") == 1, "text-layer").otherwise("rapidocr"))
    d = P.attach_grid(pages, S.read_grids(_grid_json(spark, sf)))
    return d.select(*PAGE, "engine", "grid_source", "grid_text", F.when(F.col("edges").isNotNull(), F.size("edges")).alias("n_edges"))


QUERIES = {f.__name__: f for f in (
    upload_names, dedupe_by_content, dedupe_stream, tokens_from_json, lines_of, parse_extractions, quarantine, read_grids,
    rejected_extractions, rejected_tokens, rejected_grids, missing_images,
    write_reports_json, write_relational, public_view, usable_text, select_page_text, drop_blank_pages, page_alignment,
    first_text_page, routing_summary, attach_grid,
)}
