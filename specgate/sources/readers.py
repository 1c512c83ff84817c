"""Files, token lists, extraction and grid JSON to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.functions.text import WS, split_cells, split_lines

SUFFIXES = ["pdf", "png", "jpg", "jpeg"]
#: The suffixes in any mixture of cases, as a glob.
ACCEPTED_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES) + "}"
TOKEN = "struct<text:string,score:double,x:double,y:double,y1:double,y2:double,x2:double>"
ITEM = "struct<name:string,unit:string,method:string,specRaw:string,specMin:string,specMax:string,result:string>"
EXTRACTION = f"struct<product:string,lotNo:string,items:array<{ITEM}>>"
GRID_PAGE = (
    "struct<page:int,grid:string,source:string,orient:string,col_edges_pt:array<double>,page_width:double,"
    "page_height:double,page_rotation:int,table_bbox:array<double>>"
)
GRIDS = f"struct<engine:string,pages:array<{GRID_PAGE}>,error:string>"


def accepted_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(SUFFIXES)


def clean_name(name: Column) -> Column:
    """File name without upload prefix, white space as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"^\d+-", ""), rf"{WS}+", "_")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """A1: accepted files with clean name and content hash; contents stay on the executors."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", ACCEPTED_GLOB).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return d.select("path", clean_name(name).alias("filename"), "modificationTime", "length", F.sha2("content", 256).alias("sha256"))


def dedupe_by_content(df: DataFrame, ledger: DataFrame, order: str, digest: str = "sha256") -> DataFrame:
    """A2: contents seen before are skipped, equal contents are processed once (first by `order`).

    A minimum per hash combines map-side, so very many copies of one file are no skew.
    """
    fresh = df.join(ledger.select(digest).distinct(), digest, "left_anti")
    others = [c for c in fresh.columns if c != digest]
    return fresh.groupBy(digest).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("k")).select(digest, "k.*")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A3: token files, one JSON array each."""
    return tokens_from_json(spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("json")))


def _no_json(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$"), F.lit("")) == ""


def _rejected(df: DataFrame, reason: Column) -> DataFrame:
    """Documents with a reason, without their content: they never stop the batch and never vanish."""
    return df.select(*[c for c in df.columns if c != "json"], reason.alias("reason")).where("reason IS NOT NULL")


def rejected_tokens(df: DataFrame) -> DataFrame:
    """A3, A10: documents that give no tokens, with the reason."""
    tokens = F.from_json("json", f"array<{TOKEN}>")
    return _rejected(df, F.when(_no_json(F.col("json")), "not json").when(tokens.isNull() | (F.size(tokens) == 0), "no tokens"))


def rejected_extractions(df: DataFrame) -> DataFrame:
    """A5, A10: documents that give no items, with the reason; each of them is an empty report."""
    items = F.from_json("json", EXTRACTION)["items"]
    return _rejected(df, F.when(_no_json(F.col("json")), "not json").when(items.isNull() | (F.size(items) == 0), "no items"))


def rejected_grids(df: DataFrame) -> DataFrame:
    """Documents that give no pages, with the reason or the error they report."""
    g = F.from_json("json", GRIDS)
    return _rejected(df, F.when(_no_json(F.col("json")), "not json").when(g["error"].isNotNull(), g["error"])
                     .when(g["pages"].isNull() | (F.size(g["pages"]) == 0), "no pages"))


def tokens_from_json(df: DataFrame) -> DataFrame:
    parsed = F.from_json("json", f"array<{TOKEN}>")
    return df.select(*[c for c in df.columns if c != "json"], F.posexplode(parsed).alias("token_seq", "t")).select(
        *[c for c in df.columns if c != "json"], "token_seq", "t.*")


def lines_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A4: lines and cells of whole page texts."""
    d = pages.select(*keys, F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    return d.withColumn("cells", split_cells(F.col("line")))


def parse_extractions(df: DataFrame) -> DataFrame:
    """A5: extractor JSON to items; text that is no JSON or has no item array gives no items."""
    keys = [c for c in df.columns if c != "json"]
    d = df.select(*keys, F.from_json("json", EXTRACTION).alias("e"))
    d = d.select(*keys, "e.product", F.col("e.lotNo").alias("lot_no"), F.posexplode("e.items").alias("pos", "i"))
    return d.select(
        *keys, "product", "lot_no", (F.col("pos") + 1).cast("bigint").alias("item_seq"), "i.name", "i.unit", "i.method",
        F.col("i.specRaw").alias("spec_raw"), F.col("i.specMin").alias("spec_min"), F.col("i.specMax").alias("spec_max"), "i.result")


def read_grids(df: DataFrame) -> DataFrame:
    """Grid JSON to one row per page, missing text as '' and missing source as 'none'."""
    keys = [c for c in df.columns if c not in ("json", "page")]
    d = df.select(*keys, F.from_json("json", GRIDS).alias("g")).where(F.col("g.error").isNull())
    d = d.select(*keys, F.explode("g.pages").alias("p"))
    return d.select(
        *keys, "p.page", F.coalesce("p.grid", F.lit("")).alias("grid"), F.coalesce("p.source", F.lit("none")).alias("source"),
        "p.orient", F.col("p.col_edges_pt").alias("col_edges"), "p.page_width", "p.page_height", "p.page_rotation", "p.table_bbox")


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """A10: (good, bad); a document that cannot be read never stops the batch."""
    bad = F.coalesce(bad, F.lit(True))
    return df.where(~bad), df.where(bad)
