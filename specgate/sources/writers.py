"""Reports as nested JSON and as two related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
ROW = ["item_seq", "name", "unit", "method", "min", "max", "result", "status", "reason_code", "spec_raw", "result_raw", "needs_review"]


def nested_reports(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """One document per page with its rows in order; a page is the unit a report shows."""
    nested = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*ROW))).alias("rows"))
    return reports.join(nested, PAGE, "left")


def write_reports_json(reports: DataFrame, rows: DataFrame, path: str) -> None:
    """A7."""
    nested_reports(reports, rows).write.mode("overwrite").json(path)


def report_id(df: DataFrame) -> DataFrame:
    """The same page always gets the same id, so a repeated run writes the same tables."""
    return df.withColumn("report_id", F.sha2(F.concat_ws("|", *PAGE), 256))


def write_relational(reports: DataFrame, rows: DataFrame, path: str) -> None:
    """Reports and items joined by report_id."""
    report_id(reports).write.mode("overwrite").parquet(f"{path}/reports")
    report_id(rows).select("report_id", *PAGE, *ROW).write.mode("overwrite").parquet(f"{path}/items")


def public_view(reports: DataFrame) -> DataFrame:
    """What a client may see: no debug payload, but the engine that read the page."""
    return reports.withColumn("ocr_engine", F.col("debug.ocr_engine")).drop("debug")
