"""Queries over reports and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate import fixtures as fx
from specgate.operators import reports as R
from specgate.operators import verdict as V
from specgate.session import materialize

PAGE, ID = fx.PAGE, fx.ITEM


def _ruled():
    return F.col("doc_id") % 2 == 0


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.evaluate(fx.items(spark, sf))


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return V.evaluate(fx.variants(spark, sf))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """The readings judged once, for plans with several branches over them."""
    return materialize(_readings(spark, sf))


def summarize(spark: SparkSession, sf: str) -> DataFrame:
    return R.summarize(_rows(spark, sf), PAGE)


def has_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf).groupBy(*PAGE, "variant").agg(
        F.bool_or(R.collapse(F.col("status"), F.col("reason_code"))).alias("collapsed")
    )


def pass_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return R.pass_multiset(_rows(spark, sf), ["doc_id"])


def challenger_beats(spark: SparkSession, sf: str) -> DataFrame:
    d = R.challenger_beats(_readings(spark, sf), PAGE, "flat", "grid")
    return d.select(*PAGE, "old_pass", "new_pass", "new_fail", "beats")


def _best(rows: DataFrame) -> DataFrame:
    return R.keep_best(rows, PAGE, "flat", "grid", _ruled())


def keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return _best(_judged(spark, sf)).select(*ID, "variant", "status", "spec_raw", "needs_review")


def provenance_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _judged(spark, sf)
    d = R.provenance_flags(_best(rows), rows.where(F.col("variant") == "flat"), PAGE, "grid", _ruled())
    return d.select(*ID, "variant", "status", "needs_review")


def carry_header(spark: SparkSession, sf: str) -> DataFrame:
    heads = fx.items(spark, sf).groupBy(*PAGE).agg(
        F.min_by(F.col("name"), F.col("item_seq")).alias("product"), F.min("item_seq").alias("__s")
    )
    old = heads.select(*PAGE, "product", F.col("doc_id").cast("string").alias("lot_no"))
    new = heads.select(
        *PAGE, F.when(F.col("doc_id") % 3 == 0, "product").otherwise(" ").alias("product"),
        F.when(F.col("doc_id") % 2 == 0, "lot").alias("lot_no"),
    ).withColumn("product", F.when(F.trim("product") != "", F.concat(F.lit("grid "), F.col("page"))).otherwise(" "))
    return R.carry_header(new, old, PAGE)


def reprocess_queue(spark: SparkSession, sf: str) -> DataFrame:
    return R.reprocess_queue(_rows(spark, sf), PAGE, fx.page_engines(spark, sf))


def keep_best_hq(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a second reading's grid are inferred, so only a collapse lets that grid replace its plain text."""
    second = materialize(V.evaluate(fx.second_variants(spark, sf)))
    second = R.keep_best(second, PAGE, "hq_flat", "hq_grid")
    best = materialize(_best(_judged(spark, sf)))
    return R.keep_best_hq(best, materialize(second), PAGE, fx.page_engines(spark, sf)).select(*ID, "variant", "status")


def report_verdict(spark: SparkSession, sf: str) -> DataFrame:
    s = R.summarize(_rows(spark, sf), PAGE)
    lot = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string"))
    return R.report_verdict(s, lot, F.col("page"), F.col("doc_id") % 2 + 1)


def status_share(spark: SparkSession, sf: str) -> DataFrame:
    s = R.status_share(R.summarize(_rows(spark, sf), PAGE))
    return s.select(*PAGE, *[F.round(c, 6).alias(c) for c in ("pass_pct", "fail_pct", "skip_pct")])


def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return R.batch_metrics(_rows(spark, sf), "doc_id")


def fail_listing(spark: SparkSession, sf: str) -> DataFrame:
    return R.fail_listing(_rows(spark, sf)).select(*ID, "name", "result", "spec_raw")


def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    return R.compare_models(_readings(spark, sf), "doc_id", "variant", ["flat", "grid"])


def regression_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _readings(spark, sf)
    return R.regression_diff(
        rows.where(F.col("variant") == "grid"), rows.where(F.col("variant") == "flat"), "doc_id", PAGE
    )


def ground_truth_grade(spark: SparkSession, sf: str) -> DataFrame:
    truth = fx.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("expected")
    )
    return R.ground_truth_grade(_rows(spark, sf), truth, ["doc_id"])


def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    kind = F.when(F.col("item_seq") % 3 == 0, "recovered").when(F.col("item_seq") % 3 == 1, "average").otherwise("column")
    touched = fx.items(spark, sf).where(F.col("item_seq") % 2 == 0).select(*PAGE, "name", kind.alias("kind"))
    return R.review_flags(rows, touched, PAGE).select(*ID, "status", "needs_review")


def promote_boundary(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "structural").when(F.col("doc_id") % 3 == 1, "scanned-vector").otherwise("spatial")
    return R.promote_boundary(_rows(spark, sf), source).select(*ID, "status", "needs_review", "reason_code")


def margin_green(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("needs_review", F.col("needs_review") | (F.col("item_seq") % 2 == 0))
    rows = rows.join(fx.page_engines(spark, sf), PAGE)
    return R.margin_green(rows, F.col("engine"), F.col("grid_source")).select(*ID, "status", "needs_review")


QUERIES = {f.__name__: f for f in (
    summarize, has_collapse, pass_multiset, challenger_beats, keep_best, provenance_flags, carry_header,
    reprocess_queue, keep_best_hq, report_verdict, status_share, batch_metrics, fail_listing, compare_models,
    regression_diff, ground_truth_grade, review_flags, promote_boundary, margin_green,
)}
