"""Queries over limits, results and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate import fixtures as fx
from specgate.functions import numbers as N
from specgate.functions import text as T
from specgate.functions.results import with_result
from specgate.functions.specs import spec_display, with_parsed, with_resolved_spec
from specgate.operators import verdict as V
from specgate.operators.cleaning import filter_metadata_rows, spec_format_coverage

ID = fx.ITEM


def normalize_specs(spark: SparkSession, sf: str) -> DataFrame:
    d = with_parsed(fx.items(spark, sf), {"s": "spec_raw"})
    return d.select(*ID, "s.op", F.col("s.min").alias("lo"), F.col("s.max").alias("hi"), "s.value", "s.raw")


def resolve_spec(spark: SparkSession, sf: str) -> DataFrame:
    d = with_resolved_spec(fx.items(spark, sf))
    return d.select(*ID, "spec.op", F.col("spec.min").alias("lo"), F.col("spec.max").alias("hi"), "spec.value", "spec.raw")


def normalize_results(spark: SparkSession, sf: str) -> DataFrame:
    d = with_result(fx.items(spark, sf))
    return d.select(
        *ID, "res.value", "res.source", F.size("res.values").alias("n_values"), "res.raw",
        F.col("res.bound.op").alias("bound"),
    ).withColumn("n_values", F.when(F.col("n_values") > 0, F.col("n_values")))


def numeric_cells(spark: SparkSession, sf: str) -> DataFrame:
    """E4, E8, E10, E11 on every printed limit and result."""
    i = fx.items(spark, sf)
    return i.select(
        *ID, N.to_num(F.col("result")).alias("result_num"),
        T.repair_ocr_digits(F.col("spec_raw")).alias("repaired"),
        N.single_number(F.col("result")).alias("single"),
        N.aperture(F.col("result")).alias("aperture"),
        F.concat_ws(",", F.transform(N.cell_numbers(F.col("spec_raw")), N.number_text)).alias("cell_nums"),
        F.concat_ws(",", F.transform(N.line_numbers(F.col("result")), lambda t: t["digits"])).alias("digits"),
    )


def name_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """E5, E6, E7, E9 on every item."""
    n, s = F.col("name"), F.col("spec_raw")
    return fx.items(spark, sf).select(
        *ID, F.concat_ws(" ", T.name_tokens(n)).alias("name_tokens"),
        F.concat_ws(" ", T.signature(n)).alias("signature"), F.concat_ws(" ", T.name_signal(n)).alias("signal"),
        T.name_key(n).alias("name_key"), T.spec_key(s).alias("spec_key"),
        T.strip_judgement(s).alias("no_judgement"), T.strip_units(s).alias("no_units"),
        T.normalize_glyphs(F.translate(s, "~%", "～％")).alias("glyphs"),
    )


def display_values(spark: SparkSession, sf: str) -> DataFrame:
    e = V.evaluate(fx.items(spark, sf))
    return e.select(
        *ID, spec_display(F.col("spec_raw"), F.col("min"), F.col("max")).alias("spec_text"),
        spec_display(F.lit(None).cast("string"), F.col("min"), F.col("max")).alias("bounds_text"),
        N.number_display(F.col("result") / 8, "-").alias("eighth_text"),
    )


def spec_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spec_format_coverage(fx.items(spark, sf))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    e = V.evaluate(fx.items(spark, sf))
    return e.select(
        *ID, "name", "unit", "method", "min", "max", "result", "status", "reason_code", "spec_raw", "result_raw",
        "needs_review",
    )


def bound_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    d = with_result(with_resolved_spec(fx.items(spark, sf)))
    d = d.where(F.col("res.bound").isNotNull() & F.col("spec").isNotNull())
    return d.select(
        *ID, F.col("res.bound.op").alias("bound"), F.col("spec.op").alias("op"),
        V.bound_proves(F.col("res.bound"), F.col("spec")).alias("proved"),
    )


def _by_code(codes: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = V.evaluate(fx.items(spark, sf)).where(F.col("reason_code").isin(codes))
        return e.select(*ID, "reason_code", "status", "min", "max", "result", "needs_review")

    return run


def metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = filter_metadata_rows(fx.items(spark, sf))
    return kept.select(*ID, "name", F.lit(True).alias("kept")).unionByName(
        dropped.select(*ID, "name", F.lit(False).alias("kept"))
    )


QUERIES = {
    "normalize_specs": normalize_specs,
    "resolve_spec": resolve_spec,
    "normalize_results": normalize_results,
    "numeric_cells": numeric_cells,
    "name_signatures": name_signatures,
    "display_values": display_values,
    "spec_format_coverage": spec_coverage,
    "evaluate": evaluated,
    "evaluate_bound": bound_verdicts,
    "boundary_guard": _by_code(["BOUNDARY"]),
    "bare_eq_guard": _by_code(["EQ_COPY", "EQ_NO_DIRECTION"]),
    "decimal_risk": _by_code(["DECIMAL_RISK", "OUTSIDE_DECIMAL_RISK"]),
    "filter_metadata_rows": metadata_rows,
}
