"""Queries over grounding and guards (F1, H1-H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate import fixtures as fx
from specgate.operators import guards as G
from specgate.operators import verdict as V
from specgate.session import materialize

ID = fx.ITEM


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(V.evaluate(fx.items(spark, sf)))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(fx.lines(spark, sf))


def _show(d: DataFrame) -> DataFrame:
    return d.select(*ID, "status", "needs_review", "reason_code")


def guard_fails(spark: SparkSession, sf: str) -> DataFrame:
    return _show(G.guard_fails(_rows(spark, sf), _lines(spark, sf), ID))


def guard_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn(
        "result", F.when(F.col("item_seq") % 4 == 0, F.col("result") * 130).otherwise(F.col("result"))
    )
    return _show(G.guard_outliers(rows))


def guard_passes(spark: SparkSession, sf: str) -> DataFrame:
    return _show(G.guard_passes(_rows(spark, sf), _lines(spark, sf), ID))


def shifted_lines(lines: DataFrame) -> DataFrame:
    """Every second line printed as result | limit | another number."""
    parts = F.split("line", r"  \|  ")
    moved = F.concat_ws("  |  ", parts[2], parts[1], F.col("line_no") % 7)
    return lines.withColumn("line", F.when((F.size(parts) == 3) & (F.col("line_no") % 2 == 0), moved).otherwise(F.col("line")))


def guard_column_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _show(G.guard_column_shift(_rows(spark, sf), shifted_lines(_lines(spark, sf)), ID))


def drop_ungrounded(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the items get an invented name, so that numbers and columns must ground them, or a word over a line break."""
    at = F.col("item_seq") % 16
    items = fx.items(spark, sf).withColumn("name", F.when(at == 2, F.lit("Zqbreaker vx")).when(
        F.col("item_seq") % 2 == 0, F.concat(F.lit("Zq"), F.col("item_seq"), F.lit(" vx"))).otherwise(F.col("name")))
    seq = F.col("line_no") % 16
    lines = fx.lines(spark, sf).withColumn("line", F.when(seq == 2, F.concat("line", F.lit(" zqbre"))).when(
        seq == 3, F.concat(F.lit("aker "), "line")).otherwise(F.col("line")))
    kept, dropped = G.drop_ungrounded(items, lines, ID)
    return kept.select(*ID, F.lit(True).alias("kept")).unionByName(dropped.select(*ID, F.lit(False).alias("kept")))


QUERIES = {f.__name__: f for f in (guard_fails, guard_outliers, guard_passes, guard_column_shift, drop_ungrounded)}
