"""Certificate tables derived from the provided tables by arithmetic only.

They give every operator whole-table volume and an independent SQL answer. Four
consecutive orders make one document; a page holds about eight items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.scan import number_rows
from specgate.session import materialize

PAGE = ["doc_id", "page"]
ITEM = ["doc_id", "page", "item_seq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_derived: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived tables are written once per application to the shared folder; every query reads them whole."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _derived:
        _derived[key] = materialize(build(spark, sf_dir))
    return _derived[key]


def numbered_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", F.lower("p_type").alias("p_type"), "p_size"
    )
    base = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 4").alias("doc_id"),
        (1 + F.col("l_suppkey") % 2).cast("int").alias("page"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_extendedprice",
    )
    numbered = number_rows(
        base, PAGE, F.col("l_partkey") % 4, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "l_extendedprice"], "item_seq"
    )
    return numbered.join(part, "l_partkey")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate line per lineitem row, about eight to a page."""
    return _once(spark, sf_dir, "items", _items)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = numbered_lineitems(spark, sf_dir).withColumns({
        "lo": 1 + F.col("p_size") % 20, "hi": 26 + F.col("p_size") % 20,
    })
    return b.selectExpr(
        "doc_id", "page", "item_seq",
        """CASE WHEN l_partkey % 29 = 0 THEN concat('Lot number ', item_seq)
                ELSE concat(p_name, ' ', p_type, ' ', l_partkey) END AS name""",
        "CASE WHEN l_partkey % 5 = 0 THEN '%' WHEN l_partkey % 5 = 1 THEN 'mm' END AS unit",
        "CASE WHEN l_partkey % 6 = 0 THEN 'ISO 3310' END AS method",
        """CASE l_partkey % 12
             WHEN 0 THEN concat(lo, '-', hi)
             WHEN 1 THEN concat(lo, ' ~ ', hi, ' Success')
             WHEN 2 THEN concat('25 ± ', lo)
             WHEN 3 THEN concat('≤ ', hi, ' %')
             WHEN 4 THEN concat(hi, ' Max.')
             WHEN 5 THEN concat(lo, ' Min.')
             WHEN 6 THEN concat('≥ ', lo)
             WHEN 7 THEN concat('< ', hi)
             WHEN 8 THEN CAST(hi AS STRING)
             WHEN 9 THEN 'White'
             WHEN 10 THEN NULL
             ELSE concat(lo, '~4S') END AS spec_raw""",
        "CASE WHEN l_partkey % 12 = 10 AND l_suppkey % 5 > 0 THEN CAST(lo AS STRING) END AS spec_min",
        "CASE WHEN l_partkey % 12 = 10 AND l_suppkey % 3 > 0 THEN CAST(hi AS STRING) END AS spec_max",
        """CASE (q + l_suppkey) % 11
             WHEN 0 THEN concat('<', q)
             WHEN 1 THEN 'White'
             WHEN 2 THEN NULL
             WHEN 3 THEN concat(q, ' ', q + 2)
             WHEN 4 THEN concat(q, ',5')
             WHEN 5 THEN concat('≥ ', q)
             ELSE CAST(q AS STRING) END AS result""",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_items(items(spark, sf_dir))


def lines_of_items(i: DataFrame) -> DataFrame:
    """Page lines with missing names, foreign results and stamp lines."""
    return i.selectExpr(
        "doc_id", "page", "item_seq AS line_no",
        """CASE WHEN item_seq % 9 = 0 THEN 'By : QA Dept.'
                WHEN item_seq % 7 = 0 THEN concat(coalesce(spec_raw, '-'), '  |  ', coalesce(result, '-'))
                ELSE concat(name, '  |  ',
                            coalesce(spec_raw, concat(coalesce(spec_min, ''), '~', coalesce(spec_max, ''))),
                            '  |  ', CASE WHEN item_seq % 5 = 0 THEN '77' ELSE coalesce(result, '13') END)
           END AS line""",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word box per printed field: name, limit and result of every item; cheaper to derive from the written items again
    than to write and read."""
    i = items(spark, sf_dir).withColumn(
        "cells", F.expr("array(name, coalesce(spec_raw, concat(spec_min, '~', spec_max)), result)")
    )
    c = i.select(*ITEM, F.posexplode("cells").alias("col", "text")).where(F.col("text").isNotNull())
    return c.selectExpr(
        "doc_id", "page", "item_seq * 3 + col AS token_seq", "text",
        "CAST((80 + item_seq % 20) / 100.0 AS DOUBLE) AS score",
        "CAST(100 + 300 * col + item_seq % 5 AS DOUBLE) AS x",
        "CAST(100 + 40 * item_seq + col * 2 AS DOUBLE) AS y",
        "CAST(100 + 40 * item_seq + col * 2 - 10 - item_seq % 2 AS DOUBLE) AS y1",
        "CAST(100 + 40 * item_seq + col * 2 + 10 AS DOUBLE) AS y2",
        "CAST(100 + 300 * col + item_seq % 5 + 10 * length(text) AS DOUBLE) AS x2",
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings per page: 'flat' copies the result into the limit of every third item."""
    i = items(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("flat"), F.lit("grid"))))
    return i.withColumn(
        "spec_raw",
        F.expr("CASE WHEN variant = 'flat' AND item_seq % 3 = 0 THEN result ELSE spec_raw END"),
    )


def second_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a second, better engine: one copies fewer results into the limit, the other loses some results."""
    i = items(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("hq_flat"), F.lit("hq_grid"))))
    return i.withColumns({
        "spec_raw": F.expr("CASE WHEN variant = 'hq_flat' AND item_seq % 6 = 0 THEN result ELSE spec_raw END"),
        "result": F.expr("CASE WHEN variant = 'hq_grid' AND item_seq % 10 = 0 THEN NULL ELSE result END"),
    })


def page_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine, image and size of the second text of every page; also where its grid comes from."""
    return items(spark, sf_dir).select(*PAGE).distinct().selectExpr(
        *PAGE, "CASE WHEN doc_id % 3 = 0 THEN 'text-layer' ELSE 'rapidocr' END AS engine", "(doc_id + page) % 7 > 0 AS has_image",
        "CASE WHEN (2 * doc_id + page) % 5 = 0 THEN 49 ELSE 50 END AS second_chars",
        "CASE doc_id % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'scanned-vector' WHEN 2 THEN 'spatial' END AS grid_source",
    )
