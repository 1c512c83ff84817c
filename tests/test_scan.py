"""Scans, medians and falling runs of large groups against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from specgate import scan
from specgate.operators import layout
from specgate.operators.sieve import descending_pages
from specgate.session import materialize

PAGE = ["doc_id", "page"]


def test_upper_median(spark):
    r = random.Random(1)
    pages = {1: [r.choice((10.0, 10.5, 11.25, 1e-9, 1e12)) for _ in range(999)], 2: [5.0], 3: [0.0, -1.0], 4: [r.random() for _ in range(5_000)],
             5: [1.0, 2.0], 6: [r.random() * 1e-3 for _ in range(700)] + [1e9] * 600, 7: [3.0] * 10, 8: [r.expovariate(1) ** 9 for _ in range(3_001)]}
    rows = [(1, p, v) for p, values in pages.items() for v in values]
    got = {x["page"]: x["m"] for x in scan.upper_median(spark.createDataFrame(rows, "doc_id long, page int, v double"), PAGE, "v", "m", 20.0).collect()}
    for p, values in pages.items():
        positive = sorted(v for v in values if v > 0)
        assert got[p] == (positive[len(positive) // 2] if positive else 20.0), p


def plain_islands(values, gap):
    out, number, last = [], -1, None
    for v, seq in sorted(values):
        number += last is None or v - last > gap
        last = v
        out.append((v, seq, number))
    return out


def test_islands_with_quantile_bands(spark, monkeypatch):
    monkeypatch.setattr(scan, "BAND_ROWS", 50)
    r = random.Random(2)
    for spread in (30, 3_000, 100_000):
        values = [(float(r.randint(0, spread)), k) for k in range(2_000)] + [(7.0, k) for k in range(2_000, 2_500)]
        d = spark.createDataFrame([(1, 1, *v) for v in values] + [(1, 2, 5.0, 1), (1, 2, 90.0, 2)], "doc_id long, page int, x double, token_seq long")
        got = sorted((x["x"], x["token_seq"], x["i"]) for x in scan.islands(d, PAGE, "x", ["token_seq"], 10.0, "i").where("page = 1").collect())
        assert got == sorted(plain_islands(values, 10.0))
        bands = scan.quantile_bands(d, PAGE, "x", "b").where("page = 1").groupBy("b").count().collect()
        assert len(bands) >= 10


def test_large_page(spark):
    """A page of 200,000 tokens: several bands of rows and of columns, and the same rows as a plain scan."""
    n = 200_000
    t = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("token_seq"), F.lit("t").alias("text"),
                              (F.col("id") % 40 * 50.0).alias("x"), (F.floor(F.col("id") / 40) * 30.0).alias("y"))
    t = t.withColumns({"y1": F.col("y") - 10, "y2": F.col("y") + 10 + F.col("token_seq") % 3, "x2": F.col("x") + 30})
    placed = layout.column_bands(t)
    assert placed.select("row_no").distinct().count() == n // 40 and placed.where("row_no != floor(y / 30) OR col_no != x / 50").count() == 0
    for axis in ("x", "y"):
        largest = scan.quantile_bands(t, PAGE, axis, "b").groupBy("b").count().agg(F.max("count"), F.count("*")).first()
        assert largest[1] >= 8 and largest[0] <= n / 6


def test_falling_openings(spark):
    rows = []
    for page, values in {1: [9.0, 8.0, 8.0, 1.0], 2: [9.0, 8.0, 8.5], 3: [2.0, 2.0, 1.0], 4: list(range(20_000, 0, -1)), 5: [*range(20_000, 0, -1), 2]}.items():
        rows += [(1, page, k, float(v)) for k, v in enumerate(values)]
    rows += [(1, 6, 4_095, 5.0), (1, 6, 4_096, 6.0), (1, 6, 9_000, 1.0)]  # grows from one band to the next
    d = spark.createDataFrame(rows, "doc_id long, page int, item_seq long, opening double")
    assert {x["page"] for x in descending_pages(d, "item_seq").collect()} == {1, 4}


def test_bands_and_plain_windows_agree(spark, monkeypatch):
    r = random.Random(5)
    rows = [(1, p, float(r.randint(0, 900)), k, r.choice((None, k))) for p, n in ((1, 700), (2, 1), (3, 40)) for k in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, page int, v double, seq long, mark long")
    found = []
    for band_rows in (50, 10_000):
        monkeypatch.setattr(scan, "BAND_ROWS", band_rows)
        assert scan.oversized(d, PAGE) == (band_rows == 50)
        x = scan.islands(d, PAGE, "v", ["seq"], 2.0, "island")
        x = scan.number_rows(x, PAGE, F.floor(F.col("seq") / 64), ["seq"], "no")
        x = scan.running_sum(x, PAGE, F.floor(F.col("seq") / 64), ["seq"], F.col("mark"), "total")
        x = scan.fill_forward(x, PAGE, "seq", {"last": "mark"}, 64)
        x = scan.upper_median(x, PAGE, "v", "median", 20.0)
        found.append((x.schema.simpleString(), sorted(tuple(c or 0 for c in y) for y in x.collect())))
    assert found[0] == found[1]


def test_large_tables_are_not_sent_through_the_driver(spark):
    """300,000 repeating rows make a file of a few kilobytes, which the planner took for a small table."""
    d = materialize(spark.range(300_000).selectExpr("1L AS doc_id", "1 AS page", "id % 7 AS k"))
    other = d.groupBy("k").agg(F.count("*").alias("n"))
    assert "Broadcast" not in d.join(other, "k")._jdf.queryExecution().executedPlan().toString()
