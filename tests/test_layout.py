"""Rows, columns and grids of a page from one shuffle, and merged chunks, against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from specgate.operators import layout

PAGE = ["doc_id", "page"]
TOKEN = "doc_id long, page int, token_seq long, text string, x double, y double, y1 double, y2 double, width double"


def tokens(spark, rows=200, pages=3):
    r = random.Random(4)
    data = [(p % 2, p, 7 * s, r.choice(("a", "12", "3.4", "Min", "Max", "b c")), float(r.randrange(400)), float(r.randrange(300)), 0.0,
             float(r.randrange(-3, 30)), 6.0) for p in range(pages) for s in range(rows)]
    return spark.createDataFrame(data, TOKEN)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def lines_of(df):
    return sorted(map(tuple, df.collect()))


QUERIES = {
    "rows_to_lines": lambda t: layout.rows_to_lines(layout.cluster_rows(t)),
    "column_bands_grid": layout.column_bands_grid,
    "column_anchors": lambda t: layout.anchored_lines(layout.column_anchors(layout.cluster_rows_textlayer(t))),
    "header_direction_hints": layout.header_direction_hints,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_pages_move_once(spark, name):
    """One shuffle by page: medians, edges, anchors and headers are not joined back."""
    assert exchanges(QUERIES[name](tokens(spark))) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_large_pages_agree(spark, monkeypatch, name):
    """Pages over the limit of one task give the same rows."""
    from specgate import scan

    t = tokens(spark)
    small = lines_of(QUERIES[name](t))
    monkeypatch.setattr(scan, "BAND_ROWS", 50)
    assert small and lines_of(QUERIES[name](t)) == small


def test_grid_lines_keep_empty_cells(spark):
    placed = spark.createDataFrame([(1, 1, 0, 2, 5.0, 1, "b"), (1, 1, 0, 2, 4.0, 2, "a"), (1, 1, 0, 4, 9.0, 3, None), (1, 1, 1, 0, 0.0, 4, ""), (1, 1, 2, 0, 0.0, 5, None),
                                    (1, 1, 2, 0, 1.0, 6, "z")], "doc_id long, page int, row_no long, col_no long, x double, token_seq long, text string")
    got = {r.row_no: r.line for r in layout.grid_lines(placed, ["x", "token_seq"], "|").collect()}
    assert got == {0: "||a b||", 1: "", 2: "z"}
    wide = {r.row_no: r.line for r in layout.grid_lines(placed, ["x", "token_seq"], "|", F.lit(6)).collect()}
    assert wide == {0: "||a b|||", 1: "|||||", 2: "z|||||"}


def plain_merge(toks):
    numeric = lambda t: re.fullmatch(r"[\d.,%\-+ºu°μ]+", t.strip())
    out = []
    for x, seq, text, width in sorted(toks):
        if out and x - (out[-1][0] + out[-1][3]) < 0.5 and numeric(out[-1][2]) and numeric(text):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + text, out[-1][3] + width)
        else:
            out.append((x, seq, text, width))
    return out


def test_merge_kerned(spark):
    r = random.Random(5)
    rows = {n: [(float(r.randrange(60)) * 3, s, r.choice(("1", "2 ", " 3", ".", "%", "a", "", "u")), r.choice((3.0, 2.0, 9.0))) for s in range(r.randrange(1, 40))]
            for n in range(60)}
    flat = [(1, 1, n, *t) for n, toks in rows.items() for t in toks]
    df = spark.createDataFrame(flat, "doc_id long, page int, row_no long, x double, token_seq long, text string, width double")
    got = sorted(tuple(x)[2:] for x in layout.merge_kerned(df).collect())
    assert got == sorted((n, *t) for n, toks in rows.items() for t in plain_merge(toks))


def test_characters_are_not_shuffled(spark):
    """Texts are split inside their printed rows; only the boxes move, once."""
    from specgate.plans.layouting import kerned_rows

    assert exchanges(layout.merge_kerned_rows(kerned_rows(layout.cluster_rows_textlayer(tokens(spark))))) == 1


def test_kerned_runs_with_gaps(spark):
    """Runs of numbers that touch throughout, in part or not at all, with blanks and letters between; only those with gaps are folded."""
    def chunks(text, width=6.0, gaps=()):
        x, out = 0.0, []
        for k, c in enumerate(text):
            x += 9.0 if k in gaps else 0.0
            out.append((x, k, c, width))
            x += width
        return out

    rows = [(1, 1, 0, chunks("a12.5%b")), (1, 1, 1, chunks("1234", gaps=(2,))), (1, 1, 2, chunks("12 34")), (1, 1, 3, chunks("9x8")),
            (1, 1, 4, [(0.0, 0, "1 ", 6.0), (6.0, 1, "2", 6.0), (12.0, 2, "3", 6.0)]), (1, 1, 5, [(0.0, 0, "1", None), (6.0, 1, "2", 6.0)]), (1, 1, 6, [])]
    df = spark.createDataFrame(rows, "doc_id long, page int, row_no long, toks array<struct<x:double,token_seq:bigint,text:string,width:double>>")
    merged = layout.merge_kerned_rows(df)
    got = {}
    for r in sorted(merged.collect(), key=lambda r: (r.row_no, r.token_seq)):
        got.setdefault(r.row_no, []).append((r.text, r.width))
    assert got == {0: [("a", 6), ("12.5%", 30), ("b", 6)], 1: [("12", 12), ("34", 12)], 2: [("12", 12), (" ", 6), ("34", 12)], 3: [("9", 6), ("x", 6), ("8", 6)],
                   4: [("1 2", 12), ("3", 6)], 5: [("1", None), ("2", 6)]}
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "concat(filter(toks" in plan  # touching runs are joined, other chunks pass as they are
