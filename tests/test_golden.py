"""Golden rows for the grammars, the verdicts, the guards and the recoveries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specgate.functions.results import with_result
from specgate.functions.specs import with_parsed, with_resolved_spec
from specgate.operators import cleaning, grid, guards, recover, sieve, verdict

ID = ["doc_id", "page", "item_seq"]
ITEM = "doc_id long, page int, item_seq long, name string, unit string, method string, spec_raw string, spec_min string, spec_max string, result string"
ROW = "doc_id long, page int, item_seq long, name string, status string, min double, max double, result double, spec_raw string, result_raw string, reason_code string, needs_review boolean, unit string, method string"

SPECS = {
    "275-425": ("between", 275, 425, None), "2-6": ("between", 2, 6, None), "40.0 ~ 70.0": ("between", 40, 70, None),
    "105〜115": ("between", 105, 115, None), "0.70-1.30": ("between", 0.7, 1.3, None), "26.0 ± 2.0": ("between", 24, 28, None),
    "120 +/- 30": ("between", 90, 150, None), "≤ 0.2": ("le", None, None, 0.2), "≦0.10": ("le", None, None, 0.1),
    "0.5 Max.": ("le", None, None, 0.5), "≥ 50": ("ge", None, None, 50), "99.2 Min.": ("ge", None, None, 99.2),
    "< 15": ("lt", None, None, 15), "> 50": ("gt", None, None, 50), "180": ("eq", None, None, 180),
    "270 -~350": ("between", 270, 350, None), "40.0 ~ - 70.0": ("between", 40, 70, None), "15 -45": ("between", 15, 45, None),
    "45 ~T5": ("between", 45, 75, None), "1OO-2OO": ("between", 100, 200, None), "4S~6S": ("between", 45, 65, None),
    "20 Max Success": ("le", None, None, 20), "0,28 g/cm3": ("eq", None, None, 0.28), "99 Min": ("eq", None, None, 99),
    "<5 Max": None, "Max 5": None, "Pass~Fail": None, "White": None, "K2Ti6O13": None, "": None, " 7 ± 3　": ("between", 4, 10, None),
}


def test_spec_grammar(spark):
    df = spark.createDataFrame([(k,) for k in SPECS], "raw string")
    got = {r.raw: r.s for r in with_parsed(df, {"s": "raw"}).collect()}
    for raw, want in SPECS.items():
        if want is None:
            assert got[raw] is None, raw
        else:
            s = got[raw]
            assert s is not None, raw
            assert (s.op, s.min, s.max, s.value) == pytest.approx(want), raw


CANDIDATES = [
    ((None, "0.90", "1.35"), ("between", 0.9, 1.35, None)), ((None, "93%", "97%"), ("between", 93, 97, None)),
    ((None, None, "0.20%"), ("le", None, None, 0.2)), ((None, "6.0", None), ("ge", None, None, 6)),
    ((None, None, "≥ 50"), ("ge", None, None, 50)), ((None, "≤ 0.2", None), ("le", None, None, 0.2)),
    ((None, None, "120 ± 30"), ("between", 90, 150, None)), (("0.01 Max.", "0.01", None), ("le", None, None, 0.01)),
    (("275-425", "275", "425"), ("between", 275, 425, None)), (("5", "9", "3"), ("between", 3, 9, None)),
]


def test_spec_of_item(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(CANDIDATES)], "i int, spec_raw string, spec_min string, spec_max string")
    for r in with_resolved_spec(df).collect():
        assert (r.spec.op, r.spec.min, r.spec.max, r.spec.value) == pytest.approx(CANDIDATES[r.i][1])


RESULTS = {
    "<15": (15, "lt"), "≤0.01": (0.01, "le"), "≦ 0.2": (0.2, "le"), ">50": (50, "gt"), "≥ 95": (95, "ge"), "388": (388, None),
    "White": None, "1.09": (1.09, None), "42 44": (43, None), "275-425": (-75, None), ".5": (5, None), "1,000": (1, None),
    '{"avg": 1.5, "raw": "1.50"}': (1.5, None), '{"min": 1, "max": 2}': (1.5, None), "{}": None, None: None,
}


def test_result_grammar(spark):
    df = spark.createDataFrame([(k,) for k in RESULTS], "result string")
    for r in with_result(df).collect():
        want = RESULTS[r.result]
        if want is None:
            assert r.res is None, r.result
        else:
            assert r.res.value == pytest.approx(want[0]), r.result
            assert (r.res.bound.op if r.res.bound else None) == want[1], r.result


VERDICTS = [
    ("≤15", "<15", "PASS"), ("15 Max.", "<15", "PASS"), ("≤10", "<15", "SKIP"), ("≥ 90", ">95", "PASS"), ("≥ 99", ">95", "SKIP"),
    ("10-20", "<15", "SKIP"), ("≥ 5", "<15", "SKIP"), ("275-425", "387", "PASS"), ("0-10", "11", "FAIL"), ("10-20", "9.99", "FAIL"),
    ("≤ 5", "5.01", "FAIL"), ("≥ 50", "49.9", "FAIL"), ("7 ± 3", "6.6", "PASS"), ("0-10", "10", "SKIP"), ("180", "180", "SKIP"),
    ("White", "White", "SKIP"), ("≥ 50", "White", "SKIP"),
]


def items(spark, rows):
    return spark.createDataFrame([(1, 1, i + 1, *r) for i, r in enumerate(rows)], ITEM)


def lines(spark, text):
    return spark.createDataFrame([(1, 1, i, s) for i, s in enumerate(text)], "doc_id long, page int, line_no long, line string")


def judged(spark, rows):
    """rows: (name, status, min, max, result, spec_raw, result_raw)"""
    full = [(1, 1, i + 1, n, st, lo, hi, v, sr, rr, "", False, None, None) for i, (n, st, lo, hi, v, sr, rr) in enumerate(rows)]
    return spark.createDataFrame(full, ROW)


def statuses(df):
    return [r.status for r in df.orderBy("item_seq").collect()]


def test_verdicts(spark):
    df = items(spark, [("X", None, None, s, None, None, r) for s, r, _ in VERDICTS])
    assert statuses(verdict.evaluate(df)) == [v for _, _, v in VERDICTS]


OIL = [
    "OLIVE OIL, BATCH REPORT", "Acidity (g/100g)  |  0.31  |  0.80 Max", "Peroxide value (meq/kg)  |  7.4  |  20.0 Max", "Colour  |  greenish",
    "Unsaponi", "fiable matter  |  1.1  |  1.5 Max",
]
METALS = ["Property  |  Iron  |  Copper  |  Wax", "Limit  |  3.0 Max  |  0.1 Max  |  350 Max", "Found  |  0.7  |  0.04  |  212"]


@pytest.mark.parametrize("text,item,kept", [
    # A word of the name is printed.
    (OIL, ("Acidity", None, None, "5 Max", None, None, "3"), True),
    # A long word of the name runs over a line break; a word that is nowhere does not help.
    (OIL, ("Unsaponifiable", None, None, "9 Max", None, None, "8"), True),
    (OIL, ("Tocopherol", None, None, "9 Max", None, None, "8"), False),
    # A foreign name, but result and limit on one line; then on two lines, then only one of them.
    (OIL, ("Wax esters", None, None, "20.0 Max", None, None, "7.4"), True),
    (OIL, ("Wax esters", None, None, "0.80 Max", None, None, "7.4"), False),
    (OIL, ("Wax esters", None, None, "0.55 Max", None, None, "7.4"), False),
    # One column of a block that names the item, and a block that does not.
    (METALS, ("Copper", None, None, "0.1 Max", None, None, "0.04"), True),
    (METALS, ("Zinc", None, None, "350 Max", None, None, "0.04"), False),
    ([], ("Zinc", None, None, "350 Max", None, None, "0.04"), True),
])
def test_grounding(spark, text, item, kept):
    good, dropped = guards.drop_ungrounded(items(spark, [item]), lines(spark, text), ID)
    assert (good.count() == 1) == kept and (dropped.count() == 0) == kept


def test_fail_guard(spark):
    text = [
        "Acidity (g/100g)  |  0.95  |  0.80 Max", "Density at 20 C  |  0.921  |  0.910 - 0.916", "Moisture  |  0.40", "Volatile part  |  0.20 Max",
        "pH  |  11  |  7 ± 3",
    ]
    cases = [
        (("Acidity", "FAIL", None, 0.8, 0.95, "0.80 Max", "0.95"), "FAIL"),
        (("Density", "FAIL", 0.910, 0.916, 0.921, "0.910 - 0.916", "0.921"), "FAIL"),
        (("Density", "FAIL", 0.910, 0.914, 0.921, "0.910 - 0.914", "0.921"), "SKIP"),  # one bound is not printed
        (("Moisture", "FAIL", None, 0.2, 0.4, "0.20 Max", "0.40"), "SKIP"),  # result and limit on different lines
        (("pH", "FAIL", 4.0, 10.0, 11.0, "7 ± 3", "11"), "SKIP"),  # the bounds of a tolerance are not printed
        (("Acidity", "PASS", None, 0.9, 0.31, "0.90 Max", "0.31"), "PASS"),  # not a FAIL
    ]
    assert statuses(guards.guard_fails(judged(spark, [r for r, _ in cases]), lines(spark, text), ID)) == [w for _, w in cases]


CEMENT = [
    "Setting time initial (min)  |  142  |  60 Min", "Setting time final (min)  |  215  |  600 Max", "Blaine fineness (m2/kg)  |  347  |  280 Min",
    "Chloride content (%)  |  0.02  |  0.10 Max",
]


@pytest.mark.parametrize("text,row,want", [
    (CEMENT, ("Blaine fineness", "PASS", 280.0, None, 347.0, "280 Min", "347"), "PASS"),
    # Two-sided limits need not be printed on the name line, a single bound must.
    (CEMENT, ("Blaine fineness", "PASS", 200.0, 400.0, 347.0, "200 - 400", "347"), "PASS"),
    (CEMENT, ("Chloride content", "PASS", None, 0.5, 0.02, "0.5 Max", "0.02"), "SKIP"),
    # The name line shows other data, and no line follows it.
    (CEMENT, ("Chloride content", "PASS", 280.0, None, 347.0, "280 Min", "347"), "SKIP"),
    # No line carries the name.
    (CEMENT, ("Ash residue", "PASS", None, 3.0, 99.0, "3 Max", "99"), "PASS"),
    # A line below confirms the result, but not beyond the next numbered item.
    (["4 | Compressive strength | MPa", "- after 28 days | 52.5 | 42.5 Min", "5 | Soundness | 1"],
     ("Compressive strength", "PASS", 42.5, None, 52.5, "42.5 Min", "52.5"), "PASS"),
    (["4 | Compressive strength | 48.0", "5 | Flexural strength | 7.1", "- after 28 days | 52.5 | 42.5 Min"],
     ("Compressive strength", "PASS", 42.5, None, 52.5, "42.5 Min", "52.5"), "SKIP"),
])
def test_pass_guard(spark, text, row, want):
    assert statuses(guards.guard_passes(judged(spark, [row]), lines(spark, text), ID)) == [want]


def test_column_shift(spark):
    text = ["0.425  |  10.0 - 45.0  |  36.0", "Moisture content  |  4. 0-8. 0  |  6. 2", "0.850  |  0.0 - 1.0  |  0.0"]
    rows = judged(spark, [
        ("Particle Size", "FAIL", 10.0, 45.0, 0.425, "10.0 - 45.0", "0.425"), ("Moisture content", "PASS", 4.0, 8.0, 6.2, "4.0-8.0", "6.2"),
        ("S", "PASS", 0.0, 1.0, 0.85, "0.0 - 1.0", "0.85"),
    ])
    assert statuses(guards.guard_column_shift(rows, lines(spark, text), ID)) == ["SKIP", "PASS", "SKIP"]


def test_sieve(spark):
    text = ["PARTICLE SIZE", "2.000  |  0.0  |  0.0", "0.850  |  0.0 - 1.0  |  0.0", "0.425  |  10.0 - 45.0  |  50.0", "0.150  |  50.0 - 80.0  |  60.0", "<0.150  |  0.0 - 12.0  |  4.0"]
    rows = judged(spark, [
        ("Particle Size", "SKIP", 0.0, 1.0, 0.85, "0.0 - 1.0", "0.850"), ("Particle Size", "SKIP", 10.0, 45.0, 0.425, "10.0 - 45.0", "0.425"),
        ("Particle Size", "SKIP", 50.0, 80.0, 0.15, "50.0 - 80.0", "0.150"), ("Particle Size", "SKIP", 0.0, 12.0, None, "0.0 - 12.0", "<0.150"),
    ])
    ln = lines(spark, text)
    assert statuses(sieve.recover_sieve(rows, ln, ID)) == ["PASS", "SKIP", "PASS", "PASS"]
    added = sieve.missing_sieve_rows(rows, ln).collect()
    assert [(r.spec_raw, r.result, r.status) for r in added] == [("0.0", 0.0, "SKIP")] and 0 < added[0].item_pos < 1


def test_average_and_spec_column(spark):
    text = ["  |  Quality Item  |    |    |  Average  |  Values", "Sieve 500  |    |    |    |  0.3  |  3 Max.", "Sieve 150ur%)  |  54  |  56  |  58  |  56.0  |  45 ~T5"]
    its = items(spark, [("Sieve 500", None, None, "3 Max.", None, None, "0.3"), ("Sieve 150ur%)", None, None, "45 ~T5", None, None, "58")])
    got = recover.recover_average(its, lines(spark, text), ID).orderBy("item_seq").collect()
    assert [(r.result, r.averaged) for r in got] == [("0.3", False), ("56.0", True)]
    text = ["Property | Batch | | Specification |", "Property | Min | Max | Min | Max", "Fiber Length | 0.990 | 1.180 | 0.920 | 1.420",
            "Fiber Lcngth | 0.995 | 1.170 | 0.920 | 1.420", "Percent Moisture | 6.1 | 7.2 | S.000 | 11.000"]
    its = items(spark, [("Fiber Length", None, None, "0.990~1.180", None, None, "1.09"), ("Percent Moisture", None, None, "6.1~7.2", None, None, "7")])
    got = recover.recover_spec_column(its, lines(spark, text), ID).orderBy("item_seq").collect()
    assert [(r.spec_raw, r.spec_column) for r in got] == [("0.920~1.420", True), ("6.1~7.2", True)]


def test_recoveries(spark):
    text = ["Fiber Length mm  |  1. 09  |  0.70 - 1.30", "Moisture Content  |  6.2  |  4.0 - 8.0", "Insoluble matter  |  0.001  |  0.01 Max"]
    ln = lines(spark, text)
    lost = items(spark, [("Fiber Length", None, None, None, None, None, "1.09"), ("Moisture Content", None, None, None, None, None, "6.2"), ("Insoluble matter", None, None, None, None, None, "0.001")])
    assert [r.spec_raw for r in recover.recover_specs(lost, ln, ID).orderBy("item_seq").collect()] == ["0.70 - 1.30", "4.0 - 8.0", "0.01 Max"]
    part = items(spark, [("Fiber Length mm", None, None, "0.70 - 1.30", None, None, None), ("Insoluble matter", None, None, None, "0.01", None, "0.001")])
    assert [r.result for r in recover.recover_results(part, ln, ID).orderBy("item_seq").collect()] == ["1.09", "0.001"]
    assert [r.spec_raw for r in recover.correct_spec_direction(part, ln, ID).orderBy("item_seq").collect()] == ["0.70 - 1.30", "0.01 Max."]
    hints = spark.createDataFrame([(1, 1, "insoluble matter", 0.01, "max")], "doc_id long, page int, name string, value double, direction string")
    assert [r.spec_raw for r in recover.apply_direction_hints(part, hints, ID).orderBy("item_seq").collect()] == ["0.70 - 1.30", "0.01 Max."]


def test_metadata_and_grid(spark):
    its = items(spark, [("Lot mumber 1", None, None, None, None, None, "5"), ("Praduction Date", None, None, "x", None, None, "1"), ("Item", None, None, "5 Max", None, None, "1"), ("Items tested", None, None, None, None, None, "1")])
    kept, dropped = cleaning.filter_metadata_rows(its)
    assert {r.name for r in kept.collect()} == {"Item", "Items tested"} and dropped.count() == 2
    text = ["Item | Method | Spec | Lot No. 850996", "Sieve Analysis | ISO 3310 | Max 1 | Traces", " | +100 | 92～100 | 97.20", " | -100/+200 | Max 5 | 0.30"]
    rows = grid.items_from_grid(lines(spark, text)).orderBy("line_no").collect()
    assert [(r.name, r.spec_raw, r.spec_max, r.result) for r in rows] == [
        ("Sieve Analysis", None, 1.0, "Traces"), ("Sieve Analysis +100", "92~100", None, "97.20"), ("Sieve Analysis -100/+200", None, 5.0, "0.30")]
    assert grid.header_row(grid.grid_cells(lines(spark, text))).first().lot_no == "850996"


def test_row_order_and_partitions_do_not_matter(spark):
    from specgate import fixtures as fx
    from specgate.operators.layout import cluster_rows

    t = fx.tokens(spark, "/root/testdata/sf0.001")
    a = cluster_rows(t).select("doc_id", "page", "token_seq", "row_no")
    b = cluster_rows(t.repartition(13).orderBy(F.rand(7))).select("doc_id", "page", "token_seq", "row_no")
    assert a.exceptAll(b).count() == 0


def test_scans_over_band_borders(spark):
    """A group cut into many bands gives the same numbers as one plain pass."""
    from specgate.scan import fill_forward, islands, number_rows

    values = [float((i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame([("g", i, v, str(i) if i % 40 == 0 else None) for i, v in enumerate(values)], "k string, seq long, v double, s string")
    got = {r.seq: r.n for r in islands(df, ["k"], "v", ["seq"], 1.0, "n", 5.0).collect()}
    order = sorted(range(300), key=lambda i: (values[i], i))
    want, n = {}, -1
    for p, i in enumerate(order):
        n += p == 0 or values[i] - values[order[p - 1]] > 1.0
        want[i] = n
    assert got == want
    filled = {r.seq: r.f for r in fill_forward(df, ["k"], "seq", {"f": "s"}, 16).collect()}
    assert all(filled[i] == str(i // 40 * 40) for i in range(300))
    pos = {r.seq: r.p for r in number_rows(df, ["k"], F.floor(F.col("seq") / 7), ["seq"], "p").collect()}
    assert pos == {i: i + 1 for i in range(300)}


def test_distinct_texts_are_parsed_once(spark, monkeypatch):
    """Joined back by broadcast, without a shuffle of the rows, as in place; nulls and spaces are texts of their own."""
    from specgate.functions import binding

    texts = [None, "", " 5 ", "5", "<3", "1 2", '{"avg": 2}', "White"]
    rows = [(i, texts[i % 8], texts[i // 8 % 8], texts[i // 64 % 8], texts[i // 3 % 8]) for i in range(512)]
    df = spark.createDataFrame(rows, "id long, spec_raw string, spec_min string, spec_max string, result string").selectExpr(
        "*", "'n' AS name", "'u' AS unit", "CAST(NULL AS STRING) AS method")
    once = verdict.evaluate(df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    monkeypatch.setattr(binding, "DISTINCT", 0)
    in_place = verdict.evaluate(df)
    assert once.columns == in_place.columns and sorted(map(str, once.collect())) == sorted(map(str, in_place.collect()))


def test_header_lines_need_no_classified_cells(spark):
    """Header alignment reads the cells only; the patterns of the cell roles are not searched for it."""
    rows = grid.raw_rows(lines(spark, ["Item | Min | Max | Result", "Ash | 1 | 2 | 1.5", "Fat | 3 | 4 | 3.5"]))
    found = grid.detect_limit_header(grid.align_header(rows))
    assert "ASTM" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.select("name_at", "lower_at", "upper_at", "result_at").collect() == [(0, 1, 2, 3)]


def test_classified_cells(spark):
    cells = ["", "7 ± 3", "Max. 5", "5 MIN", "≤ 4", ">= 2,5", "< 3 %", "+100", "-100/+200", "min", "(mm)", "(7 - 9)", "ISO 3310", "12"]
    rows = grid.grid_cells(lines(spark, [" | ".join(cells)])).selectExpr("inline(cells)").collect()
    got = {r["c"]: (r["spec_raw"], r["spec_min"], r["spec_max"], r["bare"], r["mesh"], r["method"], r["unit"]) for r in rows}
    no = (False, False, False, False)
    assert got == {
        "": (None, None, None, *no), "7 ± 3": ("7 ± 3", None, None, *no), "Max. 5": (None, None, 5.0, *no), "5 MIN": (None, 5.0, None, *no),
        "≤ 4": (None, None, 4.0, True, False, False, False), ">= 2,5": (None, 2.5, None, *no), "< 3 %": (None, None, None, True, False, False, False),
        "+100": (None, None, None, False, True, False, False), "-100/+200": (None, None, None, False, True, False, False),
        "min": (None, None, None, *no), "(mm)": (None, None, None, False, False, False, True), "(7 - 9)": (None, None, None, False, False, False, True),
        "ISO 3310": (None, None, None, False, False, True, False), "12": (None, None, None, True, False, False, False)}


def test_cells_are_read_once_for_column_roles(spark):
    """One step of the plan classifies cells; headers are found the same way by a join and by a window."""
    text = ["Item | Method | Spec | Result", "Ash | ISO 1 | ≤ 5 | 3", "Fat |  | Max 7 | 4", "Fibre |  | 1 - 9 |  "]
    pages = lines(spark, text).unionByName(lines(spark, text[1:]).withColumn("doc_id", F.lit(8).cast("long")))
    rows = grid.raw_rows(pages)
    data = grid.data_rows(rows, large=False)
    key = ["doc_id", "page", "line_no", "raw"]
    assert sorted(data.select(key).collect()) == sorted(grid.data_rows(rows).select(key).collect()) and data.count() == 6
    plan = grid.column_roles(grid.raw_rows(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("spec_raw, lambda") + plan.count("ASTM") <= 1
    got = {r.doc_id: (r.result_col, r.spec_col, r.direction) for r in grid.column_roles(data).collect()}
    assert len(got) == 2 and set(got.values()) == {(3, 2, "upper")}


def test_written_grid_rows_are_counted(spark, monkeypatch):
    """Header bands are carried down without computing the joined rows once more to count them; only cells that are a number make a row."""
    from specgate import scan

    def joined(*_):
        raise AssertionError("counted again")

    monkeypatch.setattr(scan, "oversized", joined)
    text = ["Property | Batch | | Specification |", "Property | Min | Max | Min | Max", "Fiber Length | < 0.99 % | 1.180 | 0.920 | 1.420",
            "Fiber Lcngth | 0.995 | 1.170 | 0.920 | 1.420", "Fiber Length | n/a | - | x | y"]
    its = items(spark, [("Fiber Length", None, None, "0.990~1.180", None, None, "1.09")])
    got = recover.recover_spec_column(its, lines(spark, text), ID).collect()
    assert [(r.spec_raw, r.spec_column) for r in got] == [("0.920~1.420", True)]
