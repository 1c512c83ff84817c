"""The whole chain over many pages: clean, recover, judge, guard, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate import fixtures as fx
from specgate.operators import cleaning as C
from specgate.operators import guards as G
from specgate.operators import recover as R
from specgate.operators import reports as O
from specgate.operators import sieve as S
from specgate.operators import verdict as V
from specgate.session import materialize


def recover_items(
    items: DataFrame, lines: DataFrame, row_id: list[str], grid: DataFrame | None = None, hints: DataFrame | None = None
) -> DataFrame:
    """Grounding, metadata filter and the recoveries in their fixed order."""
    kept, _ = G.drop_ungrounded(items, lines, row_id)
    kept, _ = C.filter_metadata_rows(kept)
    found = materialize(R.recover_specs(materialize(kept), lines, row_id))
    found = R.recover_results(found, lines, row_id)
    found = R.recover_average(found, grid, row_id) if grid is not None else found.withColumn("averaged", F.lit(False))
    found = R.correct_spec_direction(materialize(found), lines, row_id)
    if hints is not None:
        found = R.apply_direction_hints(materialize(found), hints, row_id)
    if grid is None:
        return found.withColumn("spec_column", F.lit(False))
    return R.recover_spec_column(materialize(found), grid, row_id)


def certify(
    items: DataFrame, lines: DataFrame, row_id: list[str], grid: DataFrame | None = None, hints: DataFrame | None = None
) -> DataFrame:
    """Audited verdicts of one reading. Shared intermediate results are written once."""
    rows = materialize(V.evaluate(materialize(recover_items(items, lines, row_id, grid, hints))))
    rows = G.guard_outliers(G.guard_fails(rows, lines, row_id))
    rows = materialize(G.guard_passes(materialize(rows), lines, row_id))
    rows = materialize(G.guard_column_shift(rows, lines, row_id))
    rows = S.recover_sieve(rows, lines, row_id)
    near = O.near_boundary(F.col("min"), F.col("max"), F.col("result"))
    flag = (
        (F.col("recovered") & (F.col("status") != "SKIP") & near)
        | (F.col("averaged") & (F.col("status") == "PASS") & near) | (F.col("spec_column") & (F.col("status") == "PASS"))
    )
    return rows.withColumn("needs_review", F.col("needs_review") | F.coalesce(flag, F.lit(False)))


def certify_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per page after the whole chain over all items."""
    items = fx.items(spark, sf)
    rows = certify(items, materialize(fx.lines_of_items(items)), fx.ITEM)
    return O.summarize(rows, fx.PAGE)


QUERIES = {"certify_pages": certify_pages}
