"""Ordered scans over a group without sending the group to one task.

A plain window per group sorts the whole group in one task, so one oversized
group decides the run time. Where a group has more than `BAND_ROWS` rows, the
ordering column is cut into bands: the scan runs per (group, band), the bands
are summarised to one row each, the summaries are scanned per group, and the
band results are joined back on (group, band). The second scan sees one row per
band only. Where no group is that large, bands would only add shuffles, and one
window per group does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgate.session import materialize


def _attach(df: DataFrame, per_band: DataFrame, on: list[str], drop: list[str]) -> DataFrame:
    return df.join(per_band, on, "left").drop(*drop)


#: Rows of a group that one band of `quantile_bands` holds, about; cuts of one group at most.
BAND_ROWS, CUTS = 16_384, 1024


def oversized(df: DataFrame, keys: list[str]) -> bool:
    """Whether a group has more rows than one task should scan in order; one count per group."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BAND_ROWS).isEmpty()


def quantile_bands(df: DataFrame, keys: list[str], order: str, out: str, rows: int | None = None) -> DataFrame:
    """Adds the band of every row: groups of more than `rows` rows are cut at quantiles of their own values of `order`, so
    bands are about equally full whatever the values are. Equal values share a band, and bands follow the order."""
    rows = rows or BAND_ROWS
    marks = [i / 64 for i in range(1, 64)]
    per_group = df.groupBy(*keys).agg(F.count(order).alias("__n"), F.percentile_approx(order, marks, 4096).alias("__q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(64) * rows / F.col("__n"))).cast("int")
    cuts = F.filter(F.array_distinct("__q"), lambda q: q.isNotNull())
    cuts = F.when(F.col("__n") > rows, F.filter(cuts, lambda _, i: (i + 1) % F.col("__step") == 0)).otherwise(F.array().cast("array<double>"))
    per_group = per_group.withColumn("__step", step).select(*keys, cuts.alias("__cuts"))
    banded = df.join(per_group, keys)
    return banded.withColumn(out, F.size(F.filter("__cuts", lambda c: c <= F.col(order).cast("double")))).drop("__cuts")


def number_rows(df: DataFrame, keys: list[str], band: Column, order: list[str], out: str) -> DataFrame:
    """1-based position inside the group, ordered by band and then by `order`."""
    banded = df.withColumn("__b", band)
    if not oversized(df, keys):
        return banded.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("__b", *order)).cast("long")).drop("__b")
    local = Window.partitionBy(*keys, "__b").orderBy(*order)
    banded = banded.withColumn("__i", F.row_number().over(local))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        banded.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    joined = _attach(banded, offsets, [*keys, "__b"], [])
    return joined.withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__i", "__o")


def running_sum(df: DataFrame, keys: list[str], band: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one inside the group, ordered by band and then by `order`."""
    banded = df.withColumns({"__b": band, "__v": value})
    if not oversized(df, keys):
        whole = Window.partitionBy(*keys).orderBy("__b", *order).rowsBetween(Window.unboundedPreceding, -1)
        return banded.withColumn(out, F.coalesce(F.sum("__v").over(whole), F.lit(0))).drop("__b", "__v")
    local = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = banded.groupBy(*keys, "__b").agg(F.sum("__v").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    banded = banded.withColumn("__i", F.coalesce(F.sum("__v").over(local), F.lit(0)))
    return _attach(banded, offsets, [*keys, "__b"], []).withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__v", "__i", "__o")


def islands(
    df: DataFrame, keys: list[str], value: str, seq: list[str], gap: str | float, out: str, band_width: float | None = None,
    order: str | None = None, large: bool | None = None,
) -> DataFrame:
    """0-based island number of `value` inside the group, scanned by `order` (the value itself by default).

    A new island starts where the step from the previous value exceeds `gap`, a
    number or a column that is constant per group. Bands of the order column are
    `band_width` wide, or cut at the group's own quantiles, so a group of any size
    is scanned by many tasks. `large` says whether a group is oversized where the
    caller has counted already; else `df` is computed once more to count.
    """
    order = order or value
    limit = F.col(gap) if isinstance(gap, str) else F.lit(float(gap))
    if not (oversized(df, keys) if large is None else large):
        whole = Window.partitionBy(*keys).orderBy(order, *seq)
        apart = F.when(F.abs(F.col(value) - F.lag(value).over(whole)) <= limit, 0).otherwise(1)
        started = df.withColumn("__new", apart)
        number = F.sum("__new").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1
        return started.withColumn(out, number).drop("__new")
    banded = df.withColumn("__b", F.floor(F.col(order) / band_width)) if band_width else quantile_bands(df, keys, order, "__b")
    local = Window.partitionBy(*keys, "__b").orderBy(order, *seq)
    step = F.abs(F.col(value) - F.lag(value).over(local))
    banded = banded.withColumn("__new", F.when(step <= limit, 0).otherwise(1))
    banded = banded.withColumn("__i", F.sum("__new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*keys).orderBy("__b")
    at = F.struct(order, *seq)
    per_band = banded.groupBy(*keys, "__b").agg(
        F.min_by(value, at).alias("__lo"), F.max_by(value, at).alias("__hi"),
        F.max("__i").alias("__n"), F.first(limit).alias("__g"),
    )
    touching = F.abs(F.col("__lo") - F.lag("__hi").over(across)) <= F.col("__g")
    per_band = per_band.withColumn("__joined", F.when(touching, 1).otherwise(0))
    before = F.sum(F.col("__n") - F.col("__joined")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    per_band = per_band.withColumn("__o", F.coalesce(before, F.lit(0)) - F.col("__joined")).select(*keys, "__b", "__o")
    joined = _attach(banded, per_band, [*keys, "__b"], [])
    return joined.withColumn(out, F.col("__i") + F.col("__o") - 1).drop("__b", "__new", "__i", "__o")


def fill_forward(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], band_size: int = 4096, large: bool | None = None
) -> DataFrame:
    """{output: input}: last non-null input at or before the row; `order` is a whole number, `large` as in `islands`."""
    if not (oversized(df, keys) if large is None else large):
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: F.last(c, ignorenulls=True).over(whole) for o, c in cols.items()})
    banded = df.withColumn("__b", F.floor(F.col(order) / band_size))
    local = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    banded = banded.withColumns(
        {f"__l_{o}": F.last(c, ignorenulls=True).over(local) for o, c in cols.items()}
    )
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = banded.groupBy(*keys, "__b").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__x_{o}") for o, c in cols.items()]
    )
    carried = carried.withColumns(
        {f"__p_{o}": F.last(f"__x_{o}", ignorenulls=True).over(before) for o in cols}
    ).drop(*[f"__x_{o}" for o in cols])
    joined = _attach(banded, carried, [*keys, "__b"], [])
    joined = joined.withColumns({o: F.coalesce(f"__l_{o}", f"__p_{o}") for o in cols})
    return joined.drop("__b", *[f"__l_{o}" for o in cols], *[f"__p_{o}" for o in cols])


#: Bins of a histogram.
BINS = 1024


def upper_median(df: DataFrame, keys: list[str], value: str, out: str, default: float, large: bool | None = None) -> DataFrame:
    """Element floor(n/2) of the sorted positive values per group.

    Without an oversized group (`large`, counted if not given) it is the discrete median from above, a window per group that
    shares its shuffle with the scans that follow. Else values are counted; where a group has more than `BAND_ROWS` distinct
    ones, selection is by histograms: counts per distinct value combine before the shuffle; they are counted into `BINS` bins over the
    group's range, a scan over the bins finds the one that holds the rank, and that bin is counted into bins again. Only the
    values of the last bin are scanned in order, so no large group is sorted as a whole.
    """
    if not (oversized(df, keys) if large is None else large):
        positive = f"CASE WHEN `{value}` > 0 THEN CAST(`{value}` AS DOUBLE) END"
        group = ", ".join(f"`{k}`" for k in keys)
        median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {positive} DESC) OVER (PARTITION BY {group})")
        return df.withColumn(out, F.coalesce(median, F.lit(float(default))))
    counts = df.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    left = materialize(counts)  # read by every pass
    ordered = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    if not oversized(left, keys):
        before = F.coalesce(F.sum("__n").over(ordered.orderBy("__v")), F.lit(0))
        inside = F.floor(F.sum("__n").over(Window.partitionBy(*keys)) / 2) - before
        medians = left.withColumn("__in", inside).where((F.col("__in") >= 0) & (F.col("__in") < F.col("__n"))).select(*keys, F.col("__v").alias(out))
        return df.join(medians, keys, "left").withColumn(out, F.coalesce(out, F.lit(float(default))))
    picked = left.groupBy(*keys).agg(F.floor(F.sum("__n") / 2).alias("__rank"))

    def holding(parts: DataFrame, by: str) -> DataFrame:
        """Of each group the part that holds its rank, and the rank inside that part."""
        before = F.coalesce(F.sum("__n").over(ordered.orderBy(by)), F.lit(0))
        inside = F.col("__rank") - before
        return parts.withColumn("__in", inside).where((F.col("__in") >= 0) & (F.col("__in") < F.col("__n")))

    for _ in range(2):
        ends = left.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        share = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        binned = left.join(ends, keys).withColumn("__bin", F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(BINS - 1), F.floor(share * BINS))).otherwise(0))
        bins = binned.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n")).join(picked, keys)
        chosen = holding(bins, "__bin").select(*keys, "__bin", F.col("__in").alias("__rank"))
        left = binned.join(chosen.drop("__rank"), [*keys, "__bin"], "left_semi").select(*keys, "__v", "__n")
        picked = chosen.drop("__bin")
    medians = holding(left.join(picked, keys), "__v").select(*keys, F.col("__v").alias(out))
    return df.join(medians, keys, "left").withColumn(out, F.coalesce(out, F.lit(float(default))))
