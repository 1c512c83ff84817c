"""Computing an expensive value once per row, or once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgate.session import materialize

#: Distinct texts whose values are sent to every task, at most; with more, each row is computed in place.
DISTINCT = 50_000


def attach(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns so that later filters and projections never recompute them.

    The optimizer copies a projected expression into every filter above it and
    fuses all projections of a stage into one generated method; with dozens of
    regular expressions that method is too large for the JIT compiler, which was
    measured to be ten times slower. A generator over a one-row array is a
    boundary for both: each row is computed once, by small compiled methods.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.transform(F.array(one), lambda row: row)))


def per_distinct(df: DataFrame, inputs: list[str], out: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`compute` adds `out` from the columns `inputs`; it runs once for each distinct combination of them.

    Printed limits and results repeat. Their distinct texts are written first, so their number is known: up to `DISTINCT`
    are joined back to the rows by broadcast, which moves no row and knows no skew. With more, or on a stream, every row is
    computed in place. `df` is read twice: pass a table that is cheap to read.
    """
    if df.isStreaming:
        return compute(df)
    distinct = materialize(df.select(*inputs).distinct())
    if distinct.count() > DISTINCT:
        return compute(df)
    keys = [f"__key{i}" for i in range(len(inputs))]
    table = compute(distinct).select(*[F.col(c).alias(k) for c, k in zip(inputs, keys)], out)
    same = F.lit(True)
    for c, k in zip(inputs, keys):
        same = same & df[c].eqNullSafe(F.col(k))
    return df.join(F.broadcast(table), same, "left").drop(*keys)
