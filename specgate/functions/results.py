"""Result notations to {value, source, values, raw, bound}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgate.functions.binding import attach, per_distinct
from specgate.functions.numbers import NUM, number_text, number_values, token_value
from specgate.functions.text import WS, trim_ws

# Fixed value: a result that is only a bound.
_BOUND = rf"^(<=|≤|≦|<|>=|≥|≧|>){WS}*({NUM})$"
_OBJECT = "avg double, min double, max double, stdev double, raw string"


def _parsed(value: Column, source: str, values: Column | None, raw: Column, op: Column | None = None) -> Column:
    bound_type = "struct<op:string,value:double>"
    bound = F.lit(None).cast(bound_type) if op is None else F.struct(op.alias("op"), value.alias("value"))
    none = F.lit(None).cast("array<double>")
    return F.struct(
        value.alias("value"), F.lit(source).alias("source"), (none if values is None else values).alias("values"),
        raw.alias("raw"), bound.alias("bound"),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def with_result(df: DataFrame, out: str = "res", result: str = "result") -> DataFrame:
    """Numbers, bounds, several readings (averaged) and {avg,min,max,raw} objects; text gives null. Each distinct
    text is parsed once."""
    return per_distinct(df, [result], out, lambda d: _with_result(d, out, result))


def _with_result(df: DataFrame, out: str, result: str) -> DataFrame:
    df = attach(df, __t=trim_ws(F.col(result)))
    t, o, p = F.col("__t"), F.col("__o"), F.col("__p")
    df = attach(
        df,
        __o=F.when(t.startswith("{"), F.from_json(t, _OBJECT)),
        __p=F.struct(
            F.regexp_extract(t, _BOUND, 1).alias("sign"),
            token_value(F.regexp_extract(t, _BOUND, 2)).alias("limit"),
            F.when(t.rlike(r"^[\-+.\d]"), number_values(t)).alias("readings"),
        ),
    )
    sign = p["sign"]
    op = F.when(sign == "<", "lt").when(sign.isin("<=", "≤", "≦"), "le").when(sign == ">", "gt").otherwise("ge")
    n = p["readings"]
    parts = F.filter(F.array(o["avg"], o["min"], o["max"]), lambda x: x.isNotNull())
    listed = F.array_join(F.transform(parts, number_text), ",")
    parsed = (
        F.when(o["avg"].isNotNull(), _parsed(o["avg"], "avg", None, F.coalesce(o["raw"], number_text(o["avg"]))))
        .when(o.isNotNull() & (F.size(parts) > 0),
              _parsed(_mean(parts), "all_values", parts, F.coalesce(o["raw"], listed)))
        .when(p["limit"].isNotNull(), _parsed(p["limit"], "single", None, t, op))
        .when(F.size(n) == 1, _parsed(n[0], "single", None, t))
        .when(F.size(n) > 1, _parsed(_mean(n), "all_values", n, t))
    )
    return attach(df, **{out: parsed}).drop("__t", "__o", "__p")
