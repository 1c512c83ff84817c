"""Limit notations to {op, min, max, value, raw}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgate.functions.binding import attach, per_distinct
from specgate.functions.numbers import NUM, to_num, token_value
from specgate.functions.text import (
    WS, is_blank, repair_ocr_digits, strip_judgement, strip_units, trim_ws,
)

# The printed shapes of a limit.
_DASHES = rf"(?:[~\-–—]{WS}*)+"
_TWO_NUMBERS = rf"^({NUM}){WS}*(±|\+/-|\+-|{_DASHES}){WS}*({NUM})$"
_TWO_SIDES = rf"^(.+?){WS}*{_DASHES}(.+?)$"
_ONE_NUMBER = rf"^(≤|≦|<=|≥|≧|>=|<|>)?{WS}*({NUM}){WS}*((?i:max|min)\.?)?$"
SPEC_TYPE = "struct<op:string,min:double,max:double,value:double,raw:string>"


def clean_spec(raw: Column) -> Column:
    """Text of the limit without a trailing judgement."""
    return trim_ws(strip_judgement(F.translate(trim_ws(raw), "～〜∼", "~~~")))


def _between(a: Column, b: Column, raw: Column) -> Column:
    return F.struct(
        F.lit("between").alias("op"), a.alias("min"), b.alias("max"),
        F.lit(None).cast("double").alias("value"), raw.alias("raw"),
    )


def _bound(op: Column, value: Column, raw: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(op.alias("op"), none.alias("min"), none.alias("max"), value.alias("value"), raw.alias("raw"))


def _two_numbers(bare: Column, clean: Column) -> Column:
    a, b = (token_value(F.regexp_extract(bare, _TWO_NUMBERS, g)) for g in (1, 3))
    tolerance = F.regexp_extract(bare, _TWO_NUMBERS, 2).isin("±", "+/-", "+-")
    return F.when(tolerance, _between(a - b, a + b, clean)).otherwise(_between(F.least(a, b), F.greatest(a, b), clean))


def _one_number(bare: Column, clean: Column) -> Column:
    sign, word = F.regexp_extract(bare, _ONE_NUMBER, 1), F.lower(F.regexp_extract(bare, _ONE_NUMBER, 3))
    mark = F.concat(sign, F.substring(word, 1, 3))
    op = (
        F.when(mark == "", "eq").when(mark.isin("≤", "≦", "<=", "max"), "le").when(mark.isin("≥", "≧", ">=", "min"), "ge")
        .when(mark == "<", "lt").when(mark == ">", "gt")
    )
    value = token_value(F.regexp_extract(bare, _ONE_NUMBER, 2))
    # A sign together with a word is no known notation.
    return F.when(~mark.rlike("[≤≦≥≧<>=]m"), _bound(op, value, clean))


def _mended(bare: Column, clean: Column) -> Column:
    """Letters are read as digits only where both sides of a range hold a real digit."""
    left, right = F.regexp_extract(bare, _TWO_SIDES, 1), F.regexp_extract(bare, _TWO_SIDES, 2)
    a, b = to_num(repair_ocr_digits(trim_ws(left))), to_num(repair_ocr_digits(trim_ws(right)))
    return F.when(
        left.rlike(r"\d") & right.rlike(r"\d") & a.isNotNull() & b.isNotNull(),
        _between(F.least(a, b), F.greatest(a, b), clean),
    )


def _build(bare: Column, clean: Column) -> Column:
    """The three shapes exclude each other; groups are extracted only after a match."""
    return (
        F.when(bare.rlike(_TWO_NUMBERS), _two_numbers(bare, clean))
        .when(bare.rlike(_ONE_NUMBER), _one_number(bare, clean))
        .when(bare.rlike(r"\d.*[~\-–—].*\d"), _mended(bare, clean))
    )


def with_parsed(df: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """Add {output: parsed limit of the input column}; null where it is no numeric limit.

    Parsing is in place, in a narrow stage. Each step is attached, so every
    regular expression runs once per row and no generated method grows too large.
    """
    def step(fn):
        return {f"__{k}_{o}": v for o in inputs for k, v in fn(o).items()}

    def c(kind: str, o: str) -> Column:
        return F.col(f"__{kind}_{o}")

    df = attach(df, **step(lambda o: {"clean": clean_spec(F.col(inputs[o]))}))
    df = attach(df, **step(lambda o: {"bare": strip_units(c("clean", o))}))
    df = attach(df, **{o: _build(c("bare", o), c("clean", o)) for o in inputs})
    return df.drop(*[f"__{k}_{o}" for o in inputs for k in ("clean", "bare")])


def with_resolved_spec(df: DataFrame, out: str = "spec") -> DataFrame:
    """Pick the limit of an item from spec_raw, spec_min and spec_max.

    A printed direction wins; two valued columns make a range; a bare number in
    one column takes the direction of that column. Each distinct triple is parsed once.
    """
    return per_distinct(df, ["spec_raw", "spec_min", "spec_max"], out, lambda d: _resolved(d, out))


def _resolved(df: DataFrame, out: str) -> DataFrame:
    df = with_parsed(df, {"__raw": "spec_raw", "__lo": "spec_min", "__hi": "spec_max"})
    raw, lo, hi = F.col("__raw"), F.col("__lo"), F.col("__hi")
    has_lo, has_hi = ~is_blank(F.col("spec_min")), ~is_blank(F.col("spec_max"))
    both = F.concat_ws("~", "spec_min", "spec_max")

    def one_sided(side: Column, op: str, printed: str) -> Column:
        return F.when(side["op"] == "eq", _bound(F.lit(op), side["value"], F.col(printed))).otherwise(side)

    picked = (
        F.when(raw["op"] != "eq", raw)
        .when(
            has_lo & has_hi & lo["value"].isNotNull() & hi["value"].isNotNull(),
            _between(F.least(lo["value"], hi["value"]), F.greatest(lo["value"], hi["value"]), both),
        )
        .when(has_lo & ~has_hi & lo["op"].isNotNull(), one_sided(lo, "ge", "spec_min"))
        .when(has_hi & ~has_lo & hi["op"].isNotNull(), one_sided(hi, "le", "spec_max"))
        .otherwise(raw)
    )
    return attach(df, **{out: picked}).drop("__raw", "__lo", "__hi")


def spec_display(spec_raw: Column, lo: Column, hi: Column) -> Column:
    from specgate.functions.numbers import number_text

    return F.coalesce(
        F.when(spec_raw != "", spec_raw),
        F.concat(number_text(lo), F.lit("~"), number_text(hi)),
        F.concat(F.lit("<="), number_text(hi)),
        F.concat(F.lit(">="), number_text(lo)),
        F.lit("-"),
    )
