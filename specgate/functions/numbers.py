"""Reading and writing numbers found in printed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specgate.functions.text import WS, drop_ws, normalize_glyphs, trim_ws

# Fixed value: one printed number; comma or dot is its only separator.
NUM = r"-?\d+(?:[.,]\d+)?"
_PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
LONE_NUMBER = rf"^[<>≤≦≥≧]?\s*{NUM}\s*%?$"


def token_value(tok: Column) -> Column:
    """Value of a string that matches NUM; null for an empty one (a failed parse would be slow)."""
    return F.when(tok != "", F.translate(tok, ",", ".").try_cast("double"))


def to_num(c: Column) -> Column:
    """Comma is the decimal sign unless a dot is present, then it is dropped."""
    t = trim_ws(c)
    plain = F.when(t.contains("."), F.translate(t, ",", "")).otherwise(F.translate(t, ",", "."))
    return F.regexp_extract(plain, _PLAIN_NUMBER, 0).try_cast("double")


def lone_value(c: Column) -> Column:
    """Value of a measured cell such as '< 0.5 %'; null when the cell holds anything else."""
    s = normalize_glyphs(c)
    core = F.regexp_replace(F.regexp_replace(s, r"^[<>≤≦≥≧]\s*", ""), r"\s*%$", "")
    return F.when(s.rlike(LONE_NUMBER), token_value(trim_ws(core)))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d]", "")


def number_strings(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(NUM), F.lit(0)), F.array().cast("array<string>"))


def join_split_decimals(c: Column) -> Column:
    """'1. 09' is one number that the OCR engine split."""
    return F.regexp_replace(c, rf"(\d)\.{WS}+(\d)", "$1.$2")


def number_tokens(strings: Column) -> Column:
    return F.transform(
        strings, lambda t: F.struct(token_value(t).alias("val"), digits_only(t).alias("digits"))
    )


def line_numbers(line: Column) -> Column:
    return number_tokens(number_strings(join_split_decimals(line)))


def number_values(c: Column) -> Column:
    return F.transform(number_strings(c), token_value)


def single_number(cell: Column) -> Column:
    """Value of a cell that is one number and nothing else ('1. 09' counts as 1.09)."""
    t = drop_ws(cell)
    return F.when(t.rlike(r"^[-+]?\d+(?:[.,]\d+)?$"), token_value(t))


def cell_numbers(cell: Column) -> Column:
    """All numbers of a cell; a dash between two numbers separates them."""
    t = join_split_decimals(cell)
    t = F.regexp_replace(t, "[~–—〜～∼±]", " ")
    t = F.regexp_replace(t, rf"(\d){WS}*-{WS}*(\d)", "$1 $2")
    return number_values(t)


def aperture(cell: Column) -> Column:
    """Sieve opening: a plain number or a bound such as '<0.150'."""
    t = drop_ws(cell)
    bound = F.regexp_extract(t, rf"^[<>≤≥≦≧]=?({NUM})$", 1)
    return F.coalesce(single_number(t), F.when(bound != "", token_value(bound)))


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(1e-9)


def number_text(d: Column) -> Column:
    """Shortest plain notation: 24 rather than 24.0, 0.0003 rather than 3.0E-4."""
    s = d.cast("string")
    plain = F.regexp_replace(d.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string"))
        .when(s.contains("E") & plain.isNotNull(), plain)
        .otherwise(s)
    )


def number_display(d: Column, missing: str = "—") -> Column:
    """Integers as they are, otherwise at most three decimals without trailing zeros."""
    fixed = F.regexp_replace(F.format_string("%.3f", d), r"\.?0+$", "")
    return (
        F.when(d.isNull(), F.lit(missing))
        .when(d == F.floor(d), d.cast("bigint").cast("string"))
        .otherwise(fixed)
    )
