"""Text clean-up, name signatures and cell splitting (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, the glyph replacements,
# the judgement words cut from the end of a limit and the unit spellings.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
WIDE_GLYPHS, PLAIN_GLYPHS = "＋～〜∼％＜＞", "+~~~%<>"
JUDGEMENT_WORDS = "success(?:ful)?|pass(?:ed)?|accept(?:ed|able)?|good|ok|qualified|conform(?:ed|ing)?"
UNIT_WORDS = r"g/cm3?|kg/cm2?|g/10\s*min|g/l|m2/g|[\u03BC\u00B5\u039C]m|um|mm|ppm|cm|kg|wt|sec|min(?!\.)|\(m/m\)"

_JUDGEMENT_TAIL = (
    rf"(?i){WS}*(?<![A-Za-z0-9_])(?:{JUDGEMENT_WORDS})(?![A-Za-z0-9_])(?:{WS}|\.)*$"
)


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def _translate(c: Column, chars: str, to: str) -> Column:
    """`chars` other than a space are beyond printable ASCII; translating looks up every character, so plain texts are left alone."""
    return F.when(c.rlike("[^ -~]"), F.translate(c, chars, to)).otherwise(c)


def squeeze_ws(c: Column) -> Column:
    """The class `WS` is slow to search; its characters are translated to spaces first."""
    return F.trim(F.regexp_replace(_translate(c, WS_CHARS, " " * len(WS_CHARS)), " {2,}", " "))


def drop_ws(c: Column) -> Column:
    return F.when(c.rlike("[^!-~]"), F.translate(c, WS_CHARS, "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


def blank_to_null(c: Column) -> Column:
    t = trim_ws(c)
    return F.when(t != "", t)


def normalize_glyphs(c: Column) -> Column:
    """Full-width signs and tildes to ASCII, white space squeezed, null to ''."""
    text = F.coalesce(c, F.lit(""))
    plain = _translate(text, WIDE_GLYPHS + WS_CHARS, PLAIN_GLYPHS + " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def strip_judgement(c: Column) -> Column:
    ends_in_word = c.rlike(rf"[A-Za-z.](?:{WS})*$")
    return F.when(ends_in_word, F.regexp_replace(c, _JUDGEMENT_TAIL, "")).otherwise(c)


def strip_units(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, rf"{WS}+", " "), "[%℃°]", "")
    stripped = trim_ws(F.regexp_replace(bare, f"(?i){UNIT_WORDS}", ""))
    return F.when(c.rlike(r"[A-Za-z%℃°\u03BC\u00B5\u039C\s]"), stripped).otherwise(c)


def repair_ocr_digits(c: Column) -> Column:
    """Letters an OCR engine confuses with digits; use only where digits are certain."""
    return F.translate(c, "OoQDIl|ZSGTBg", "0000111256789")


def _words(c: Column, keep: str) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{keep}]+", " "), " ")


def name_tokens(c: Column) -> Column:
    """Latin/Thai words of three letters or more."""
    return F.filter(_words(c, r"a-z\u0E00-\u0E7F"), lambda t: F.length(t) >= 3)


def signature(c: Column) -> Column:
    """Alphanumeric words: two characters or more, or anything with a digit."""
    return F.filter(_words(c, "a-z0-9"), lambda t: (F.length(t) >= 2) | t.rlike("[0-9]"))


def name_signal(c: Column) -> Column:
    return F.filter(_words(c, "a-z0-9"), lambda t: F.length(t) >= 2)


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_glyphs(c)), "[^a-z0-9]", "")


def spec_key(c: Column) -> Column:
    return F.lower(normalize_glyphs(c))


def compact_key(c: Column) -> Column:
    """Lower case without any white space: 'Ba SO4' and 'BaSO4' are one name."""
    return F.lower(drop_ws(c))


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def raw_cells(line: Column) -> Column:
    """Cells as printed: bar separated, else separated by two or more spaces."""
    return F.when(line.contains("|"), F.split(line, r"\|")).otherwise(F.split(line, WS + "{2,}"))


def split_cells(line: Column) -> Column:
    return F.filter(F.transform(raw_cells(line), trim_ws), lambda x: x != "")


def usable_text(text: Column, minimum: int) -> Column:
    return F.length(drop_ws(F.coalesce(text, F.lit("")))) >= minimum
