"""Numeric, blank and emptiness conventions that every other function shares."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: All characters the source data treats as blanks, for Java's and RE2's regular expressions alike.
BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def js_round(x: Column, places: int = 0) -> Column:
    """Rounds half towards plus infinity on the scaled double."""
    scale = F.lit(float(10**places))
    return F.floor(x.cast("double") * scale + F.lit(0.5)) / scale


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def trim_blank(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def collapse_blank(x: Column) -> Column:
    return trim_blank(F.regexp_replace(x, f"{BLANK}+", " "))


def missing(x: Column) -> Column:
    """Null or empty text; 0 and false are values."""
    return x.isNull() | (x == "")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
