"""Numerals, cell references and spreadsheet number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of Roman numerals. Fixed values.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    """Lower-case numeral of 1..3999, else the decimal number."""
    parts, rest = [], n
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def letters_repeat(n: Column) -> Column:
    """A..Z, AA, BB..: the page-label style; empty below 1, decimal from 4000."""
    return F.when(n < 1, "").when(n >= 4000, n.cast("string")).otherwise(F.repeat(F.char((65 + (n - 1) % 26).cast("long")), (F.floor((n - 1) / 26) + 1).cast("int")))


def letters_bijective(n: Column, width: int = 7) -> Column:
    """a..z, aa, ab..: list markers and, upper-cased, spreadsheet columns."""
    parts, rest = [], n.cast("long")
    for _ in range(width):
        parts.insert(0, F.when(rest > 0, F.char(97 + (rest - 1) % 26)).otherwise(F.lit("")))
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return F.concat(*parts)


def cell_ref(row: Column, col: Column) -> Column:
    """A1-style reference of 1-based row and column."""
    return F.concat(F.upper(letters_bijective(col)), row.cast("string"))


def cell_col(ref: Column) -> Column:
    """1-based column of an A1-style reference; 0 without letters."""
    name = F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1))
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


def fixed(n: Column, digits: int, percent: bool = False, group: bool = False, prefix: str = "") -> Column:
    """A number by a code of fixed decimals: rounded half away from zero, optionally x100, grouped, after a literal."""
    v = F.round((n * 100 if percent else n).cast("decimal(30,10)"), digits)
    s = F.format_number(v, digits)
    return F.concat(F.lit(prefix), s if group else F.replace(s, F.lit(","), F.lit("")), F.lit("%" if percent else ""))


def date_serial(n: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", epoch: str = "1899-12-30") -> Column:
    """A day count since the spreadsheet epoch as a formatted date."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(epoch), "yyyy-MM-dd") + F.floor(n * 86400).cast("long")), fmt)
