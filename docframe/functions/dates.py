"""Dates as documents write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PDF = r"^(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:[Zz]|([+-])(\d\d)'?(\d\d)?'?)?"


def pdf_date(s: Column) -> Column:
    """UTC timestamp of `D:YYYYMMDDHHmmSS+hh'mm'`; all after the year may be missing, a bad zone is UTC."""
    g = lambda k: F.regexp_extract(s, _PDF, k)
    part = lambda k, default: F.when(g(k) == "", default).otherwise(g(k).cast("int"))
    base = F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0)), F.lit("yyyy-MM-dd HH:mm:ss")
    )
    hours, minutes = part(8, 0), part(9, 0)
    shift = F.when((hours > 23) | (minutes > 59) | (g(7) == ""), 0).otherwise((hours * 60 + minutes) * F.when(g(7) == "-", 1).otherwise(-1))
    return F.when(g(1) != "", F.timestamp_add("MINUTE", shift, base))


def iso_date(s: Column) -> Column:
    """Timestamp of a date-time, date, year and month, or year."""
    s = F.trim(s)
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy")
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in forms))
