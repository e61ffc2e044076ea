"""Names, numbers and dates as they stand in tables (§2.8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, in the same order.
MARKED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def plain_name(name: Column) -> Column:
    """A key for names: lower case, without marks, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), MARKED, PLAIN), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain_name(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def number_cell(cell: Column, thousands: str = ",", decimal: str = ".") -> Column:
    """A table cell as a number: dashes and empty cells are null, footnote marks in brackets go."""
    text = F.trim(F.regexp_replace(F.regexp_replace(cell, " ", " "), r"\s*\(\d+\)\s*$", ""))
    text = F.replace(F.replace(text, F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(~text.isin("", "-", "–", "—"), text.try_cast("double"))


def same_value(cell: Column, wanted: str | int | float) -> Column:
    """Equality that takes 2021 and "2021.0" for the same; a missing cell never matches."""
    text = F.trim(cell.cast("string"))
    try:
        out = (text.try_cast("double") == float(wanted)) | (text == str(wanted))
    except (TypeError, ValueError):
        out = text == str(wanted)
    return F.coalesce(out, F.lit(False))


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as (y, m, d); null if it is none of them."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", k), F.lit("")).cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")))


def decimal_year(date: Column) -> Column:
    """The middle of the year, or of the month where it is known; days don't count."""
    return date["y"] + F.coalesce((date["m"] - 0.5) / 12, F.lit(0.5))


def month_window(year: Column, first: int, last: int) -> Column:
    """(start, end) from the first day of one month to the last day of another; a window that begins after it ends begins
    in the year before."""
    start = F.make_date(year - (1 if first > last else 0), F.lit(first), F.lit(1))
    return F.struct(start.alias("start"), F.last_day(F.make_date(year, F.lit(last), F.lit(1))).alias("end"))
