"""Birth dates given as ISO text, as parts, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import iso_date
from .text import blank_to_null


def date_of(y: Column, m: Column, d: Column) -> Column:
    """The date of three whole numbers, null if there is no such day."""
    in_range = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    return F.when(in_range, iso_date(F.format_string("%04d-%02d-%02d", y, m, d)))


def birth_error(iso: Column, m: Column, d: Column, y: Column) -> Column:
    """The first fault of a birth date, null if it is sound or not given."""
    iso, stated = blank_to_null(iso), iso_date(blank_to_null(iso))
    given = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in (m, d, y)), F.lit(0))
    differs = lambda c, part: c.isNotNull() & (c != part(stated))
    of_iso = F.when(stated.isNull(), "birthdate_iso must be YYYY-MM-DD").when(~F.year(stated).between(1800, 3000), "birth_year must be between 1800 and 3000").when(
        differs(m, F.month) | differs(d, F.day) | differs(y, F.year), "birthdate_iso and birth parts disagree"
    )
    of_parts = (
        F.when(given.between(1, 2), "birth month, day and year must be given together")
        .when(~m.between(1, 12), "birth_month must be between 1 and 12")
        .when(~d.between(1, 31), "birth_day must be between 1 and 31")
        .when(~y.between(1800, 3000), "birth_year must be between 1800 and 3000")
        .when((given == 3) & date_of(y, m, d).isNull(), "birth date is not a valid calendar date")
    )
    return F.when(iso.isNotNull(), of_iso).otherwise(of_parts)


def birth_iso(iso: Column, m: Column, d: Column, y: Column) -> Column:
    """The canonical text of a birth date: ISO if given, else from all three parts, else ''."""
    parts = F.when(m.isNotNull() & d.isNotNull() & y.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d))
    return F.coalesce(blank_to_null(iso), parts, F.lit(""))


def year_key(y: Column) -> Column:
    return F.when(y.isNotNull(), F.format_string("%04d", y)).otherwise("")


def tri_state(a: Column, b: Column) -> Column:
    """1 equal, 2 different, null if either is missing or blank."""
    a, b = blank_to_null(a), blank_to_null(b)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1).otherwise(2).cast("int")
