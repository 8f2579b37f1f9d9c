"""Text timestamps of varying length and offset as exact instants, and ISO dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9})\d*)?\s*(?:Z|z|([+-])(\d{2}):?(\d{2}))?$"


def instant_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 UTC of an RFC 3339 text, as a long; null for null or for text of another form.

    A missing offset counts as UTC. Years 1678 to 2261 fit; text beyond them gives null.
    """
    t = F.trim(text)
    part = lambda n: F.regexp_extract(t, _FORM, n)
    days = F.unix_date(F.try_to_date(F.nullif(part(1), F.lit("")), "yyyy-MM-dd")).cast("long")
    number = lambda n: F.coalesce(F.nullif(part(n), F.lit("")), F.lit("0")).cast("long")
    offset = (number(7) * 60 + number(8)) * F.when(part(6) == "-", -60).otherwise(60)
    seconds = days * 86400 + number(2) * 3600 + number(3) * 60 + number(4) - offset
    nanos = F.rpad(F.coalesce(part(5), F.lit("")), 9, "0").cast("long")
    return F.when(F.abs(seconds) < 9_200_000_000, seconds * 1_000_000_000 + nanos)


def iso_date(text: Column) -> Column:
    """The date of a text written exactly YYYY-MM-DD; null for anything else and for days that don't exist."""
    return F.try_to_date(F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), "yyyy-MM-dd")
