"""Text functions on columns: normal forms, keys and parsing. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNICODE_EDGES = r"(?U)^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(c), _UNICODE_EDGES, "")


def blank(c: Column | str) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(trim_all(c), F.lit("")) == ""


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Trimmed, every run of Unicode white space one space."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def entry_text(c: Column | str) -> Column:
    """Trimmed of any white space; only runs of ASCII white space become one space."""
    return F.regexp_replace(trim_all(c), r"[\t\n\f\r ]+", " ")


def match_name(normal: Column | str, raw: Column | str) -> Column:
    """Upper-case collapsed name; the raw one where the normal one is blank; '' for neither."""
    one = lambda c: F.nullif(F.upper(collapse(c)), F.lit(""))
    return F.coalesce(one(normal), one(raw), F.lit(""))


def digits(c: Column | str) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(_col(c), "[^0-9]", "")


def lookup_key(c: Column | str) -> Column:
    return F.lower(collapse(c))


def location_key(c: Column | str) -> Column:
    """Lower-case words of letters and digits joined by one space; a tilde n counts as n, all else parts words."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(_col(c), F.lit("")), "ñÑ", "nn"), r"[^\p{L}\p{Nd}]+", " ")))


def same_place(raw: Column | str, code: Column | str, name: Column | str) -> Column:
    """A filled raw text that is the code in any case, or whose location key is the name's."""
    raw = _col(raw)
    return ~blank(raw) & F.coalesce((F.lower(trim_all(raw)) == F.lower(_col(code))) | (location_key(raw) == location_key(name)), F.lit(False))


def basename(path: Column | str) -> Column:
    """Last part of a path with either slash; null for '.', '/' and blank."""
    clean = F.regexp_replace(F.replace(trim_all(path), F.lit("\\"), F.lit("/")), "/+$", "")
    last = F.element_at(F.split(clean, "/"), -1)
    return F.when(~last.isin("", "."), last)


def padded_id(number: Column | str, prefix: str = "G", width: int = 6) -> Column:
    """prefix-000001; a longer number is not cut."""
    text = _col(number).cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """The two names in byte order, joined by a bar."""
    return F.concat_ws("|", F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b)))


def whole_number(c: Column | str) -> Column:
    """struct(value, bad): blank gives null; text that is no whole number is bad."""
    text = trim_all(c)
    value = F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text.try_cast("long"))
    return F.struct(value.alias("value"), (F.coalesce(text != "", F.lit(False)) & value.isNull()).alias("bad"))


def with_provenance(reference: Column | str, generated_id: Column | str) -> Column:
    """reference;source_generated_id=X unless it says so already; without an id, the reference alone."""
    ref, made = F.coalesce(trim_all(reference), F.lit("")), blank_to_null(generated_id)
    note = F.concat(F.lit("source_generated_id="), made)
    return F.when(made.isNull() | F.contains(ref, note), F.nullif(ref, F.lit(""))).when(ref == "", note).otherwise(F.concat(ref, F.lit(";"), note))


def full_name(last: Column | str, first: Column | str, middle: Column | str, extension: Column | str) -> Column:
    """'Last, First Middle Ext' of the parts that are filled; n/a for none."""
    given = F.concat_ws(" ", *(blank_to_null(c) for c in (first, middle, extension)))
    return F.coalesce(F.nullif(F.concat_ws(", ", blank_to_null(last), F.nullif(given, F.lit(""))), F.lit("")), F.lit("n/a"))


def named_code(name: Column | str, code: Column | str) -> Column:
    """'Name [code]', either alone, or n/a."""
    n, c = blank_to_null(name), blank_to_null(code)
    return F.coalesce(F.concat(n, F.lit(" ["), c, F.lit("]")), n, c, F.lit("n/a"))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A to Z only."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_pattern(c: Column | str, value: str) -> Column:
    """LIKE '%value%' without ASCII case; % and _ in the value stay wildcards."""
    from functools import reduce

    folded = reduce(lambda s, x: s.replace(x, x.lower()), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", value)
    return ascii_lower(c).like(f"%{folded}%")


def formula_guard(c: Column | str) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(_col(c).rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), _col(c))).otherwise(_col(c))
