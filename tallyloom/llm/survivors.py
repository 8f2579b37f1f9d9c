"""Problem 4: the best representative of each group of duplicates, built field by field.

Method: one aggregation per table takes, for each attribute, the maximum of a composite struct (usable, source
priority, instant of update, value's record). Partial maxima leave each task, so a group of any size is one row there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_nanos, iso_date

#: Trust in a record's source; anything else comes last.
SOURCE_PRIORITY = {"LOCAL": 2, "IMPORT": 1}


@dataclass(frozen=True)
class Attribute:
    """A field that survives on its own: its value, and whether a value may survive at all."""

    name: str
    usable: Column


def filled(name: str) -> Attribute:
    return Attribute(name, F.coalesce(F.trim(F.col(name)) != "", F.lit(False)))


def contact() -> Attribute:
    """Ten or more digits, not all alike."""
    digits = F.regexp_replace(F.coalesce(F.col("contact_no"), F.lit("")), "[^0-9]", "")
    return Attribute("contact_no", (F.length(digits) >= 10) & ~digits.rlike(r"^(\d)\1*$"))


def birthdate() -> Attribute:
    """A real date written YYYY-MM-DD, after 1900-01-01 and not after the (UTC) day of created_at, if that is known."""
    born = iso_date(F.col("birthdate_iso"))
    created = F.date_from_unix_date(F.floor(instant_nanos(F.col("created_at")) / F.lit(86_400_000_000_000)).cast("int"))
    return Attribute("birthdate_iso", F.coalesce((born > F.lit("1900-01-01").cast("date")) & ((born <= created) | created.isNull()), F.lit(False)))


def survivors(groups: DataFrame, records: DataFrame, attributes: list[Attribute], group: str = "group_id", record: str = "internal_uuid") -> DataFrame:
    """(group, field_name, value, record, latest): one row per group and attribute that has a usable value.

    The value is that of the most trusted source, among those of the latest instant, among those of the greatest
    record name; ``latest`` says whether no usable value of the group is younger. Repeated members count once. Members
    without a record, null groups and groups without a usable value give no row; an unreadable time is the oldest.
    ``records`` may hold any further columns, also one named like the group.
    """
    priority = F.coalesce(*(F.when(F.upper(F.trim(F.col("source_type"))) == s, F.lit(p)) for s, p in SOURCE_PRIORITY.items()), F.lit(0))
    needed = records.select(
        F.col(record).alias("__r"),
        priority.alias("__p"),
        F.coalesce(instant_nanos(F.col("updated_at")), F.lit(-(1 << 63))).alias("__t"),
        *(F.when(a.usable, F.col(a.name)).alias(f"__v{i}") for i, a in enumerate(attributes)),
    )
    members = groups.select(F.col(group).alias("__g"), F.col(record).alias("__r")).where("__g is not null and __r is not null")
    joined = members.join(needed, "__r")
    of = lambda i, *what: F.max(F.when(F.col(f"__v{i}").isNotNull(), F.struct(*what, F.col(f"__v{i}").alias("v"))))
    best = joined.groupBy("__g").agg(
        *(of(i, F.col("__p").alias("p"), F.col("__t").alias("t"), F.col("__r").alias("r")).alias(f"__b{i}") for i in range(len(attributes))),
        *(F.max(F.when(F.col(f"__v{i}").isNotNull(), F.col("__t"))).alias(f"__m{i}") for i in range(len(attributes))),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(a.name).alias("field_name"), F.col(f"__b{i}").alias("b"), F.col(f"__m{i}").alias("m")) for i, a in enumerate(attributes))))
    return (
        best.select(F.col("__g").alias(group), rows.alias("x"))
        .where("x.b is not null")
        .select(group, "x.field_name", F.col("x.b.v").alias("value"), F.col("x.b.r").alias(record), (F.col("x.b.t") == F.col("x.m")).alias("latest"))
    )


def golden_records(groups: DataFrame, records: DataFrame, attributes: list[Attribute], group: str = "group_id", record: str = "internal_uuid") -> DataFrame:
    """One row per group with a usable value: the group and every attribute's surviving value, null where none is usable."""
    rows = survivors(groups, records, attributes, group, record)
    return rows.groupBy(group).agg(*(F.max(F.when(F.col("field_name") == a.name, F.col("value"))).alias(a.name) for a in attributes))
