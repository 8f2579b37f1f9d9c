"""Positions in a total order, and pages of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

DEFAULT_PAGE, LARGEST_PAGE, LOOKUP_PAGE = 50, 500, 25


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with its 1-based position in a total order, by a range shuffle and one count per partition."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(spread.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranked")
    sizes = {r["__part"]: (r["n"], r["least"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("least")).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        n, least = sizes[part]
        rows.append((part, before - least + 1))
        before += n
    shifts = df.sparkSession.createDataFrame(rows, "__part int, __shift long")
    return placed.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def page_size(limit: int | None, default: int = DEFAULT_PAGE) -> int:
    return default if not limit or limit <= 0 else min(limit, LARGEST_PAGE)


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, default: int = DEFAULT_PAGE) -> DataFrame:
    """One page of an ordered list; a size of 0 or less is the default, a negative offset an error."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(page_size(limit, default))
