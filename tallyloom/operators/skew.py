"""Equi-join whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_rows: int = 200_000) -> DataFrame:
    """left joined with right, whose key is unique. No row of either side is dropped to escape skew.

    Keys with over ``hot_rows`` left rows are found by an exact, pre-aggregated count; there are at most
    ``count(left) / hot_rows`` of them, and the runtime broadcasts their right rows if their measured size allows it;
    else both are spread over salts. All other rows take the shuffled join. A null key matches nothing and stays in a
    left join.
    """
    hot = left.groupBy(key).count().where((F.col("count") > hot_rows) & F.col(key).isNotNull())
    split = _salts(hot, key, hot_rows)
    a = left.join(split, key, "left").withColumn("__salt", F.when(F.col("__n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("__n"))).otherwise(F.lit(0).cast("long"))).drop("__n")
    b = right.join(split, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__n") - 1, F.lit(0).cast("long"))))).drop("__n")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def keyed_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left join by a key that may be null in many rows: these match nothing and stay out of the shuffle."""
    kept = left.where(F.col(key).isNotNull()).join(right, key, "left")
    return kept.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def _salts(counts: DataFrame, key: str, per_task: int) -> DataFrame:
    """(key, __n): in how many parts each counted key is split."""
    return counts.select(key, F.ceil(F.col("count") / per_task).cast("long").alias("__n"))


def hot_keys(df: DataFrame, key: str, expected: int, least: int = 2_000) -> DataFrame | None:
    """Durable (key, __n): keys with more rows than one task should pair, and into how many parts each is split; None if there is none.

    Rows are first counted by hash buckets, which reduces them to a small table within each task; the numbers of full
    buckets (at most 400,000, mostly none) come to the driver, and only keys of these are counted themselves. A key counts as hot from ``least`` rows, or from a share of 1 / 100,000 of the
    ``expected`` rows, so there are at most 100,000 of them. The numbers steer the work and never the result.
    """
    from .durable import durable

    per_task = max(least, expected // 100_000)
    bucket = F.pmod(F.xxhash64(key), F.lit(max(16, 4 * expected // per_task)))
    found = df.groupBy(bucket.alias("__b")).count().where(F.col("count") > per_task).select("__b").collect()
    if not found:
        return None
    full = df.sparkSession.createDataFrame(found, "__b long")
    counts = df.withColumn("__b", bucket).join(full, "__b").where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > per_task)
    hot = durable(_salts(counts, key, per_task), "hot")
    return hot if hot.count() else None


def block_join(left: DataFrame, right: DataFrame, key: str, by: str, expected: int, least: int = 2_000) -> DataFrame:
    """All pairs of left and right rows of one block (equal keys), blocks being of any size.

    A block's pairs are many times its rows, so it is split by its rows, not its bytes: the left rows of a hot block are
    spread by a hash of column ``by`` over as many parts as needed, and its right rows are copied to each. Other blocks
    take a plain shuffled join.
    """
    hot = hot_keys(left, key, expected, least)
    if hot is None:
        return left.join(right, key)
    cold = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    a = left.join(hot, key).withColumn("__salt", F.pmod(F.xxhash64(by), F.col("__n"))).drop("__n")
    b = right.join(hot, key).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    return cold.unionByName(a.join(b, [key, "__salt"]).drop("__salt"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the given order; one row per key leaves each task before the shuffle's window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
