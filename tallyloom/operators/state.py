"""Snapshots as tables: overlays, upserts, soft deletes, decisions, transitions, filters, pages, backups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_pattern

#: Columns of the record list's search, and its order.
SEARCHED = ("generated_id", "last_name", "first_name", "middle_name", "extension_name", "contact_no_norm", "source_reference")
LIST_ORDER = ("last_name", "first_name", "middle_name", "extension_name", "generated_id", "internal_uuid")


def overlay(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with delta's rows in place of those of equal key; columns that delta lacks keep base's values."""
    missing = [c for c in base.columns if c not in delta.columns]
    full = delta if not missing else delta.join(base.select(key, *missing), key, "left")
    return base.join(delta.select(key), key, "left_anti").unionByName(full.select(*base.columns))


def upsert(base: DataFrame, events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """base after events in order: the last event of a key wins over the base and all before it."""
    w = Window.partitionBy(key).orderBy(*order)
    last = events.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return overlay(base, last, key)


def insert_absent(base: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """base and the first new row of each key that base lacks."""
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
    return base.unionByName(first.join(base.select(key), key, "left_anti").select(*base.columns))


def soft_delete(records: DataFrame, ids: DataFrame, at: str, key: str = "internal_uuid") -> DataFrame:
    """records with the listed ones marked deleted at a time; others and already deleted ones stay as they are."""
    marked = records.join(ids.select(key).distinct().withColumn("__d", F.lit(True)), key, "left")
    now = F.coalesce(F.col("__d"), F.lit(False)) & (F.coalesce(F.col("record_status"), F.lit("")) != "DELETED")
    return marked.withColumns({"deleted_at": F.when(now, F.lit(at)).otherwise(F.col("deleted_at")), "updated_at": F.when(now, F.lit(at)).otherwise(F.col("updated_at")), "record_status": F.when(now, "DELETED").otherwise(F.col("record_status"))}).select(*records.columns)


def edited(records: DataFrame, drafts: DataFrame, fields: Iterable[str], at: str, key: str = "internal_uuid") -> DataFrame:
    """records whose given fields take a draft's values; ids, status, source and created_at stay."""
    fixed = {key, "generated_id", "created_at", "record_status", "source_type", "source_reference"}
    taken = [c for c in fields if c not in fixed]
    d = drafts.select(key, *(F.col(c).alias(f"__{c}") for c in taken), F.lit(True).alias("__e"))
    both = records.join(d, key, "left")
    values = {c: F.when(F.col("__e"), F.col(f"__{c}")).otherwise(F.col(c)) for c in taken} | {"updated_at": F.when(F.col("__e"), F.lit(at)).otherwise(F.col("updated_at"))}
    return both.withColumns(values).select(*records.columns)


def decided(matches: DataFrame, decisions: DataFrame, order: list[Column]) -> DataFrame:
    """matches with the status RESOLVED and the decision where a pair's last decision isn't a reset, PENDING elsewhere."""
    w = Window.partitionBy("pair_key").orderBy(*order)
    last = decisions.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("pair_key", F.col("decision").alias("last_decision"))
    both = matches.drop("decision").join(last, "pair_key", "left").withColumn("decision", F.when(F.col("last_decision") != "RESET", F.col("last_decision"))).drop("last_decision")
    return both.withColumn("decision_status", F.when(F.col("decision").isNotNull(), "RESOLVED").otherwise("PENDING"))


def transitions(events: DataFrame, allowed: Iterable[tuple[str, str]], key: str, state: str, order: list[Column]) -> DataFrame:
    """events with the state before and whether that step is in a table of allowed ones (a first event always is)."""
    steps = events.sparkSession.createDataFrame(list(allowed), "__from string, __to string").withColumn("__ok", F.lit(True))
    w = Window.partitionBy(key).orderBy(*order)
    df = events.withColumn("previous", F.lag(state).over(w))
    df = df.join(F.broadcast(steps), (F.col("previous") == F.col("__from")) & (F.col(state) == F.col("__to")), "left")
    return df.withColumn("allowed", F.col("previous").isNull() | F.coalesce("__ok", F.lit(False))).drop("__from", "__to", "__ok")


def where_filled(df: DataFrame, **wanted: str | bool | list | None) -> DataFrame:
    """Conjunction of equalities; a None or blank value doesn't filter, a list means one of."""
    conditions = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in wanted.items() if v is not None and not (isinstance(v, str) and not v.strip())]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def search(df: DataFrame, value: str | None, columns: Iterable[str] = SEARCHED) -> DataFrame:
    """Rows of which any column contains the value, ASCII case aside; % and _ stay wildcards; a blank value doesn't filter."""
    if not value or not value.strip():
        return df
    return df.where(reduce(lambda a, b: a | b, (contains_pattern(c, value.strip()) for c in columns)))


def list_order(columns: Iterable[str] = LIST_ORDER) -> list[Column]:
    return [F.asc_nulls_first(c) for c in columns]


def page_with_total(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of a list and how many rows the whole list has."""
    from .ranking import page

    return page(df, order, limit, offset), df.count()


def pages_of(df: DataFrame, order: list[Column], size: int = 20) -> DataFrame:
    """df with the number of the page of ``size`` rows on which each row stands, from 1."""
    from .ranking import global_row_number

    return global_row_number(df, order, "__n").withColumn("page", (F.floor((F.col("__n") - 1) / size) + 1).cast("int")).drop("__n")


def versions(applied: DataFrame, known: list[int], target: int | None = None) -> tuple[int, list[int], list[int]]:
    """(current version, versions to apply upwards, versions to take back downwards) of a journal of applied versions; an empty journal is at 0.

    Without a target all known versions are applied. A journal that has a version nobody knows is an error.
    """
    done = sorted(r[0] for r in applied.select("version").distinct().collect())  # one row per schema version
    if unknown := [v for v in done if v not in known]:
        raise ValueError(f"unknown versions {unknown}")
    goal = max(known, default=0) if target is None else target
    return max(done, default=0), [v for v in sorted(known) if v <= goal and v not in done], [v for v in reversed(done) if v > goal]


def backup(snapshot: DataFrame, path: str, name: str, at: str) -> dict:
    """Writes a snapshot with a manifest of its rows, columns, bytes and an order-free checksum; returns the manifest."""
    snapshot.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = snapshot.sparkSession
    manifest = manifest_of(spark.read.parquet(f"{path}/{name}")) | {"name": name, "created_at_utc": at, "size": _bytes(spark, f"{path}/{name}")}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{name}.manifest")
    return manifest


def _bytes(spark, path: str) -> int:  # noqa: ANN001
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def manifest_of(df: DataFrame) -> dict:
    """Rows, columns and a checksum of two independent sums of row hashes: equal rows add up and don't cancel, and the order doesn't count."""
    columns = sorted(df.columns)
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(20,0)") for a in (1, 16, 31, 46)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(h), F.lit(0)).alias(f"s{i}") for i, h in enumerate(halves))).first()
    text = f"{row['rows']}|" + "|".join(str(int(row[f"s{i}"])) for i in range(4))
    return {"rows": row["rows"], "checksum": hashlib.sha256(text.encode()).hexdigest(), "columns": columns}


def validated(spark, path: str, name: str, jobs: DataFrame | None = None) -> dict:  # noqa: ANN001
    """A dry run of a restore: the manifest, after the snapshot is found to be what it says, and the number of jobs that stand in the way."""
    manifest = json.loads(spark.read.text(f"{path}/{name}.manifest").first()[0])
    found = manifest_of(spark.read.parquet(f"{path}/{name}")) | {"size": _bytes(spark, f"{path}/{name}")}
    if found != {k: manifest[k] for k in found}:
        raise ValueError(f"{name} is not what its manifest says")
    blocking = 0 if jobs is None else jobs.where(F.col("state").isin("queued", "running", "cancel_requested")).count()
    return manifest | {"blocking_jobs": blocking, "apply_ready": blocking == 0}


def restore(spark, path: str, name: str, jobs: DataFrame | None = None, live: DataFrame | None = None, confirmation: str | None = None, phrase: str | None = None, at: str | None = None) -> DataFrame:  # noqa: ANN001
    """The snapshot, after all checks. A phrase, if one is required, must be confirmed; jobs in the way are an error.

    A live table is backed up first, as pre-restore-<at> beside the snapshot, to roll back to.
    """
    if phrase is not None and (confirmation or "").strip() != phrase:
        raise ValueError("the restore must be confirmed by its phrase" if not (confirmation or "").strip() else "the confirmation is not the phrase")
    checked = validated(spark, path, name, jobs)
    if not checked["apply_ready"]:
        raise ValueError(f"{checked['blocking_jobs']} unfinished jobs stand in the way")
    if live is not None:
        backup(live, path, f"pre-restore-{''.join(c for c in at or '' if c.isalnum())}", at or "")
    return spark.read.parquet(f"{path}/{name}")
