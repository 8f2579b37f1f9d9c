"""Import of drafts: dispositions of all rows in one pass, counters, ledger, budgeted and resumable commits."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import birth_error
from ..functions.text import blank, blank_to_null, collapse, whole_number
from ..operators.audit import decode_token, encode_token
from ..operators.durable import durable
from ..operators.geography import CHAIN, LEVELS
from ..operators.ranking import page
from ..operators.records import exact_key, normalized, validation_error
from ..operators.skew import keyed_left_join

SAMPLES = 10


def normalization_stamp(version: str, checksum: str) -> str:
    return hashlib.sha256(f"{version}|{checksum}".encode()).hexdigest()


def dispositions(rows: DataFrame, store: DataFrame, order: list[Column], error: Column | None = None, review: Column | None = None) -> DataFrame:
    """rows with ``disposition`` (inserted, skipped, failed) and ``message``.

    Row after row: a row whose place needs ``review`` is skipped, an invalid row fails; a row whose source_reference is
    in the store, or that equals a record of the store or an earlier valid row, is skipped; others are inserted. Only
    inserted rows can stop later ones and rows of equal key share their fate, so the first of each key decides for
    all, and no row waits for another. Rows without a reference take no part in the search by references.
    """
    df = rows.withColumns({"__review": F.lit(False) if review is None else F.coalesce(review, F.lit(False)), "__error": validation_error() if error is None else error, "__key": exact_key(), "__ref": blank_to_null("source_reference")})
    df = durable(df.withColumn("__at", F.struct(*order)), "drafts")
    refs = store.where("record_status <> 'DELETED'").select(blank_to_null("source_reference").alias("__ref")).where("__ref is not null").distinct().withColumn("__known", F.lit(True))
    keys = store.where("record_status <> 'DELETED'").select(exact_key().alias("__key")).distinct().withColumn("__same", F.lit(True))
    df = keyed_left_join(df, refs, "__ref").join(keys, "__key", "left")
    valid = F.col("__error").isNull() & ~F.col("__review")
    df = df.withColumn("__may", valid & F.col("__known").isNull() & F.col("__same").isNull())
    # The first open row of each key is found by an aggregate that each task begins by itself.
    first_ref = df.where("__may and __ref is not null").groupBy("__ref").agg(F.min("__at").alias("__ref_at"))
    df = keyed_left_join(df, first_ref, "__ref").withColumn("__open", F.col("__may") & (F.col("__ref").isNull() | (F.col("__at") == F.col("__ref_at"))))
    first_key = df.where("__open").groupBy("__key").agg(F.min("__at").alias("__key_at"))
    df = df.join(first_key, "__key", "left").withColumn("__first", F.col("__open") & (F.col("__at") == F.col("__key_at")))
    disposition = F.when(F.col("__review"), "skipped").when(~valid, "failed").when(F.col("__first"), "inserted").otherwise("skipped")
    message = F.coalesce(
        F.when(F.col("__review"), F.lit("location needs review")), F.col("__error"), F.when(F.col("__known"), F.lit("source_reference exists")),
        F.when(~F.col("__first") & ~F.col("__open") & F.col("__same").isNull(), F.lit("source_reference exists")), F.when(~F.col("__first"), F.lit("exact duplicate")),
    )
    return df.withColumns({"disposition": disposition, "message": message}).select(*rows.columns, "disposition", "message")


def public_drafts(rows: DataFrame, normalized_places: DataFrame, least: float = 0.90) -> DataFrame:
    """Rows of the public layout as drafts: cleaned, with the resolved place, ``place_status``, ``draft_error`` and ``needs_review``.

    ``normalized_places`` is geography.normalize of the same rows. All four places must be typed; a place that isn't
    resolved whole, or needs review at a confidence below ``least``, needs review; a fault of dates or fields comes
    after that.
    """
    typed = dict(zip(LEVELS, ("region", "province", "city_municipality", "barangay")))
    df = rows.withColumns({f"__{x}": collapse(F.coalesce(F.col(c), F.lit(""))) for x, c in typed.items()})
    found = normalized_places.select(*(F.col(x).alias(f"__{x}") for x in LEVELS), *CHAIN, F.col("status").alias("place_status"), "match_source", "confidence", F.col("reason").alias("place_reason"))
    df = df.join(found, [f"__{x}" for x in LEVELS], "left")
    missing = F.lit(False)
    for x in LEVELS:
        missing = missing | (F.col(f"__{x}") == "")
    whole = F.lit(True)
    for x in LEVELS:
        whole = whole & ~blank(f"{x}_code")
    review = ~missing & (location_outcome(F.col("confidence"), F.col("place_status"), whole, least) == "review")
    numbers = {c: whole_number(c) for c in ("month_mm", "day_dd", "year_yyyy")}
    bad = F.coalesce(*(F.when(n["bad"], F.lit(f"{c} must be a whole number")) for c, n in numbers.items()))
    made = {"generated_id": blank_to_null("id"), "birth_month": numbers["month_mm"]["value"], "birth_day": numbers["day_dd"]["value"], "birth_year": numbers["year_yyyy"]["value"], "birthdate_iso": F.lit(None).cast("string")}
    # Written, as the checks below read every value several times.
    df = durable(df.withColumns(made | {"needs_review": review, "__missing": missing, "__bad": bad}), "typed-drafts")
    df = durable(normalized(df), "drafts")
    error = F.coalesce(F.when(F.col("__missing"), F.lit("region, province, city_municipality, and barangay are required")), F.col("__bad"), validation_error())
    return df.withColumn("draft_error", error).drop("__missing", "__bad")


def counters(done: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows_read, rows_inserted, rows_skipped, rows_failed)."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    return done.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_read"), n("inserted").alias("rows_inserted"), n("skipped").alias("rows_skipped"), n("failed").alias("rows_failed"))


def preview(rows: DataFrame, by: list[str], line: str, error: Column | None = None, samples: int = SAMPLES) -> DataFrame:
    """(by..., row_count_total, row_count_valid, row_count_invalid, sample_errors) without touching the store."""
    checked = rows.select(*by, F.col(line).alias("__n"), (validation_error() if error is None else error).alias("__e"))
    totals = checked.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count_total"), F.count_if(F.col("__e").isNull()).alias("row_count_valid"), F.count("__e").alias("row_count_invalid"))
    first = checked.where("__e is not null").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("__n"))).where(F.col("k") <= samples)
    said = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__e"))), lambda x: F.concat(F.lit("row "), x["__n"].cast("string"), F.lit(": "), x["__e"])).alias("sample_errors"))
    out = totals.join(said, [totals[b].eqNullSafe(said[b]) for b in by], "left")
    return out.select(*(totals[b] for b in by), "row_count_total", "row_count_valid", "row_count_invalid", F.coalesce("sample_errors", F.array().cast("array<string>")).alias("sample_errors"))


def idempotent(logs: DataFrame, wanted: DataFrame, among: int = 500) -> DataFrame:
    """The logs, among the latest ``among``, of the same file and key as a wanted row (file_hash, idempotency_key): what a commit returns instead of running again."""
    latest = page(logs, [F.desc_nulls_last("started_at"), F.asc("import_id")], among, default=among)
    return latest.join(wanted.select("file_hash", "idempotency_key").distinct(), ["file_hash", "idempotency_key"], "left_semi")


def repeated_imports(logs: DataFrame) -> DataFrame:
    """(file_hash, idempotency_key, first_import, imports): files that were sent more than once."""
    return logs.where(~blank("file_hash")).groupBy("file_hash", "idempotency_key").agg(F.min_by("import_id", F.struct("started_at", "import_id")).alias("first_import"), F.count(F.lit(1)).alias("imports")).where("imports > 1")


def public_draft_error() -> Column:
    """The first fault of a row of the public layout whose date parts are text."""
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]{1,9}$"), F.trim(c).try_cast("long"))
    parts = [F.col(c) for c in ("month_mm", "day_dd", "year_yyyy")]
    words = F.coalesce(*(F.when(~blank(c) & number(c).isNull(), F.lit(f"{n} must be a whole number")) for c, n in zip(parts, ("month", "day", "year"))))
    m, d, y = (number(c) for c in parts)
    required = [F.when(blank(c), F.lit(f"{c} is required")) for c in ("last_name", "first_name")]
    return F.coalesce(*required, words, birth_error(F.lit(None).cast("string"), m, d, y), F.when(blank("sex"), F.lit("sex is required")))


def location_outcome(confidence: Column, status: Column, complete: Column, least: float = 0.90) -> Column:
    """apply, accept_reviewed, or review: a normalized place that is complete and sure, good enough, or neither."""
    return F.when(~complete, "review").when(status == "AUTO_APPLIED", "apply").when(confidence >= least, "accept_reviewed").otherwise("review")


@dataclass(frozen=True)
class Commit:
    """The state of a budgeted import: what was read, and the token by which it goes on."""

    rows: DataFrame
    status: str
    token: str | None
    repeated: str | None = None


def commit(drafts: DataFrame, store: DataFrame, row: str, source_hash: str, stamp: str, budget: int | None = None, token: str | None = None, logs: DataFrame | None = None, key: str | None = None) -> Commit:
    """The dispositions of the next ``budget`` rows by number, PARTIAL with a token if more are left, else SUCCEEDED or RESUMED.

    A token of another source or another normalization is refused. The caller adds the inserted rows to the store
    before it resumes. Given the logs of earlier imports and an idempotency key, a first commit of the same source and
    key runs nothing and gives the earlier import's id and status with no rows.
    """
    start = 1
    if logs is not None and not token:
        if not (key or "").strip():
            raise ValueError("an idempotency key is required")
        wanted = logs.sparkSession.createDataFrame([(source_hash, key.strip())], "file_hash string, idempotency_key string")
        if earlier := idempotent(logs, wanted).select("import_id", "status").first():
            none = drafts.limit(0).withColumns({"disposition": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
            return Commit(none, earlier["status"], None, earlier["import_id"])
    if token:
        state = decode_token(token)
        if state.get("source_hash") != source_hash or state.get("stamp") != stamp:
            raise ValueError("the token is of another source or normalization")
        start = int(state["next_row"])
    stop = None if budget is None else start + budget
    span = drafts.where(F.col(row) >= start) if stop is None else drafts.where((F.col(row) >= start) & (F.col(row) < stop))
    more = stop is not None and bool(drafts.where(F.col(row) >= stop).limit(1).count())
    done = dispositions(span, store, [F.col(row)])
    next_token = encode_token({"source_hash": source_hash, "stamp": stamp, "next_row": stop}) if more else None
    return Commit(done, "PARTIAL" if more else "RESUMED" if token else "SUCCEEDED", next_token)


def ledger(done: DataFrame, run_id: str, row: str) -> DataFrame:
    """One lineage row for each imported row whose place was looked up: its number and reference, typed and resolved place, outcome.

    ``done`` are public_drafts with their dispositions. A row that was skipped for review is REVIEW_NEEDED.
    """
    looked = done.where("place_status is not null and not (disposition = 'failed' and message = 'region, province, city_municipality, and barangay are required')")
    status = F.when(F.col("needs_review"), "REVIEW_NEEDED").otherwise(F.col("place_status"))
    return looked.select(
        F.lit(run_id).alias("run_id"), F.col(row).alias("row_number"), "source_reference", *(F.col(f"__{x}").alias(f"raw_{x}") for x in LEVELS), *(F.col(c).alias(f"resolved_{c}") for c in CHAIN), "confidence", "match_source",
        status.alias("status"), (status != "AUTO_APPLIED").alias("needs_review"), F.coalesce("place_reason", F.when(F.col("needs_review"), F.col("message"))).alias("reason"),
    )


def run_counts(done: DataFrame, items: DataFrame) -> DataFrame:
    """(total_rows, auto_applied_rows, review_rows, failed_rows) of an import's normalization run."""
    of_rows = done.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("disposition") == "failed").alias("failed_rows"))
    of_items = items.agg(F.count_if(F.col("status") == "AUTO_APPLIED").alias("auto_applied_rows"), F.count_if(F.col("status") != "AUTO_APPLIED").alias("review_rows"))
    return of_rows.crossJoin(of_items).select("total_rows", "auto_applied_rows", "review_rows", "failed_rows")  # two single rows
