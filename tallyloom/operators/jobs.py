"""States of long-running jobs as a table: transitions, attempts, progress, recovery after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

# The transitions of a job.
TRANSITIONS = (
    ("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "cancel_requested"), ("running", "recoverable"), ("cancel_requested", "cancelled"), ("recoverable", "running"), ("recoverable", "failed"),
)
COLUMNS = ("job_id", "state", "updated_at", "attempt", "progress", "message", "error_code")


def allowed(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in TRANSITIONS:
        out = out | ((before == a) & (after == b))
    return F.coalesce(out, F.lit(False))


def moved(jobs: DataFrame, requests: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(jobs after one request each, refused requests with the reason).

    jobs has the columns COLUMNS; a request (job_id, next, progress, message, error_code) is one step of one job. Into
    running, a queued or recoverable job counts an attempt. Progress is the requested one, else 0 for a fresh run, 100 for
    a success, and kept otherwise; an error code stays only with a failure; a blank message keeps the old one.
    """
    r = requests.select("job_id", F.col("next").alias("__next"), F.col("progress").alias("__progress"), blank_to_null("message").alias("__message"), blank_to_null("error_code").alias("__code"))
    both = jobs.join(r, "job_id", "full").withColumn("__ok", allowed(F.col("state"), F.col("__next")) & (F.col("__progress").isNull() | F.col("__progress").between(0, 100)))
    steps, again = F.coalesce("__ok", F.lit(False)), (F.col("__next") == "running") & F.col("state").isin("queued", "recoverable")
    kept = F.when(F.col("__next") == "running", F.when(F.col("state") == "recoverable", F.coalesce("progress", F.lit(0.0))).otherwise(0.0)).when(F.col("__next") == "succeeded", 100.0).otherwise(F.col("progress"))
    values = {
        "attempt": F.when(steps & again, F.col("attempt") + 1).otherwise(F.col("attempt")), "progress": F.when(steps, F.coalesce("__progress", kept)).otherwise(F.col("progress")),
        "message": F.when(steps, F.coalesce("__message", "message")).otherwise(F.col("message")), "error_code": F.when(steps, F.when(F.col("__code").isNotNull(), F.col("__code")).when(F.col("__next") == "failed", F.col("error_code"))).otherwise(F.col("error_code")),
        "updated_at": F.when(steps, F.lit(at)).otherwise(F.col("updated_at")), "state": F.when(steps, F.col("__next")).otherwise(F.col("state")),
    }
    reason = F.when(F.col("state").isNull(), "unknown job").when(~allowed(F.col("state"), F.col("__next")), F.concat(F.lit("no step from "), "state", F.lit(" to "), "__next")).otherwise("progress must lie between 0 and 100")
    refused = both.where(F.col("__next").isNotNull() & ~F.coalesce("__ok", F.lit(False))).select("job_id", F.col("__next").alias("next"), reason.alias("reason"))
    return both.where("state is not null").withColumns(values).select(*COLUMNS), refused


def recovered(jobs: DataFrame, at: str) -> DataFrame:
    """jobs after a restart: those that ran are recoverable, with a message if they had none; a requested cancellation stays."""
    ran = F.col("state") == "running"
    return jobs.withColumns({
        "message": F.when(ran, F.coalesce(blank_to_null("message"), F.lit("recovered after a restart"))).otherwise(F.col("message")), "error_code": F.when(~ran, F.col("error_code")),
        "updated_at": F.when(ran, F.lit(at)).otherwise(F.col("updated_at")), "state": F.when(ran, "recoverable").otherwise(F.col("state")),
    }).select(*COLUMNS)
