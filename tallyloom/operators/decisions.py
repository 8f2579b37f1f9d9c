"""Review decisions on matched pairs, applied and reset as batches over the tables of matches, records and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, blank_to_null
from .audit import details

# The decisions, and which side each of two deletes.
DECISIONS = ("RETAIN_A", "RETAIN_B", "RETAIN_BOTH", "DELETE_A_SOFT", "DELETE_B_SOFT", "DIFFERENT_PERSONS")
DELETED_SIDE = {"DELETE_A_SOFT": "a", "DELETE_B_SOFT": "b"}


@dataclass(frozen=True)
class Outcome:
    """Tables after a batch: matches, records and decisions as a whole, the audit rows of the batch, and refused requests with the reason."""

    matches: DataFrame
    records: DataFrame
    decisions: DataFrame
    audit: DataFrame
    refused: DataFrame


def _sides(asked: DataFrame, what: Column) -> DataFrame:
    """(internal_uuid, what): one row for each side of each pair."""
    sides = F.array(*(F.struct(F.col(f"record_{x}_uuid").alias("internal_uuid"), F.lit(x).alias("side")) for x in "ab"))
    return asked.withColumn("__s", F.explode(sides)).select(F.col("__s.internal_uuid"), what.alias("what"))


def _target() -> Column:
    """Whether a pair's decision deletes the side of the row."""
    out = F.lit(False)
    for decision, side in DELETED_SIDE.items():
        out = out | ((F.col("decision") == decision) & (F.col("__s.side") == side))
    return out


def _stamped(records: DataFrame, touched: DataFrame, status: str, deleted: Column, restored: Column, at: str) -> DataFrame:
    marked = records.join(touched, "internal_uuid", "left")
    hit, gone = F.col("what").isNotNull(), F.col("record_status") == "DELETED"
    now, back = hit & deleted & ~F.coalesce(gone, F.lit(False)), hit & restored & F.coalesce(gone, F.lit(False))
    values = {
        "deleted_at": F.when(now, F.lit(at)).when(back, None).otherwise(F.col("deleted_at")), "duplicate_status": F.when(hit, status).otherwise(F.col("duplicate_status")),
        "updated_at": F.when(hit, F.lit(at)).otherwise(F.col("updated_at")), "record_status": F.when(now, "DELETED").when(back, "ACTIVE").otherwise(F.col("record_status")),
    }
    return marked.withColumns(values).select(*records.columns)


def _matched(matches: DataFrame, requests: DataFrame, by: str, order: list[Column], check: Column) -> tuple[DataFrame, DataFrame]:
    """(sound requests with their match, refused ones with the reason); at places them in order."""
    sides = matches.select(F.col("match_id"), "pair_key", "record_a_uuid", "record_b_uuid").dropDuplicates(["match_id"]).withColumn("__m", F.lit(True))
    both = requests.withColumn("match_id", F.trim("match_id")).join(sides, "match_id", "left")
    reason = F.when(blank("match_id"), "match_id is required").when(check, "unknown decision").when(blank(by), F.lit(f"{by} is required")).when(F.col("__m").isNull(), "unknown match")
    both = both.withColumn("reason", reason)
    return both.where("reason is null").drop("reason", "__m"), both.where("reason is not null").select("match_id", "reason")


def applied(matches: DataFrame, records: DataFrame, decisions: DataFrame, requests: DataFrame, order: list[Column], at: str) -> Outcome:
    """Requests (match_id, decision, resolved_by, notes), in order, applied to all tables.

    A pair's last request stands as its one decision, an earlier one, in the batch or in ``decisions``, being kept as the
    audit's previous decision. Both records become RESOLVED, and every side that a request deletes is deleted, also if
    a later one of the batch decides otherwise, as only a reset restores. decisions has (pair_key, record_a_uuid,
    record_b_uuid, decision, resolved_by, resolved_at, notes). Audit details name a note without its text.
    """
    asked, refused = _matched(matches, requests, "resolved_by", order, ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)))
    old = decisions.select("pair_key", F.col("decision").alias("__old"))
    w = Window.partitionBy("pair_key").orderBy(*order)
    placed = asked.join(old, "pair_key", "left").withColumns({"previous_decision": F.coalesce(F.lag("decision").over(w), "__old"), "__k": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("pair_key"))})
    last = placed.where("__k = __n").select("pair_key", "record_a_uuid", "record_b_uuid", "decision", F.trim("resolved_by").alias("resolved_by"), F.lit(at).alias("resolved_at"), blank_to_null("notes").alias("notes"))
    now = decisions.join(last.select("pair_key"), "pair_key", "left_anti").unionByName(last.select(*decisions.columns))
    touched = _sides(asked, _target()).groupBy("internal_uuid").agg(F.max("what").alias("what"))
    kept = _stamped(records, touched, "RESOLVED", F.col("what"), F.lit(False), at)
    status = F.when(F.col("__hit"), "RESOLVED").otherwise(F.col("decision_status"))
    after = matches.join(asked.select("match_id").distinct().withColumn("__hit", F.lit(True)), "match_id", "left").withColumn("decision_status", status).select(*matches.columns)
    gone = F.when(F.col("decision") == "DELETE_A_SOFT", F.col("record_a_uuid")).when(F.col("decision") == "DELETE_B_SOFT", F.col("record_b_uuid"))
    said = details(match_id="match_id", pair_key="pair_key", decision="decision", previous_decision="previous_decision", soft_deleted_internal_uuid=gone, notes=F.when(~blank("notes"), F.lit("[redacted]")))
    action = F.when(F.col("previous_decision").isNull(), "DEDUP_DECISION_APPLIED").otherwise("DEDUP_DECISION_RECOMPUTED")
    audit = placed.select(action.alias("action"), F.col("match_id").alias("entity_id"), F.trim("resolved_by").alias("performed_by"), said.alias("details"), F.lit(at).alias("created_at"))
    return Outcome(after, kept, now, audit, refused)


def reset(matches: DataFrame, records: DataFrame, decisions: DataFrame, requests: DataFrame, at: str) -> Outcome:
    """Requests (match_id, reset_by, notes) to take decisions back: the match is PENDING, its records are POSSIBLE_DUPLICATE, and the side that the decision deleted is ACTIVE again.

    The decision's row stays, for the next one to name as previous. A request for a pair without a decision is refused.
    """
    asked, refused = _matched(matches, requests, "reset_by", [], F.lit(False))
    both = asked.join(decisions.select("pair_key", "decision"), "pair_key", "left")
    refused = refused.unionByName(both.where("decision is null").select("match_id", F.lit("no decision to reset").alias("reason")))
    both = both.where("decision is not null")
    touched = _sides(both, _target()).groupBy("internal_uuid").agg(F.max("what").alias("what"))
    kept = _stamped(records, touched, "POSSIBLE_DUPLICATE", F.lit(False), F.col("what"), at)
    status = F.when(F.col("__hit"), "PENDING").otherwise(F.col("decision_status"))
    after = matches.join(both.select("match_id").distinct().withColumn("__hit", F.lit(True)), "match_id", "left").withColumn("decision_status", status).select(*matches.columns)
    said = details(match_id="match_id", pair_key="pair_key", decision="decision", notes=F.when(~blank("notes"), F.lit("[redacted]")))
    audit = both.select(F.lit("DEDUP_DECISION_RESET").alias("action"), F.col("match_id").alias("entity_id"), F.trim("reset_by").alias("performed_by"), said.alias("details"), F.lit(at).alias("created_at"))
    return Outcome(after, kept, decisions, audit, refused)
