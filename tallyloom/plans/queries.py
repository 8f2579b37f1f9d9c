"""Queries of the core operators. Each reads whole tables; its SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import birth_error, birth_iso
from ..functions.similarity import hamming_score, jaro_winkler_score, levenshtein_score
from ..operators import audit, decisions, geography, jobs, matching, ranking, records, state
from ..operators.durable import durable
from ..sources import export, raw_records
from . import importer, oracles

FLAGSHIP = "er_scored_matches"
NOW = "2026-07-01T00:00:00Z"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _geography(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, x) for x in ("regions", "provinces", "cities", "barangays")]


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    geography_of = {f"{x}_code": t for x, t in zip(geography.LEVELS, _geography(spark, d))}
    return raw_records.load_records(table(spark, d, "raw_lines"), geography_of)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).where("reason is not null").select("line_id", "reason")


def p7_file_report(spark: SparkSession, d: str) -> DataFrame:
    return raw_records.file_report(_loaded(spark, d))


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).where("reason is null").select("line_id", "layout", "record.*")


# ER: entity resolution


def er_blocking_keys(spark: SparkSession, d: str) -> DataFrame:
    return matching.comparable(table(spark, d, "beneficiaries")).select("internal_uuid", F.explode(matching.blocking_keys()).alias("block_key"))


def er_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.candidate_pairs(matching.comparable(table(spark, d, "beneficiaries")))


def er_scored_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.ordered(matching.matches(table(spark, d, "beneficiaries")))


def er_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return matching.run_totals(table(spark, d, "beneficiaries"))


def er_run_rows(spark: SparkSession, d: str) -> DataFrame:
    found = matching.matches(table(spark, d, "beneficiaries")).select("pair_key", "total_score")
    return matching.numbered(found, "run-1").select("match_id", "run_id", "pair_key", "total_score", "decision_status")


def er_hide_decided(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "scored_pairs")
    return matching.without_decided(pairs.where("decision_status = 'PENDING'"), pairs.where("decision_status = 'RESOLVED' and pair_key is not null")).select("match_id", "run_id", "pair_key")


def er_group_scores(spark: SparkSession, d: str) -> DataFrame:
    """Component scores of all pairs that reviewers put together."""
    g = table(spark, d, "reviewed_groups").distinct()
    a, b = g.alias("a"), g.alias("b")
    pairs = a.join(b, F.col("a.group_id") == F.col("b.group_id")).where("a.internal_uuid < b.internal_uuid").select(F.col("a.internal_uuid").alias("uuid_a"), F.col("b.internal_uuid").alias("uuid_b")).distinct()
    return matching.scored(matching.with_fields(pairs, matching.comparable(table(spark, d, "beneficiaries"), include_deleted=True)))


# SIM: similarities of what partners typed and the norm columns of the person's own list


def sim_names(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "partner_register").where("last_name is not null and first_name is not null").select(F.upper("last_name").alias("a"), F.upper("first_name").alias("b")).distinct()
    return df.select("a", "b", levenshtein_score("a", "b").alias("levenshtein"), hamming_score("a", "b").alias("hamming"), jaro_winkler_score("a", "b").alias("jaro_winkler"))


# GEO


def geo_chains(spark: SparkSession, d: str) -> DataFrame:
    return geography.chains(*_geography(spark, d))


def geo_path(spark: SparkSession, d: str) -> DataFrame:
    return geography.path_of(*_geography(spark, d))


def geo_children(spark: SparkSession, d: str) -> DataFrame:
    return geography.children(table(spark, d, "cities"), "city", "province").select("city_code", "city_name", "province_code")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return durable(geography.chains(*_geography(spark, d)), "chains")


def geo_aliases(spark: SparkSession, d: str) -> DataFrame:
    return geography.region_aliases(table(spark, d, "regions"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return geography.normalize(table(spark, d, "import_rows"), _catalog(spark, d), geo_aliases(spark, d))


def geo_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select(*geography.LEVELS, "barangay_code", "status", "match_source", F.round("confidence", 9).alias("confidence"), "reason")


def geo_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = geography.candidates(table(spark, d, "import_rows"), _catalog(spark, d), geo_aliases(spark, d))
    return found.select(*geography.LEVELS, "place", F.round("score", 9).alias("score"), "barangay_code")


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    return geography.exact_resolver(table(spark, d, "import_rows"), _catalog(spark, d))


def geo_exact_resolver(spark: SparkSession, d: str) -> DataFrame:
    return _legacy(spark, d).select(*geography.LEVELS, *(f"{x}_code" for x in geography.LEVELS), "error")


def geo_shadow_totals(spark: SparkSession, d: str) -> DataFrame:
    return geography.shadow_totals(geography.shadow(_normalized(spark, d), _legacy(spark, d)))


def _backfill(spark: SparkSession, d: str) -> DataFrame:
    return geography.backfill(table(spark, d, "beneficiaries"), _catalog(spark, d), geo_aliases(spark, d), NOW)


def geo_backfill(spark: SparkSession, d: str) -> DataFrame:
    return _backfill(spark, d).select("internal_uuid", "status", "match_source", F.round("confidence", 9).alias("confidence"), "reason", "resolved_barangay_code", "updated")


def geo_backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    return geography.backfill_counts(_backfill(spark, d))


def geo_lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = geography.lineage(_backfill(spark, d), "backfill-1", [F.col(c) for c in state.LIST_ORDER])
    return rows.select("row_number", "item_reference", "raw_barangay", "resolved_barangay_code", "status", "needs_review")


def geo_parent_faults(spark: SparkSession, d: str) -> DataFrame:
    return geography.parent_faults(dict(zip(geography.LEVELS, _geography(spark, d))))


def geo_chain_fault(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the code chains of the legacy package layout."""
    return geography.chain_fault(table(spark, d, "partner_register"), *_geography(spark, d)).select("partner_row", F.col("chain_fault").alias("fault"))


def geo_shadow(spark: SparkSession, d: str) -> DataFrame:
    drift = geography.shadow(_normalized(spark, d), _legacy(spark, d))
    return drift.groupBy(F.concat_ws(",", "drift_fields").alias("drift")).agg(F.count(F.lit(1)).alias("chains"))


def geo_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return geography.ingest_counts(table(spark, d, "beneficiaries"))


def geo_ingest_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return geography.distinct_by_code(table(spark, d, "beneficiaries"), "barangay", ["city_code", "barangay_name"])


# REC


def rec_text_keys(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "import_rows")
    return df.select(
        "row_id", text.location_key("barangay").alias("barangay_key"), text.lookup_key(F.coalesce("province", F.lit(""))).alias("province_key"), text.digits(F.coalesce("contact_no", F.lit(""))).alias("contact_digits"),
        text.basename("source_reference").alias("file"), text.full_name("last_name", "first_name", "middle_name", "extension_name").alias("full_name"), text.padded_id("row_id").alias("made_id"),
        text.with_provenance("source_reference", "id").alias("provenance"), text.whole_number("year_yyyy")["value"].alias("year"), text.whole_number("year_yyyy")["bad"].alias("year_bad"),
    )


def rec_birth(spark: SparkSession, d: str) -> DataFrame:
    m, dd, y = F.col("birth_month"), F.col("birth_day"), F.col("birth_year")
    return table(spark, d, "new_beneficiaries").select("internal_uuid", birth_iso(F.col("birthdate_iso"), m, dd, y).alias("birth"), birth_error(F.col("birthdate_iso"), m, dd, y).alias("error"))


def rec_validate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "new_beneficiaries").unionByName(table(spark, d, "beneficiaries"), allowMissingColumns=True)
    return df.select("internal_uuid", records.validation_error().alias("error")).where("error is not null")


def rec_normalize(spark: SparkSession, d: str) -> DataFrame:
    return records.normalized(table(spark, d, "beneficiaries")).select("internal_uuid", "last_name", "first_name", "middle_name", "norm_last_name", "norm_first_name", "contact_no_norm", "birthdate_iso", "sex", "contact_no", "birth_year")


def rec_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return records.exact_duplicates(table(spark, d, "new_beneficiaries"), table(spark, d, "beneficiaries"))


def rec_candidates(spark: SparkSession, d: str) -> DataFrame:
    return records.duplicate_candidates(table(spark, d, "new_beneficiaries"), table(spark, d, "beneficiaries"))


def rec_precheck(spark: SparkSession, d: str) -> DataFrame:
    return records.precheck(table(spark, d, "new_beneficiaries"), table(spark, d, "beneficiaries"))


def rec_page_total(spark: SparkSession, d: str) -> DataFrame:
    return state.where_filled(table(spark, d, "beneficiaries"), record_status="ACTIVE", source_type="IMPORT").agg(F.count(F.lit(1)).alias("total"))


def rec_created(spark: SparkSession, d: str) -> DataFrame:
    drafts = _drafts(spark, d).withColumns({c: F.lit(None).cast("string") for c in records.DEFAULTS})
    made = records.created(drafts, table(spark, d, "beneficiaries"), [F.col("n")], NOW)
    return made.select("internal_uuid", "last_name", "norm_first_name", "sex", *records.DEFAULTS, "created_at")


def rec_list_page(spark: SparkSession, d: str) -> DataFrame:
    rows = state.where_filled(table(spark, d, "beneficiaries"), record_status="ACTIVE", source_type="IMPORT", city_code="")
    return ranking.page(rows, state.list_order(), 50, 100).select("internal_uuid", "last_name", "first_name")


def rec_search(spark: SparkSession, d: str) -> DataFrame:
    return state.search(table(spark, d, "beneficiaries"), "ROSAR%O").select("internal_uuid", "last_name", "first_name", "city_name")


# IMP


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "new_beneficiaries").withColumn("n", F.col("batch_no") * 10_000_000 + F.col("row_no"))


def imp_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return importer.dispositions(_drafts(spark, d), table(spark, d, "beneficiaries"), [F.col("n")]).select("internal_uuid", "disposition", "message")


def imp_counters(spark: SparkSession, d: str) -> DataFrame:
    return importer.counters(importer.dispositions(_drafts(spark, d), table(spark, d, "beneficiaries"), [F.col("n")]), ["batch_no"])


def imp_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_rows").withColumn("file", F.regexp_replace("source_reference", "#row=.*$", ""))
    return importer.preview(rows, ["file"], "row_id", importer.public_draft_error()).withColumn("sample_errors", F.concat_ws("; ", "sample_errors"))


def imp_repeated(spark: SparkSession, d: str) -> DataFrame:
    return importer.repeated_imports(table(spark, d, "import_logs"))


def imp_location_outcome(spark: SparkSession, d: str) -> DataFrame:
    df = _normalized(spark, d).withColumn("outcome", importer.location_outcome(F.col("confidence"), F.col("status"), F.col("barangay_code").isNotNull()))
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("chains"))


def _public(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_rows")
    drafts = importer.public_drafts(rows, _normalized(spark, d))
    return importer.dispositions(drafts, table(spark, d, "beneficiaries"), [F.col("row_id")], F.col("draft_error"), F.col("needs_review"))


def imp_public(spark: SparkSession, d: str) -> DataFrame:
    return _public(spark, d).select("row_id", "disposition", "message", "barangay_code")


def imp_ledger(spark: SparkSession, d: str) -> DataFrame:
    return importer.ledger(_public(spark, d), "run-1", "row_id").select("row_number", "raw_barangay", "resolved_barangay_code", "match_source", "status", F.round("confidence", 9).alias("confidence"))


def imp_run_counts(spark: SparkSession, d: str) -> DataFrame:
    done = durable(_public(spark, d), "public")
    return importer.run_counts(done, importer.ledger(done, "run-1", "row_id"))


def imp_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The logs that a repeated commit of any finished import would return."""
    logs = table(spark, d, "import_logs")
    return importer.idempotent(logs, logs.where("status = 'SUCCEEDED'")).select("import_id", "status")


def imp_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = _drafts(spark, d).withColumn("generated_id", F.when(F.col("row_no") % 3 == 0, F.col("generated_id")))
    return records.allocate_ids(wanted, table(spark, d, "beneficiaries"), [F.asc("n")]).select("internal_uuid", "generated_id", "source_reference")


# Decisions of reviewers, made up from the resolved pairs


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "scored_pairs").where("pair_key is not null and decision_status = 'RESOLVED' and match_id is not null")
    matches = durable(rows.groupBy("match_id").agg(*(F.min(c).alias(c) for c in ("pair_key", "record_a_uuid", "record_b_uuid", "decision_status"))), "matches")
    last = F.right("match_id", F.lit(1))
    decision = F.when(last.isin("1", "5"), "DELETE_A_SOFT").when(last == "2", "DELETE_B_SOFT").otherwise("RETAIN_BOTH")
    return matches, matches.select("match_id", decision.alias("decision"), F.lit("reviewer").alias("resolved_by"), F.lit("seen").alias("notes"))


_DECIDED = "pair_key string, record_a_uuid string, record_b_uuid string, decision string, resolved_by string, resolved_at string, notes string"


def _applied(spark: SparkSession, d: str) -> decisions.Outcome:
    matches, asked = _asked(spark, d)
    return decisions.applied(matches, table(spark, d, "beneficiaries"), spark.createDataFrame([], _DECIDED), asked, [F.col("match_id")], NOW)


def er_decided_records(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).records.select("internal_uuid", "record_status", "duplicate_status", "deleted_at")


def er_decided_audit(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).audit.select("entity_id", "action", F.get_json_object("details", "$.previous_decision").alias("previous"))


def er_reset_records(spark: SparkSession, d: str) -> DataFrame:
    first = _applied(spark, d)
    asked = first.matches.select("match_id", F.lit("reviewer").alias("reset_by"), F.lit(None).cast("string").alias("notes"))
    return decisions.reset(first.matches, first.records, durable(first.decisions, "decisions"), asked, NOW).records.select("internal_uuid", "record_status", "duplicate_status")


# EXP


def exp_log(spark: SparkSession, d: str) -> DataFrame:
    log = export.export_log(export.export_rows(export.exportable(table(spark, d, "beneficiaries"))), "/srv/out/people.csv", "exp-1", NOW, "clerk")
    return log.select("export_id", "file_name", "export_type", "rows_exported")


def exp_rows(spark: SparkSession, d: str) -> DataFrame:
    return export.export_rows(export.exportable(table(spark, d, "beneficiaries")))


# ST


def st_upsert(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "scored_pairs").where("pair_key is not null").select("pair_key", "match_id", "run_id", "total_score", "decision_status", "created_at")
    order = [F.desc("created_at"), F.desc("match_id")]
    return state.upsert(pairs.limit(0), pairs.distinct(), "pair_key", order)


def st_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The pairs still open, with those that were resolved upserted over them."""
    pairs = table(spark, d, "scored_pairs").where("pair_key is not null").select("pair_key", "run_id", "decision_status")
    base = pairs.where("decision_status = 'PENDING'").groupBy("pair_key").agg(F.max("run_id").alias("run_id"))
    return state.upsert(base, pairs.where("decision_status = 'RESOLVED'").select("pair_key", "run_id"), "pair_key", [F.desc("run_id")])


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Imports as jobs: each status as a state, all at their first attempt and at 40 percent."""
    status = F.when(F.col("status") == "PARTIAL", "running").when(F.col("status") == "FAILED", "recoverable").when(F.col("status") == "RESUMED", "queued").otherwise("succeeded")
    return table(spark, d, "import_logs").select(F.col("import_id").alias("job_id"), status.alias("state"), F.col("started_at").alias("updated_at"), F.lit(1).alias("attempt"), F.lit(40.0).alias("progress"), F.lit("").alias("message"), F.lit(None).cast("string").alias("error_code"))


def st_jobs(spark: SparkSession, d: str) -> DataFrame:
    now = _jobs(spark, d)
    step = now.select("job_id", F.when(F.col("state") == "running", "succeeded").otherwise("running").alias("next"), F.lit(None).cast("double").alias("progress"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("error_code"))
    return jobs.moved(now, step, NOW)[0].select("job_id", "state", "attempt", "progress")


def st_recovered(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recovered(_jobs(spark, d), NOW).select("job_id", "state")


def st_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "reviewed_groups").select("internal_uuid")
    done = state.soft_delete(table(spark, d, "beneficiaries"), gone, "2026-07-01T00:00:00Z")
    return done.groupBy("record_status").agg(F.count(F.lit(1)).alias("n"), F.max("deleted_at").alias("last_deleted"))


def st_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event type of a user may follow the one before it."""
    steps = [("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"), ("login", "view")]
    df = state.transitions(table(spark, d, "events"), steps, "user_id", "event_type", [F.asc("ts"), F.asc("event_id")])
    return df.groupBy("previous", "event_type", "allowed").agg(F.count(F.lit(1)).alias("n"))


def dash_counts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "beneficiaries").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("record_status"), F.lit("")) != "DELETED").alias("active"))
    return df.withColumn("deleted", F.col("total") - F.col("active"))


def hist_latest(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest imports of each operator."""
    w = Window.partitionBy("operator_name").orderBy(F.desc_nulls_last("started_at"), "import_id")
    return table(spark, d, "import_logs").withColumn("place", F.row_number().over(w)).where("place <= 10").select("operator_name", "place", "import_id")


def hist_pages(spark: SparkSession, d: str) -> DataFrame:
    return state.pages_of(table(spark, d, "import_logs"), [F.desc_nulls_last("started_at"), F.asc("import_id")]).select("import_id", "page")


def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    page = ranking.page(table(spark, d, "import_logs"), [F.desc_nulls_last("started_at"), F.asc("import_id")], 500)
    return audit.client_filter(page, "encoder 1").select("import_id", "operator_name", "status")


def audit_scrub(spark: SparkSession, d: str) -> DataFrame:
    said = audit.details(file_path=F.concat(F.lit("/srv/in/"), "file_name"), remarks="remarks", source_reference="source_reference", who=F.concat(F.lit(" "), "operator_name", F.lit(" ")))
    return table(spark, d, "import_logs").select("import_id", audit.scrubbed_json(said).alias("details"))


_QUERIES = [
    p7_found, p7_file_report, p7_loaded, er_blocking_keys, er_candidate_pairs, er_scored_matches, er_run_totals, er_run_rows, er_hide_decided, er_group_scores, er_decided_records, er_decided_audit, er_reset_records, sim_names,
    geo_chains, geo_path, geo_children, geo_aliases, geo_normalize, geo_candidates, geo_exact_resolver, geo_shadow, geo_shadow_totals, geo_backfill, geo_backfill_counts, geo_lineage, geo_parent_faults, geo_chain_fault, geo_ingest_counts, geo_ingest_conflicts,
    rec_text_keys, rec_birth, rec_validate, rec_normalize, rec_exact_duplicates, rec_candidates, rec_precheck, rec_created, rec_list_page, rec_page_total, rec_search,
    imp_dispositions, imp_counters, imp_preview, imp_repeated, imp_location_outcome, imp_ids, imp_public, imp_ledger, imp_run_counts, imp_idempotent,
    exp_rows, exp_log, st_upsert, st_overlay, st_soft_delete, st_transitions, st_jobs, st_recovered, dash_counts, hist_latest, hist_pages, audit_filter, audit_scrub,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
