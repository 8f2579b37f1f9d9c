"""Queries of the operators in this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.durable import durable
from . import groups, history, leakage, linkage, lookalikes, packing, places, survivors, variants


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(_table(spark, d, "scored_pairs"))


GOLDEN = ("last_name", "first_name", "middle_name", "extension_name", "sex", "barangay_code")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The cases: groups in which the most trusted usable value is also the latest."""
    rows = survivors.survivors(_table(spark, d, "reviewed_groups"), _table(spark, d, "beneficiaries"), [survivors.contact(), survivors.birthdate()])
    return rows.where("latest").select("group_id", "field_name", "internal_uuid")


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    attributes = [survivors.contact(), survivors.birthdate(), *map(survivors.filled, GOLDEN)]
    return survivors.golden_records(_table(spark, d, "reviewed_groups"), _table(spark, d, "beneficiaries"), attributes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_persons(_table(spark, d, "beneficiaries"), _table(spark, d, "new_beneficiaries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.link(_table(spark, d, "beneficiaries"), _table(spark, d, "partner_register"), "internal_uuid", "partner_row")
    return linkage.matches(pairs).select("internal_uuid", "partner_row")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.name_variants(_table(spark, d, "beneficiaries")).select("uuid_a", "uuid_b")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    geography = tuple(_table(spark, d, x) for x in ("regions", "provinces", "cities", "barangays"))
    return places.map_places(_table(spark, d, "import_rows").select("row_id", "region", "province", "city_municipality", "barangay"), geography)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).where("not exact").select("row_id", "barangay_code")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"))


#: Limits of which each binds on some texts: a few long ones reach the attention cost, many short ones the documents.
BINDING = packing.Limits(tokens=2048, documents=8, attention=2048 * 2048 // 4, weights=(1.0, 0.3, 0.3))


def p8_vector(spark: SparkSession, d: str) -> DataFrame:
    """The documents packed under three binding limits, with the check of all constraints."""
    documents = _table(spark, d, "documents")
    return packing.checked(documents, durable(packing.pack(documents, BINDING), "packed"), BINDING)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_table(spark, d, "eval_items"), _table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_pairs(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_golden": p4_golden, "p5_found": p5_found, "p6_found": p6_found, "p8_packed": p8_packed, "p8_vector": p8_vector, "p9_found": p9_found, "p10_found": p10_found}


_P4 = """
            with members as (select distinct group_id, internal_uuid from reviewed_groups where group_id is not null),
            timed as (
              select *, case upper(trim(source_type)) when 'LOCAL' then 2 when 'IMPORT' then 1 else 0 end p,
                     epoch(strptime(updated_at[1:19], '%Y-%m-%dT%H:%M:%S'))
                       - case when updated_at like '%Z' then 0 else (case when updated_at[-6] = '-' then -60 else 60 end) * (60 * updated_at[-5:-4]::int + updated_at[-2:]::int) end secs,
                     rpad(regexp_extract(updated_at, '[.]([0-9]+)', 1), 9, '0')::bigint nanos,
                     regexp_replace(coalesce(contact_no, ''), '[^0-9]', '', 'g') digits,
                     try_strptime(case when regexp_full_match(birthdate_iso, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then birthdate_iso end, '%Y-%m-%d')::date born,
                     (try_strptime(created_at[1:19], '%Y-%m-%dT%H:%M:%S')
                       - case when created_at like '%Z' then interval 0 minute else to_minutes((case when created_at[-6] = '-' then -1 else 1 end) * (60 * created_at[-5:-4]::int + created_at[-2:]::int)) end)::date created
              from members join beneficiaries using (internal_uuid)),
            fields as (
              select group_id, internal_uuid, p, secs, nanos, 'contact_no' field_name, contact_no as value from timed
              where length(digits) >= 10 and replace(digits, digits[1], '') <> ''
              union all
              select group_id, internal_uuid, p, secs, nanos, 'birthdate_iso', birthdate_iso from timed where born > date '1900-01-01' and born <= created
              """ + "".join(f"union all select group_id, internal_uuid, p, secs, nanos, '{x}', {x} from timed where trim({x}) <> '' " for x in GOLDEN) + ")"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            with recursive named as (
              select list_distinct(list_filter([regexp_replace(lower(coalesce(record_a_uuid, '')), '[^0-9a-f]', '', 'g'), regexp_replace(lower(coalesce(record_b_uuid, '')), '[^0-9a-f]', '', 'g'), regexp_replace(lower(coalesce(split_part(pair_key, '|', 1), '')), '[^0-9a-f]', '', 'g'), regexp_replace(lower(coalesce(split_part(pair_key, '|', 2), '')), '[^0-9a-f]', '', 'g')], lambda x: x <> '')) m
              from scored_pairs),
            links as (select m[1] a, unnest(m) b from named where len(m) > 0),
            edges as (select a, b from links union select b, a from links),
            reach(node, seen) as (select a, a from edges union select e.b, r.seen from reach r join edges e on e.a = r.node),
            least as (select node, min(seen) g from reach group by node)
            select g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] as group_uuid,
                   node[1:8] || '-' || node[9:12] || '-' || node[13:16] || '-' || node[17:20] || '-' || node[21:32] as internal_uuid
            from least""",
        "p4_found": _P4 + """
            select group_id, field_name, internal_uuid from (
              select *, row_number() over (partition by group_id, field_name order by p desc, secs desc, nanos desc, internal_uuid desc) k,
                     rank() over (partition by group_id, field_name order by secs desc, nanos desc) latest from fields)
            where k = 1 and latest = 1 and field_name in ('contact_no', 'birthdate_iso')""",
        "p8_vector": "select count(*) documents, 0 cut_below, 0 over_tokens, 0 over_documents, 0 over_attention from documents",
        "p4_golden": _P4 + """
            , best as (select * from (
              select *, row_number() over (partition by group_id, field_name order by p desc, secs desc, nanos desc, internal_uuid desc) k from fields) where k = 1)
            select group_id, """ + ", ".join(f"max(case when field_name = '{x}' then value end) as {x}" for x in ("contact_no", "birthdate_iso", *GOLDEN)) + """
            from best group by group_id""",
    }
