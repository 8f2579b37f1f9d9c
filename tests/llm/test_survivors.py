from tallyloom.llm.survivors import birthdate, contact, filled, golden_records, survivors

SCHEMA = "internal_uuid string, group_id string, contact_no string, birthdate_iso string, last_name string, source_type string, created_at string, updated_at string"


def record(uuid, contact_no=None, born=None, last=None, source="LOCAL", created="2024-01-01T00:00:00Z", updated="2024-01-01T00:00:00Z"):
    return (uuid, "clash", contact_no, born, last, source, created, updated)


def found(spark, groups, records):
    g = spark.createDataFrame(groups, "group_id long, internal_uuid string, contact_no string")
    return {(r.group_id, r.field_name): (r.internal_uuid, r.latest) for r in survivors(g, spark.createDataFrame(records, SCHEMA), [contact(), birthdate()]).collect()}


def test_priority_recency_and_usability(spark):
    records = [
        record("a", "0917-123-4567", "1990-02-30"), record("b", "0917 999 4567", "1990-02-28", source="IMPORT", updated="2025-01-01T08:00:00+08:00"), record("c", "1111111111", "1899-01-01", updated="2026-01-01T00:00:00Z"),
        record("d", "12345", "2024-01-02", updated="2026-01-01T00:00:00Z"), record("e", None, None), record("f", "09171234567", source="IMPORT", updated="2025-01-01T00:00:00.000000001Z"), record("g", "09171234568", source="IMPORT", updated="2025-01-01T00:00:00Z"),
    ]
    groups = [(1, x, None) for x in "aabcde"] + [(2, "f", None), (2, "g", None), (3, "e", None), (4, "missing", None), (None, "a", None), (5, None, None)]
    got = found(spark, groups, records)
    assert got == {(1, "contact_no"): ("a", False), (1, "birthdate_iso"): ("b", True), (2, "contact_no"): ("f", True)}


def test_ties_and_empty(spark):
    same = [record(x, "09171234567") for x in "xyz"]
    assert found(spark, [(1, x, None) for x in "zxy"], same) == {(1, "contact_no"): ("z", True)}
    assert found(spark, [], same) == {} and found(spark, [(1, "x", None)], []) == {}


def test_golden(spark):
    records = [record("a", None, "1990-01-01", "x" * 100_000, "IMPORT"), record("b", "09171234567", None, " ")]
    g = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "group_id long, internal_uuid string")
    rows = golden_records(g, spark.createDataFrame(records, SCHEMA), [contact(), birthdate(), filled("last_name")]).collect()
    assert len(rows) == 1 and rows[0].contact_no == "09171234567" and rows[0].birthdate_iso == "1990-01-01" and len(rows[0].last_name) == 100_000
