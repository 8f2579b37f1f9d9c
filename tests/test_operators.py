import hashlib
import io
import json
import random
import zipfile
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, decisions, geography, jobs, matching, ranking, records, skew, state
from tallyloom.plans import importer
from tallyloom.schemas import LEGACY_COLUMNS, PERSON_COLUMNS, PUBLIC_COLUMNS
from tallyloom.sources import exchange, export
from tallyloom.streaming import ingest

LONG = {"birth_month", "birth_day", "birth_year"}
SCHEMA = ", ".join(f"{c} {'long' if c in LONG else 'string'}" for c in PERSON_COLUMNS)


def person(uuid, **given):
    base = dict.fromkeys(PERSON_COLUMNS) | {
        "internal_uuid": uuid, "generated_id": f"G-{uuid}", "last_name": "Smith", "first_name": "John", "middle_name": "M", "region_code": "01", "province_code": "0101", "city_code": "010101", "barangay_code": "010101001",
        "region_name": "R", "province_name": "P", "city_name": "C", "barangay_name": "B", "birth_month": 1, "birth_day": 1, "birth_year": 1990, "birthdate_iso": "1990-01-01", "sex": "M", "record_status": "ACTIVE", "duplicate_status": "CLEAR", "source_type": "LOCAL",
        "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z",
    }
    base |= given
    for c in ("last_name", "first_name", "middle_name", "extension_name"):
        if base[f"norm_{c}"] is None and base[c] is not None:
            base[f"norm_{c}"] = base[c].upper()
    return tuple(base[c] for c in PERSON_COLUMNS)


def people(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_matching(spark):
    same = people(spark, [person(x) for x in "cab"])
    assert [r.pair_key for r in matching.ordered(matching.matches(same)).collect()] == ["a|b", "a|c", "b|c"]
    assert matching.run_totals(same).first() == (3, 3)
    rows = people(spark, [person("a"), person("b", first_name="Jon"), person("d", record_status="DELETED")])
    assert matching.run_totals(rows, 100).first() == (1, 0)
    rows = people(spark, [person("a"), person("d", record_status="DELETED")])
    assert matching.run_totals(rows, 100, include_deleted=True).first() == (1, 1)
    apart = people(spark, [person("a", last_name="Alpha", first_name="Bea"), person("b", last_name="Zulu", first_name="Max", birth_year=1980, birthdate_iso="1980-01-01", barangay_code="02")])
    assert matching.candidate_pairs(matching.comparable(apart)).count() == 0
    keys = matching.comparable(people(spark, [person("a")])).select(matching.blocking_keys()).first()[0]
    assert keys == ["B|010101001|1990", "C|010101|J", "C|010101|S", "N|SMI|JOH"]
    r = matching.matches(people(spark, [person("a"), person("b", birthdate_iso=None, birth_year=None, birth_month=None, birth_day=None, barangay_code="9")]), 1).first()
    assert (r.birthdate_compare, r.barangay_compare) == (None, 2)
    assert matching.matches(people(spark, [])).count() == 0
    for bad in (float("nan"), -1, 101):
        with pytest.raises(ValueError):
            matching.threshold_of(bad)
    assert matching.threshold_of(0) == matching.threshold_of(None) == 90


def test_candidates_against_plain_blocks(spark):
    rng = random.Random(4)
    rows = [person(f"{i:03d}", last_name=rng.choice(["", "Ab", "Abcd", "Xyz"]), first_name=rng.choice(["Q", "Abe", "Zed"]), city_code=rng.choice(["1", "2", ""]), barangay_code=rng.choice(["7", "8", None]), birth_year=rng.choice([1990, None])) for i in range(120)]
    fields = matching.comparable(people(spark, rows))
    keys = {r.internal_uuid: set(r.k) for r in fields.select("internal_uuid", matching.blocking_keys().alias("k")).collect()}
    want = {(a, b) for a, b in combinations(sorted(keys), 2) if keys[a] & keys[b]}
    got = [(r.uuid_a, r.uuid_b) for r in matching.candidate_pairs(fields).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    full = matching.scored(matching.with_fields(matching.candidate_pairs(fields), fields)).where("total_score >= 90")
    assert {r.pair_key for r in full.collect()} == {r.pair_key for r in matching.matches(people(spark, rows)).collect()}


def test_numbering_and_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r.x: r.n for r in ranking.global_row_number(df, [F.desc("x")], "n").collect()}
    assert got == {x: 1000 - x for x in range(1000)}
    assert [r.x for r in ranking.page(df, [F.asc("x")], 3, 5).collect()] == [5, 6, 7]
    assert ranking.page_size(0) == 50 and ranking.page_size(9999) == 500 and ranking.page_size(-1, 25) == 25
    with pytest.raises(ValueError):
        ranking.page(df, [F.asc("x")], 1, -1)


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(900).select(F.when(F.col("id") < 600, 1).when(F.col("id") < 610, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "hot"), (700, "cold")], "k long, v string")
    got = skew.lookup_join(left, right, "k", hot_rows=100)
    assert got.count() == 900 and got.where("v = 'hot'").count() == 600 and got.where("v = 'cold'").count() == 1


R, P, C, B = [("01", "Region One")], [("0101", "01", "Alpha Province"), ("0102", "01", "Beta Province")], [("010101", "01", "0101", "Santa Cruz City"), ("010102", "01", "0101", "San Jose City"), ("010201", "01", "0102", "San Jose City")], [("010101001", "01", "0101", "010101", "Sto. Niño"), ("010102001", "01", "0101", "010102", "Poblacion"), ("010201001", "01", "0102", "010201", "Poblacion")]


def catalog(spark):
    return geography.chains(spark.createDataFrame(R, "region_code string, region_name string"), spark.createDataFrame(P, "province_code string, region_code string, province_name string"), spark.createDataFrame(C, "city_code string, region_code string, province_code string, city_name string"), spark.createDataFrame(B, "barangay_code string, region_code string, province_code string, city_code string, barangay_name string"))


def test_geography(spark):
    chains = catalog(spark)
    aliases = geography.region_aliases(spark.createDataFrame([("01", "Region One"), ("02", "Region II (Beta)"), ("03", "Region III")], "region_code string, region_name string"))
    typed = [("01", "0101", "010101", "010101001"), ("Region One", "Alpha Provnce", "Santa Cruz Cty", "Sto Nino"), ("one", "alpha province", "Santa Cruz City", "sto. niño"), ("Region One", "", "San Jose City", "Poblacion"), ("01", "0101", "010201", "010201001"), ("", None, " ", "???"), (None, None, None, None)]
    rows = spark.createDataFrame(typed, "region string, province string, city_municipality string, barangay string")
    got = {(r.region, r.province, r.city, r.barangay): r for r in geography.normalize(rows, chains, aliases).collect()}
    assert len(got) == 7
    r = got["01", "0101", "010101", "010101001"]
    assert (r.status, r.match_source, r.confidence) == ("AUTO_APPLIED", "EXACT", 1.0)
    r = got["Region One", "Alpha Provnce", "Santa Cruz Cty", "Sto Nino"]
    assert (r.status, r.match_source, r.barangay_name) == ("AUTO_APPLIED", "FUZZY", "Sto. Niño") and r.confidence >= 0.95
    assert got["one", "alpha province", "Santa Cruz City", "sto. niño"].match_source == "EXACT"
    assert got["Region One", "", "San Jose City", "Poblacion"].reason == "ambiguous location candidates"
    assert got["01", "0101", "010201", "010201001"].status == "REVIEW_NEEDED"
    assert got["", "", "", "???"].reason == got["", "", "", ""].reason == "no location candidate matched"
    legacy = geography.exact_resolver(rows, chains)
    errors = {(x.region, x.province, x.city, x.barangay): (x.barangay_code, x.error) for x in legacy.collect()}
    assert errors["01", "0101", "010101", "010101001"] == ("010101001", None)
    assert errors["Region One", "", "San Jose City", "Poblacion"] == (None, "city is ambiguous")
    drift = geography.shadow(geography.normalize(rows.limit(2), chains, aliases), geography.exact_resolver(rows.limit(2), chains)).collect()
    assert sorted(x.drift_fields for x in drift) == [[], ["apply_state"]]
    assert {r.alias for r in aliases.where("region_name like '%Beta%'").collect()} == {"02", "region ii (beta)", "ii (beta)", "ii(beta)"}
    assert {r.alias for r in aliases.where("region_name = 'Region III'").collect()} == {"03", "region iii", "iii"}
    assert [r.place for r in geography.candidates(rows.limit(2), chains, aliases, geography.Options(candidates=1)).collect()] == [1]
    with pytest.raises(ValueError):
        geography.Options(threshold=2)


def test_ingest(spark):
    schema = ", ".join(f"{x}_{y} string" for x in geography.LEVELS for y in ("code", "name"))
    rows = [("01", "R", "0101", "P", "010101", "C", "01010100" + str(k), f"B{k}") for k in (1, 2, 1)]
    df = spark.createDataFrame(rows, schema)
    assert {x: d.count() for x, d in geography.ingest(df).items()} == {"region": 1, "province": 1, "city": 1, "barangay": 2}
    assert geography.ingest_counts(df).first() == (3, 1, 1, 1, 2, 1)
    for bad in ([*rows, ("01", "R", "0101", "P", "010101", "Other", "010101009", "B")], [*rows, ("01", "", "0101", "P", "010101", "C", "010101009", "B")], []):
        with pytest.raises(ValueError):
            geography.ingest(spark.createDataFrame(bad, schema))


def test_records_and_import(spark):
    store = people(spark, [person("s", contact_no_norm="1"), person("t", source_reference="f#row=1", last_name="Else")])
    drafts = people(spark, [person("a", contact_no_norm="1"), person("b", last_name="New"), person("c", last_name="New"), person("d", last_name=" "), person("e", last_name="X", source_reference="f#row=1"), person("f", last_name="Y", source_reference="g"), person("g", last_name="Z", source_reference="g"), person("h", last_name="Q", birthdate_iso="1990-02-30")])
    got = {r.internal_uuid: (r.disposition, r.message) for r in importer.dispositions(drafts, store, [F.col("internal_uuid")]).collect()}
    assert got["a"] == got["c"] == ("skipped", "exact duplicate") and got["b"][0] == got["f"][0] == "inserted" and got["d"] == ("failed", "last_name is required")
    assert got["e"] == got["g"] == ("skipped", "source_reference exists") and got["h"][0] == "failed"
    done = importer.dispositions(drafts.withColumn("one", F.lit(1)), store, [F.col("internal_uuid")])
    assert importer.counters(done, ["one"]).first() == (1, 8, 2, 4, 2)
    assert records.exact_duplicates(drafts, store).collect() == [("a", "s")]
    assert {r.internal_uuid for r in records.duplicate_candidates(drafts, store).collect()} == {"a"}
    numbered = drafts.withColumn("n", F.ascii("internal_uuid") - 96)
    stamp = importer.normalization_stamp("v1", "abc")
    first = importer.commit(numbered, store, "n", "hash", stamp, budget=3)
    assert first.status == "PARTIAL" and first.rows.count() == 3
    rest = importer.commit(numbered, store, "n", "hash", stamp, token=first.token)
    assert rest.status == "RESUMED" and rest.rows.count() == 5
    with pytest.raises(ValueError):
        importer.commit(numbered, store, "n", "other", stamp, token=first.token)
    assert importer.dispositions(drafts.limit(0), store, [F.col("internal_uuid")]).count() == 0


def test_ids(spark):
    taken = spark.createDataFrame([("G-000001",), ("G-000003",), ("IMP-1",), (None,)], "generated_id string")
    rows = spark.createDataFrame([(1, "IMP-1", "row-1"), (2, "IMP-2", "row-2"), (3, "IMP-2", "row-3"), (4, None, None), (5, "G-000002", "row-5"), (6, " ", "row-6")], "n long, generated_id string, source_reference string")
    got = {r.n: (r.generated_id, r.source_reference) for r in records.allocate_ids(rows, taken, [F.asc("n")]).collect()}
    assert got[2] == ("IMP-2", "row-2") and got[5] == ("G-000002", "row-5")
    assert got[1] == ("G-000004", "row-1;source_generated_id=IMP-1") and got[3] == ("G-000005", "row-3;source_generated_id=IMP-2")
    assert got[4] == ("G-000006", None) and got[6] == ("G-000007", "row-6")


def test_state(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v long, w string")
    events = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v long, at long")
    got = {r.k: (r.v, r.w) for r in state.upsert(base, events, "k", [F.desc("at")]).collect()}
    assert got == {"a": (1, "x"), "b": (4, "y"), "c": (5, None)}
    more = state.insert_absent(base, spark.createDataFrame([("b", 9, "z"), ("d", 7, "z"), ("d", 8, "z")], base.schema), "k", [F.asc("v")])
    assert {r.k: r.v for r in more.collect()} == {"a": 1, "b": 2, "d": 7}
    store = people(spark, [person("a"), person("b", record_status="DELETED", deleted_at="old")])
    gone = {r.internal_uuid: (r.record_status, r.deleted_at) for r in state.soft_delete(store, spark.createDataFrame([("a",), ("a",), ("b",)], "internal_uuid string"), "now").collect()}
    assert gone == {"a": ("DELETED", "now"), "b": ("DELETED", "old")}
    new = {r.internal_uuid: (r.last_name, r.generated_id) for r in state.edited(store, people(spark, [person("a", last_name="Other", generated_id="no")]), ["last_name", "generated_id"], "now").collect()}
    assert new["a"] == ("Other", "G-a")
    pairs = spark.createDataFrame([("p", "PENDING"), ("q", "PENDING")], "pair_key string, decision_status string")
    said = spark.createDataFrame([("p", "DELETE_A", 1), ("q", "DELETE_A", 1), ("q", "RESET", 2)], "pair_key string, decision string, at long")
    assert {r.pair_key: r.decision_status for r in state.decided(pairs, said, [F.desc("at")]).collect()} == {"p": "RESOLVED", "q": "PENDING"}
    steps = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (1, "queued", 3)], "job long, state string, at long")
    assert [r.allowed for r in state.transitions(steps, [("queued", "running")], "job", "state", [F.asc("at")]).orderBy("at").collect()] == [True, True, False]
    assert state.search(store, "sm_TH").count() == 2 and state.search(store, " ").count() == 2 and state.where_filled(store, record_status="ACTIVE", city_code=" ").count() == 1
    assert state.where_filled(store, record_status=["ACTIVE", "DELETED"]).count() == 2


def test_backup(spark, tmp_path):
    df = spark.range(5)
    state.backup(df, f"file://{tmp_path}", "one", "now")
    assert state.restore(spark, f"file://{tmp_path}", "one").count() == 5
    spark.range(1).write.mode("append").parquet(f"file://{tmp_path}/one")
    with pytest.raises(ValueError):
        state.restore(spark, f"file://{tmp_path}", "one")


def test_audit(spark):
    value = {"file_path": "/a/b/c.csv", "remarks": "secret", "deep": [{"notes": "x", "name": " y "}], "source_reference": "C:\\in\\f.csv#row=1", "n": 3}
    assert audit.scrub(value) == {"file_path": "c.csv", "remarks": "[redacted]", "deep": [{"notes": "[redacted]", "name": "y"}], "source_reference": "f.csv#row=1", "n": 3}
    df = spark.createDataFrame([(json.dumps(value),), ("no json",), (None,)], "d string").select(audit.scrubbed_json("d").alias("d"))
    got = [r.d for r in df.collect()]
    assert json.loads(got[0]) == audit.scrub(value) and got[1:] == [None, None]
    assert audit.decode_token(audit.encode_token({"a": 1})) == {"a": 1}
    for bad in ("!!", "", audit.encode_token({})[:-1] + "é"):
        with pytest.raises(ValueError):
            audit.decode_token(bad)


def package(rows=1, **change):
    files = {"manifest.json": json.dumps({"spec_version": "v1", "package_id": "p", "created_at_utc": "t", "source_lgu_name": "l", "source_system_name": "s", "rows_declared": rows, "checksum_algorithm": "sha256"}), "beneficiaries.csv": ",".join(LEGACY_COLUMNS) + "\r\n", "export_meta.json": "{}"} | change
    files["checksums.txt"] = change.get("checksums.txt") or "\r\n".join(f"{hashlib.sha256(c.encode()).hexdigest()}  {n}" for n, c in files.items() if n in exchange.REQUIRED_ENTRIES)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_packages():
    p = exchange.open_package(package())
    exchange.check_rows(p, 1)
    with pytest.raises(ValueError):
        exchange.check_rows(p, 2)
    for bad in ({"../x": "1"}, {"/x": "1"}, {"other.txt": "1"}, {"manifest.json": "{}"}, {"checksums.txt": "abc"}, {"checksums.txt": "0" * 64 + "  beneficiaries.csv"}):
        with pytest.raises(ValueError):
            exchange.open_package(package(**bad))
    assert exchange.open_package(package(**{"README.txt": "x", "attachments/a": "y"})).manifest["package_id"] == "p"
    assert exchange.layout_of(["﻿id ", *PUBLIC_COLUMNS[1:]]) == "public" and exchange.layout_of(LEGACY_COLUMNS) == "legacy"
    with pytest.raises(ValueError):
        exchange.layout_of(["id"])
    assert exchange.gate("a", None) == "new" and exchange.gate("a", "a") == "same"
    with pytest.raises(ValueError):
        exchange.gate("a", "b")


def test_files(spark, tmp_path):
    rows = export.export_rows(export.exportable(people(spark, [person("a", last_name="=Cruz, \"x\"\ny", region_name=" "), person("b", duplicate_status="POSSIBLE_DUPLICATE"), person("c", record_status="DELETED"), person("d", record_status="RETAINED", birth_month=None)]))).orderBy("id")
    path = str(tmp_path / "out" / "list.csv")
    assert export.write_one_file(rows, path) == 2
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfid,last_name") and raw.count(b"\r\n") == 3
    back = exchange.read_table(spark, f"file://{path}").orderBy("id").collect()
    assert (back[0].last_name, back[0].region, back[0].month_mm, back[1].month_mm) == ("'=Cruz, \"x\"\ny", "01", "01", None)
    records_ = exchange.read_records(spark, f"file://{path}").orderBy("line_no").collect()
    assert [r.source_reference for r in records_] == ["list.csv#row=000001", "list.csv#row=000002"]
    assert exchange.fingerprints(spark, f"file://{path}").first().checksum == hashlib.sha256(raw).hexdigest()
    export.write_many_files(rows, f"file://{tmp_path}/many")
    assert exchange.read_table(spark, f"file://{tmp_path}/many", "public").count() == 2


def test_dimension_file(spark, tmp_path):
    header = [f"h{i}" for i in range(35)]
    cells = [f" v{i} " for i in range(35)]
    (tmp_path / "d.csv").write_text(",".join(header) + "\n" + ",".join(cells) + "\n")
    row = exchange.read_dimension(spark, f"file://{tmp_path}/d.csv", header).first()
    assert row.barangay_code == "v21" and row.region_name == "v29"
    with pytest.raises(ValueError):
        exchange.read_dimension(spark, f"file://{tmp_path}/d.csv", header[1:])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n3,4\n")
    seen = []
    stream = ingest.file_stream(spark, f"file://{tmp_path}/in", ["x", "y"])
    ingest.run_batches(stream, lambda df, n: seen.append((n, df.count())), f"file://{tmp_path}/cp").awaitTermination()
    (tmp_path / "in" / "b.csv").write_text("x,y\n5,6\n")
    ingest.run_batches(ingest.file_stream(spark, f"file://{tmp_path}/in", ["x", "y"]), lambda df, n: seen.append((n, df.count())), f"file://{tmp_path}/cp").awaitTermination()
    assert seen == [(0, 2), (1, 1)]


def test_block_join_splits_hot_blocks(spark):
    rows = [(i, 7 if i % 3 else i % 50) for i in range(900)] + [(1000, None)]
    left = spark.createDataFrame(rows, "a long, k long")
    right = spark.createDataFrame([(b, k) for b, k in rows if b % 2], "b long, k long")
    want = sorted((a, b) for a, k in rows for b, j in rows if b % 2 and k is not None and k == j)
    for least in (10, 100_000):
        assert sorted((r.a, r.b) for r in skew.block_join(left, right, "k", "a", 900, least).collect()) == want
    hot = skew.hot_keys(left, "k", 900, 100).collect()
    assert [(r["k"], r["__n"]) for r in hot] == [(7, 7)] and skew.hot_keys(left, "k", 900, 1000) is None
    assert skew.block_join(left.limit(0), right, "k", "a", 0).count() == 0
    found = skew.lookup_join(left, spark.createDataFrame([(7, "x"), (3, "y"), (99, "z")], "k long, v string"), "k", hot_rows=50).collect()
    assert len(found) == len(rows) and all(r.v == {7: "x", 3: "y"}.get(r.k) for r in found)


def test_aliases_and_parents(spark):
    names = [("04", "Region IV-A"), ("05", "Region IV-B"), ("15", "Bangsamoro Autonomous Region in Muslim Mindanao"), ("16", "Old Bangsamoro Autonomous Region in Muslim Mindanao"), ("09", "Region A region B")]
    got = {r.alias: r.region_name for r in geography.region_aliases(spark.createDataFrame(names, "region_code string, region_name string")).collect()}
    assert got["iv-a"] == "Region IV-A" and got["region iv-b"] == "Region IV-B" and "iv" not in got and got["barmm"] == names[2][1] and "armm" not in got and got["a"] == "Region A region B" and "a region" not in got
    r = spark.createDataFrame([("01", "One"), ("02", "Two")], "region_code string, region_name string")
    p = spark.createDataFrame([("0101", "01", "P"), ("0201", "02", "Q")], "province_code string, region_code string, province_name string")
    c = spark.createDataFrame([("A", "01", "0101", "A"), ("B", "02", "0101", "B"), ("C", "01", None, "C")], "city_code string, region_code string, province_code string, city_name string")
    b = spark.createDataFrame([("A1", "01", "0101", "A", "x"), ("B1", "01", "0101", "B", "x"), ("C1", "01", None, "C", "x"), ("C2", "09", "0201", "C", "x")], "barangay_code string, region_code string, province_code string, city_code string, barangay_name string")
    chains = {x.barangay_code: (x.region_code, x.consistent) for x in geography.chains(r, p, c, b).collect()}
    assert chains == {"A1": ("01", True), "B1": ("01", False), "C2": ("02", False)}
    asked = spark.createDataFrame([("01", "0101", "A", "A1"), ("01", "0101", "A", "B1"), ("02", "0101", "A", "A1"), ("01", " ", "A", "A1"), ("01", "0101", "C", "C1"), ("01", "0101", "Z", "A1")], "region_code string, province_code string, city_code string, barangay_code string")
    faults = {tuple(x)[:4]: x.chain_fault for x in geography.chain_fault(asked, r, p, c, b).collect()}
    assert list(faults.values()).count(None) == 2 and faults["01", "0101", "A", "B1"] == "barangay B1 does not belong to city A" and faults["02", "0101", "A", "A1"] == "province 0101 does not belong to region 02"
    assert faults["01", " ", "A", "A1"] == "location codes are required" and faults["01", "0101", "Z", "A1"] == "unknown city Z"
    assert {x.code for x in geography.parent_faults({"region": r, "province": p, "city": c, "barangay": b}).collect()} >= {"B", "B1", "C2"}
    schema = ", ".join(f"{x}_{y} string" for x in geography.LEVELS for y in ("code", "name"))
    with pytest.raises(ValueError):
        geography.ingest(spark.createDataFrame([("01", "R", "0101", "P", "A", "C", "A1", "B"), ("02", "S", "0101", "P", "A", "C", "A2", "B")], schema))


def test_backfill(spark):
    chains, aliases = catalog(spark), geography.region_aliases(spark.createDataFrame(R, "region_code string, region_name string"))
    place = {"region_name": "Region One", "province_name": "Alpha Province", "city_name": "Santa Cruz City", "barangay_name": "sto. niño", "region_code": "x", "source_reference": None}
    rows = people(spark, [person("a", **place), person("b", **place | {"province_name": None, "province_code": None, "barangay_name": "Sto. Niño"}), person("c", **place | {"barangay_name": "Elsewhere", "source_reference": "f"})])
    done = geography.backfill(rows, chains, aliases, "now")
    got = {r.internal_uuid: (r.status, r.updated, r.reason) for r in done.collect()}
    assert got["a"] == ("AUTO_APPLIED", True, None) and got["b"] == ("REVIEW_NEEDED", False, "raw location chain incomplete") and got["c"][0] == "REVIEW_NEEDED"
    assert geography.backfill_counts(done).first() == (3, 1, 2, 1)
    after = {r.internal_uuid: (r.region_code, r.barangay_name, r.updated_at) for r in geography.backfilled(rows, done).collect()}
    assert after["a"] == ("01", "Sto. Niño", "now") and after["c"][0] == "x"
    items = geography.lineage(done, "run", [F.col("internal_uuid")]).orderBy("row_number").collect()
    assert [r.item_reference for r in items] == ["G-a", "G-b", "f"] and [r.row_number for r in items] == [1, 2, 3]


def test_decisions(spark):
    matches = spark.createDataFrame([("m1", "a|b", "a", "b", "PENDING"), ("m2", "c|d", "c", "d", "PENDING")], "match_id string, pair_key string, record_a_uuid string, record_b_uuid string, decision_status string")
    store = people(spark, [person(x) for x in "abcde"])
    none = spark.createDataFrame([], "pair_key string, record_a_uuid string, record_b_uuid string, decision string, resolved_by string, resolved_at string, notes string")
    asked = spark.createDataFrame([(1, "m1", "RETAIN_BOTH", "x", None), (2, "m1", "DELETE_B_SOFT", "x", "why"), (3, "m9", "RETAIN_A", "x", None), (4, "m2", "NO", "x", None), (5, "m2", "RETAIN_A", " ", None)], "n long, match_id string, decision string, resolved_by string, notes string")
    out = decisions.applied(matches, store, none, asked, [F.col("n")], "now")
    assert {r.match_id: r.decision_status for r in out.matches.collect()} == {"m1": "RESOLVED", "m2": "PENDING"}
    got = {r.internal_uuid: (r.record_status, r.duplicate_status) for r in out.records.collect()}
    assert got["a"] == ("ACTIVE", "RESOLVED") and got["b"] == ("DELETED", "RESOLVED") and got["c"] == ("ACTIVE", "CLEAR")
    assert [(r.pair_key, r.decision) for r in out.decisions.collect()] == [("a|b", "DELETE_B_SOFT")]
    assert sorted((r.action, json.loads(r.details).get("previous_decision"), json.loads(r.details).get("notes")) for r in out.audit.collect()) == [("DEDUP_DECISION_APPLIED", None, None), ("DEDUP_DECISION_RECOMPUTED", "RETAIN_BOTH", "[redacted]")]
    assert sorted(r.reason for r in out.refused.collect()) == ["resolved_by is required", "unknown decision", "unknown match"]
    back = decisions.reset(out.matches, out.records, out.decisions, spark.createDataFrame([("m1", "x", None), ("m2", "x", None)], "match_id string, reset_by string, notes string"), "later")
    got = {r.internal_uuid: (r.record_status, r.duplicate_status, r.deleted_at) for r in back.records.collect()}
    assert got["b"] == ("ACTIVE", "POSSIBLE_DUPLICATE", None) and got["a"][1] == "POSSIBLE_DUPLICATE" and got["d"][1] == "CLEAR"
    assert [r.reason for r in back.refused.collect()] == ["no decision to reset"] and {r.decision_status for r in back.matches.collect()} == {"PENDING"}


def test_jobs(spark):
    now = spark.createDataFrame([("a", "queued", "t", 0, None, "", None), ("b", "running", "t", 1, 30.0, "", None), ("c", "recoverable", "t", 1, 30.0, "m", "e"), ("d", "succeeded", "t", 1, 100.0, "", None), ("e", "cancel_requested", "t", 1, 10.0, "", None)], "job_id string, state string, updated_at string, attempt int, progress double, message string, error_code string")
    asked = spark.createDataFrame([("a", "running", None, None, None), ("b", "failed", None, " ", "boom"), ("c", "running", None, "again", None), ("d", "running", None, None, None), ("z", "running", None, None, None)], "job_id string, next string, progress double, message string, error_code string")
    after, refused = jobs.moved(now, asked, "now")
    got = {r.job_id: (r.state, r.attempt, r.progress, r.message, r.error_code) for r in after.collect()}
    assert got == {"a": ("running", 1, 0.0, "", None), "b": ("failed", 1, 30.0, "", "boom"), "c": ("running", 2, 30.0, "again", None), "d": ("succeeded", 1, 100.0, "", None), "e": ("cancel_requested", 1, 10.0, "", None)}
    assert {r.job_id: r.reason for r in refused.collect()} == {"d": "no step from succeeded to running", "z": "unknown job"}
    again = {r.job_id: (r.state, r.message) for r in jobs.recovered(now, "now").collect()}
    assert again["b"] == ("recoverable", "recovered after a restart") and again["e"][0] == "cancel_requested"


def test_guarded_restore(spark, tmp_path):
    path = f"file://{tmp_path}"
    state.backup(spark.createDataFrame([("x",), ("x",), ("y",)], "v string"), path, "one", "now")
    assert state.manifest_of(spark.createDataFrame([("x",), ("x",)], "v string"))["checksum"] != state.manifest_of(spark.createDataFrame([("y",), ("y",)], "v string"))["checksum"]
    busy = spark.createDataFrame([("j", "running")], "job_id string, state string")
    assert not state.validated(spark, path, "one", busy)["apply_ready"]
    for wrong in ({"jobs": busy}, {"phrase": "RESTORE", "confirmation": "no"}, {"phrase": "RESTORE"}):
        with pytest.raises(ValueError):
            state.restore(spark, path, "one", **wrong)
    live = spark.createDataFrame([("now",)], "v string")
    assert state.restore(spark, path, "one", live=live, phrase="RESTORE", confirmation=" RESTORE ", at="2026-07-01").count() == 3
    assert state.restore(spark, path, "pre-restore-20260701").first() == ("now",)
    journal = spark.createDataFrame([(1,), (2,)], "version int")
    assert state.versions(journal, [1, 2, 3]) == (2, [3], []) and state.versions(journal.limit(0), [1], 0) == (0, [], []) and state.versions(journal, [1, 2, 3], 1) == (2, [], [2])
    with pytest.raises(LookupError):
        records.found(live, "v", "x")


def test_public_import_and_repeated_commit(spark):
    chains, aliases = catalog(spark), geography.region_aliases(spark.createDataFrame(R, "region_code string, region_name string"))
    good = ["Region One", "Alpha Province", "Santa Cruz City", "Sto. Niño"]
    rows = [(1, "f#1", None, "Cruz", "Ana", *good, "1", "2", "1990", "f"), (2, "f#2", None, "Cruz", "Ana", *good, "1", "2", "1990", "F "), (3, "f#3", None, "Diaz", "Ben", "Region One", "Alpha Province", "Nowhere", "Nothing", "x", None, None, "M"), (4, "f#4", None, "Diaz", "Ben", *good, "x", None, None, "M"), (5, "f#5", None, "Diaz", "Ben", "", *good[1:], None, None, None, "M"), (6, "f#6", None, "Diaz", " ", *good, None, None, None, "M")]
    df = spark.createDataFrame([(*r[:5], None, None, *r[5:9], None, *r[9:]) for r in rows], "row_id long, source_reference string, id string, last_name string, first_name string, middle_name string, extension_name string, region string, province string, city_municipality string, barangay string, contact_no string, month_mm string, day_dd string, year_yyyy string, sex string")
    drafts = importer.public_drafts(df, geography.normalize(df, chains, aliases))
    done = importer.dispositions(drafts, people(spark, [person("s")]), [F.col("row_id")], F.col("draft_error"), F.col("needs_review"))
    got = {r.row_id: (r.disposition, r.message) for r in done.collect()}
    assert got[1] == ("inserted", None) and got[2] == ("skipped", "exact duplicate") and got[3] == ("skipped", "location needs review") and got[4] == ("failed", "month_mm must be a whole number")
    assert got[5][0] == "failed" and got[6] == ("failed", "first_name is required")
    items = importer.ledger(done, "run", "row_id")
    assert {r.row_number: r.status for r in items.collect()} == {1: "AUTO_APPLIED", 2: "AUTO_APPLIED", 3: "REVIEW_NEEDED", 4: "AUTO_APPLIED", 6: "AUTO_APPLIED"} and importer.run_counts(done, items).first() == (6, 4, 1, 3)
    logs = spark.createDataFrame([("i", "h", "k", "SUCCEEDED", "2024")], "import_id string, file_hash string, idempotency_key string, status string, started_at string")
    numbered = people(spark, [person("a", last_name="New")]).withColumn("n", F.lit(1))
    again = importer.commit(numbered, people(spark, [person("s")]), "n", "h", "stamp", logs=logs, key=" k ")
    assert (again.repeated, again.status, again.rows.count()) == ("i", "SUCCEEDED", 0)
    assert importer.commit(numbered, people(spark, [person("s")]), "n", "other", "stamp", logs=logs, key="k").rows.count() == 1
    made = records.created(people(spark, [person(" ", last_name="  De  La ", record_status=" ", sex="m", generated_id="G-s"), person("z", sex=None)]), people(spark, [person("s")]), [F.col("last_name")], "now").collect()
    assert len(made) == 1 and (made[0].last_name, made[0].record_status, made[0].sex, made[0].generated_id, len(made[0].internal_uuid)) == ("De La", "ACTIVE", "M", "G-000001", 36)


def test_records_of_a_file_cut_across_blocks(spark, tmp_path):
    rng, pieces = random.Random(3), ["a\x0bB,1", "C\u2028D,2", 'x,"two\nlines",3', 'stray " quote,4', "plain,\u0085,5", '"q ""q"", z",6', "", '"open\n\nstill",7']
    wanted = [rng.choice(pieces) for _ in range(400)]
    (tmp_path / "f.csv").write_bytes(("\ufeffhead,er\n" + "\r\n".join(wanted) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = exchange.read_records(spark, f"file://{tmp_path}/f.csv").orderBy("line_no").collect()
            assert [r.raw_text for r in got] == [w for w in wanted if w] and got[6].source_reference == "f.csv#row=000007"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_candidates_of_places_are_never_a_table(spark, monkeypatch):
    """60 typed chains of which no level matches meet all 200 places; no table that is written holds their 12,000 pairs."""
    import numpy as np

    from tallyloom.functions.arrays import jaro_winkler_of
    from tallyloom.functions.similarity import jaro_winkler

    chain = lambda i: ("01", "Alta", "0101", "Baja", "010101", "Centro", f"0101010{i:03d}", f"San {'ABCDEFGHIJ'[i % 10]}{'aeiou' * (i % 3)}na {i}", True)
    catalog = spark.createDataFrame([chain(i) for i in range(200)], ", ".join(f"{c} string" for c in geography.CHAIN) + ", consistent boolean")
    typed = spark.createDataFrame([("", "", "", f"Sna {'JIHGFEDCBA'[i % 10]}aeona {i}x") for i in range(60)], "region string, province string, city_municipality string, barangay string")
    aliases = spark.createDataFrame([], "alias string, region_name string")
    held: list[int] = []
    durable = geography.durable

    def counted(df, name):
        out = durable(df, name)
        held.append(out.count())
        return out

    monkeypatch.setattr(geography, "durable", counted)
    got = {(r.barangay, r.place): (r.barangay_code, r.score) for r in geography.candidates(typed, catalog, aliases).collect()}
    assert max(held) <= 60 * 11
    key = geography.location_key
    names = catalog.select("barangay_code", key("barangay_name").alias("b")).crossJoin(typed.select("barangay", key("barangay").alias("a")))
    scores = names.select("barangay", "barangay_code", "a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    assert jaro_winkler_of([r.a for r in scores], [r.b for r in scores], *[np.arange(len(scores))] * 2).tolist() == [r.s for r in scores]
    want = {}
    for r in scores:
        want.setdefault(r.barangay, []).append((-r.s, r.barangay_code))
    assert got == {(b, i + 1): (c, -s) for b, found in want.items() for i, (s, c) in enumerate(sorted(found)[:10])}


def test_no_table_of_records_is_sent_through_the_driver(spark):
    """Candidate pairs and matches broadcast no side of a join, though the table is small."""
    base = {c: None for c in PERSON_COLUMNS} | {"record_status": "ACTIVE", "city_code": "0101", "birth_year": 1980}
    rows = spark.createDataFrame([tuple((base | {"internal_uuid": f"u{i}", "last_name": "CRUZ", "first_name": "EDUARDO"})[c] for c in PERSON_COLUMNS) for i in range(4)], SCHEMA)
    rows = geography.durable(rows, "records")  # a file, whose size the planner knows
    for df in (matching.candidate_pairs(matching.comparable(rows)), matching.matches(rows)):
        assert df.count() == 6
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_moved_once_and_pairs_never(spark):
    """Both sides of the block join read one shuffle; it has a row for each record and key, and no pair is moved after it."""
    rows = geography.durable(people(spark, [person(f"{i:03d}", first_name="Ann") for i in range(40)]), "records")
    for df in (matching.candidate_pairs(matching.comparable(rows)), matching.matches(rows)):
        assert df.count() == 780
        df.write.format("noop").mode("overwrite").save()
        assert df._jdf.queryExecution().executedPlan().toString().count("+- Exchange ") <= 2  # one, and its reuse
        assert "explode(array(0" not in df._jdf.queryExecution().analyzed().toString()


def test_hot_blocks_and_odd_names_keep_all_pairs(spark):
    rng = random.Random(8)
    firsts, lasts = ["", "Al", "Ale", "Alec", "Alexa", "Ñandu", "Maria Jose", "Maria José"], ["", "Cruz", "Crus", "De la Cruz", "Dela Cruz", "Peña", "Pena", "Ng"]
    rows = people(spark, [person(f"{i}", last_name=rng.choice(lasts), first_name=rng.choice(firsts), middle_name=rng.choice(["", "Reyes", "Reies"]), extension_name=rng.choice([None, "JR", "SR"]), city_code=rng.choice(["1", "2", None])) for i in range(150)])
    fields = matching.comparable(rows)
    keys = {r.internal_uuid: set(r.k) for r in fields.select("internal_uuid", matching.blocking_keys().alias("k")).collect()}
    want = {(a, b) for a, b in combinations(sorted(keys), 2) if keys[a] & keys[b]}
    pairs = matching.candidate_pairs(fields, least=20)
    got = [(r.uuid_a, r.uuid_b) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert matching.count_candidates(fields).first()[0] == len(want)
    plain = {r.pair_key: r for r in matching.scored(matching.with_fields(pairs, fields)).collect()}
    for t in (40, 70, 90, 100):
        found = matching.ordered(matching.matches(rows, t, least=20)).collect()
        assert found == sorted((r for r in plain.values() if r.total_score >= t), key=lambda r: (-r.total_score, r.pair_key))
        assert matching.run_totals(rows, t).first() == (len(want), len(found))


def test_numbering_moves_wanted_columns_only(spark, monkeypatch):
    """er_run_rows orders the pair key and the score; no other column of the matches is written."""
    from tallyloom.plans import queries

    rows, held = people(spark, [person(x) for x in "cab"]), []
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    monkeypatch.setattr(ranking, "durable", lambda df, *_: held.append(df.columns) or geography.durable(df, "ranked"))
    got = sorted((r.match_id, r.pair_key) for r in queries.er_run_rows(spark, "").collect())
    assert got == [("run-1-00001", "a|b"), ("run-1-00002", "a|c"), ("run-1-00003", "b|c")]
    assert [set(c) for c in held] == [{"pair_key", "total_score", "__part", "__at"}]
