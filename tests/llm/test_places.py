from tallyloom.llm.places import NONE, Gazetteer, Vocabulary, distance, map_places, similarity, tokens

R = [("01", "Region XXI (Alpha Coast)"), ("02", "Region II (Beta Plains)")]
P = [("0101", "01", "Norte del Sur"), ("0102", "01", "Bagang Oriental"), ("0201", "02", "Quirong")]
C = [("010101", "01", "0101", "San Jose City"), ("010201", "01", "0102", "San Jose"), ("010202", "01", "0102", "Sta. Cruz"), ("020101", "02", None, "City of Tandag"), ("020102", "02", "0201", "Sta. Cruz")]
B = [("0101010001", "010101", "Barangay 3 (Pob.)"), ("0101010002", "010101", "Sto. Niño"), ("0102010001", "010201", "Poblacion"), ("0102020001", "010202", "Malinao Norte"), ("0102020002", "010202", "Malinao Sur"), ("0201010001", "020101", "Poblacion"), ("0201020001", "020102", "Malinao Norte")]

CASES = [
    (("Region XXI (Alpha Coast)", "Norte del Sur", "San Jose City", "Sto. Niño"), "0101010002"), (("xxi", "Norte d. S.", "City of San Jose", "Brgy. Santo Nino"), "0101010002"), (("REG. 21", "Prov. of Norte del Sur", "san jsoe", "Bgy3"), "0101010001"),
    (("01", "0101", "010101", "0101010002"), NONE), (("alpha coast", "Bagang Orient.", "Mun. of Sta Cruz", "Malinao Nte."), "0102020001"), (("Region XXI", "Bagang Oriental", "", "Malinao Sur, Santa Cruz"), "0102020002"), (("Region XXI", None, None, "Malinao Sur Sta Cruz"), "0102020002"),
    (("Region XXI", "Bagang Oriental", "Malinao Sur", "Sta. Cruz"), "0102020002"), ((None, "", "Sta. Cruz", "Malinao Norte"), NONE), ((None, None, "Sta. Cruz", "Malinao Sur"), "0102020002"), (("Region II", "", "Tandag City", "Pob."), "0201010001"),
    (("Region XXI", "Bagang Oriental", "Sta. Cruz", "Malinao II"), NONE), (("Region XXI", "Bagang Oriental", "Sta. Cruz", "Elsewhere"), NONE), (("?", "unknown", "-", "?"), NONE), ((None, None, None, None), NONE), (("Region XXI", "Quirong", "Sta. Cruz", "Malinao Norte"), NONE),
    (("Region XXI", "Bagang Oriental", "Sta. Cruz", "x" * 100_000), NONE),
]


def test_cases():
    g = Gazetteer(R, P, C, B)
    assert [g.resolve(*t) for t, _ in CASES] == [c for _, c in CASES]
    assert Gazetteer([], [], [], []).resolve("a", "b", "c", "d") == NONE


def test_map_places(spark):
    tables = [spark.createDataFrame(rows, s) for rows, s in ((R, "region_code string, region_name string"), (P, "province_code string, region_code string, province_name string"), (C, "city_code string, region_code string, province_code string, city_name string"), (B, "barangay_code string, city_code string, barangay_name string"))]
    rows = spark.createDataFrame([(i, *t, 1) for i, (t, _) in enumerate(CASES)] * 2, "row_id long, region string, province string, city_municipality string, barangay string, exact int")
    got = map_places(rows, tables).collect()
    assert len(got) == 2 * len(CASES) and all(r.barangay_code == CASES[r.row_id][1] for r in got)
    assert {r.row_id for r in got if r.exact} == {0}
    assert map_places(rows.limit(0), tables).count() == 0
    # A geography over the bound comes by a shuffle, with the same results.
    large = map_places(rows, tables, bound=3, task_rows=7).collect()
    assert sorted((r.row_id, r.barangay_code, r.exact) for r in large) == sorted((r.row_id, r.barangay_code, r.exact) for r in got)
    assert map_places(rows.limit(0), tables, bound=3).count() == 0


def test_words():
    assert tokens(" BRGY.  No. 05 ") == ["barangay", "no", "5"] and tokens("Sto. NiÃ±o") == ["santo", "nino"] and tokens(None) == []
    assert tokens("Rue 5", Vocabulary(abbreviations={"rue": "street"})) == ["street", "5"]
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "xyz", 1) == 2 and similarity("malinao 1", "malinao 2") == 0.0
    assert similarity("san isidro norte", "norte san isidor") == 0.99 - 1 / 14 and similarity("beta", "betta") > 0 == similarity("beta", "gamma")


def test_scopes_of_one_size_are_kept_apart():
    cities = [("010201", "01", "0102", "Alpha"), ("010202", "01", "0102", "Betta"), ("010203", "01", "0102", "Beto"), ("010204", "01", "0102", "Omega")]
    g = Gazetteer(R, P, cities, [])
    scope = lambda *codes: g._scope("city", codes, codes)
    assert g.match("city", "Beta", scope("010201", "010202", "010204"))[0] == ["010202"]
    assert g.match("city", "Beta", scope("010201", "010203", "010204"))[0] == ["010203"]


def test_mentions_beside_parts_of_a_place():
    g = Gazetteer(R, P, C, B)
    assert g.resolve("Region XXI", "Bagang Oriental", "Sta. Cruz", "Purok 7 Malinao Norte") == "0102020001"
    assert g.resolve("Region XXI", "Bagang Oriental", "Sta. Cruz", "Upper Malinao Norte") == NONE
