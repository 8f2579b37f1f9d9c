import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.dates import birth_error, birth_iso
from tallyloom.functions.instants import instant_nanos, iso_date
from tallyloom.functions.similarity import hamming_score, jaro_winkler, jaro_winkler_score, levenshtein_score, total_score


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def plain_jaro(a, b):
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if j not in used and b[j] == c:
                used.append(j)
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    off = sum(x != b[j] for x, j in zip(mine, sorted(used)))
    return (m / len(a) + m / len(b) + (m - off / 2) / m) / 3


def plain_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    j = plain_jaro(a, b)
    return j + prefix * 0.1 * (1 - j)


def test_jaro_winkler_against_plain(spark):
    words = ["", "MARTHA", "MARHTA", "DWAYNE", "DUANE", "ÑAÑO", "NANO", "A", "B", "AB", "BA", "JUAN CARLOS", "CARLOS JUAN", "DIXON", "DICKSONX", "AABABCAAAC", "ABAACBAAAC"]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro_winkler("a", "b").alias("w")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert math.isclose(r["w"], plain_winkler(r["a"], r["b"]), abs_tol=1e-12), r


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ABÑ", max_size=8), st.text("ABÑ", max_size=8)), min_size=1, max_size=30))
def test_jaro_winkler_property(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro_winkler("a", "b").alias("w")).collect()
    assert all(math.isclose(r["w"], plain_winkler(r["a"], r["b"]), abs_tol=1e-12) for r in rows)


def test_scores(spark):
    df = spark.createDataFrame([("JR", "SR"), ("JR", "JRS"), ("JR", "JR"), ("", ""), ("", "A"), (None, "A"), (None, None)], "a string, b string")
    got = [tuple(r) for r in df.select(hamming_score("a", "b"), levenshtein_score("a", "b"), jaro_winkler_score("a", "b")).collect()]
    assert [g[0] for g in got] == [50.0, 0.0, 100.0, 100.0, 0.0, 0.0, 100.0]
    assert got[3] == got[6] == (100.0, 100.0, 100.0)
    assert spark.range(1).select(total_score(F.lit(80.0), F.lit(20.0), F.lit(100.0), F.lit(0.0))).first()[0] == 85.2
    w = spark.createDataFrame([("MARTHA", "MARHTA")], "a string, b string").select(jaro_winkler_score("a", "b"), levenshtein_score("a", "b")).first()
    assert w[0] > 90 > w[1]


def test_text(spark):
    assert one(spark, text.entry_text("a"), a="  dela   Cruz ") == "dela Cruz"
    assert one(spark, text.digits("a"), a=" +63 917-123-4567 ") == "639171234567"
    assert one(spark, text.match_name("a", "b"), a="  ", b=" juan  p ") == "JUAN P"
    assert one(spark, text.location_key("a"), a="Sto. Niño (Pob.)") == "sto nino pob"
    assert one(spark, text.basename("a"), a="C:\\x\\list.csv") == "list.csv"
    assert one(spark, text.basename("a"), a="/") is None
    assert one(spark, text.with_provenance("a", "b"), a="row-2", b="IMP-1") == "row-2;source_generated_id=IMP-1"
    assert one(spark, text.with_provenance("a", "b"), a="row-2;source_generated_id=IMP-1", b="IMP-1") == "row-2;source_generated_id=IMP-1"
    assert one(spark, text.full_name("a", "b", "c", "d"), a="Cruz", b="Ana", c=None, d=" ") == "Cruz, Ana"
    assert one(spark, text.full_name("a", "b", "c", "d"), a=None, b=None, c=None, d=None) == "n/a"
    assert one(spark, text.pair_key("a", "b"), a="b", b="a") == "a|b"
    assert [tuple(one(spark, text.whole_number("a"), a=a)) for a in ("12", " ", "x", None)] == [(12, False), (None, False), (None, True), (None, False)]
    guarded = [one(spark, text.formula_guard("a"), a=a) for a in ("=1+1", "+cmd", "-10", "@calc", " \t=SUM(A1:A2)", "normal", "'=text")]
    assert guarded == ["'=1+1", "'+cmd", "'-10", "'@calc", "' \t=SUM(A1:A2)", "normal", "'=text"]
    assert spark.range(1).select(text.padded_id(F.lit(1)), text.padded_id(F.lit(12345678))).first() == ("G-000001", "G-12345678")


def test_dates(spark):
    schema = "iso string, m long, d long, y long"
    rows = [("1990-03-25", None, None, None), ("1990-03-25", 3, 25, 1990), ("1990-03-25", 4, 25, 1990), ("90-3-25", None, None, None), (None, 2, 30, 1990), (None, 2, None, 1990), (None, 13, 1, 1990), (None, None, None, None), (None, 2, 29, 2000), ("1799-01-01", None, None, None)]
    c = [F.col(x) for x in ("iso", "m", "d", "y")]
    got = [tuple(r) for r in spark.createDataFrame(rows, schema).select(birth_error(*c), birth_iso(*c)).collect()]
    assert [g[0] is None for g in got] == [True, True, False, False, False, False, False, True, True, False]
    assert got[8][1] == "2000-02-29" and got[7][1] == ""


def test_instants(spark):
    rows = [("2021-02-13T20:20:44Z",), ("2021-02-13T20:20:44.5Z",), ("2021-02-14T04:20:44.500000001+08:00",), ("2021-02-13",), (None,), ("",), ("2021-13-40T00:00:00Z",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(instant_nanos(F.col("t"))).collect()]
    assert got[1] - got[0] == 500_000_000 and got[2] - got[1] == 1 and got[3:] == [None, None, None, None]
    days = [r[0] for r in spark.createDataFrame([("2000-02-29",), ("1999-02-29",), ("2000-2-9",), (None,)], "t string").select(iso_date(F.col("t"))).collect()]
    assert days[0] is not None and days[1:] == [None, None, None]
