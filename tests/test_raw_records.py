import csv
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.sources.raw_records import BAD, CLASS, END, FIELD_START, NEXT, QUOTED, _parse, file_report, load_records, states_before

GOOD = ",Cruz,Ana,,,Region I,Alpha,San Jose,Centro,0917,02,03,1990,F"
LEGACY = "G-1,Cruz,Ana,,,F,1990-02-03,01,0101,010101,010101001,0917"


def geography(spark):
    return {f"{x}_code": spark.createDataFrame([(c,)], f"{x}_code string") for x, c in (("region", "01"), ("province", "0101"), ("city", "010101"), ("barangay", "010101001"))}


def reasons(spark, texts):
    rows = spark.createDataFrame([(i, "f.csv", i, t) for i, t in enumerate(texts)], "line_id long, source_reference string, line_no long, raw_text string")
    return {r.line_id: r for r in load_records(rows, geography(spark)).collect()}


CASES = [
    (GOOD, None), (GOOD + "\r", None), (LEGACY, None), (LEGACY.replace("1990-02-03", ""), None), (GOOD.replace("Ana", '"Ana ""Inday"", x\ny"'), None), (GOOD.replace("02,03,1990", ",,"), None),
    (GOOD.replace("Ana", 'A"na'), "quoting"), (GOOD.replace("Ana", '"Ana"x'), "quoting"), (GOOD.replace("Ana", '"Ana'), "quoting"), ('"', "quoting"), (GOOD + ",", "column_count"), ("", "column_count"), (None, "column_count"), ("a\r\r", "column_count"),
    (GOOD.replace("Ana", " \u00a0\u3000"), "value"), (GOOD.replace("Alpha", ""), "value"), (GOOD.replace("02,03,1990", "02,30,1990"), "value"), (GOOD.replace("02,03,1990", "02,,1990"), "value"), (GOOD.replace("02,03,1990", "٠٢,03,1990"), "value"),
    (GOOD.replace("02,03,1990", "+2,03,1990"), "value"), (GOOD.replace("02,03,1990", "02,03,1799"), "value"), (GOOD.replace("02,03,1990", "02,03,99999999999999999999"), "value"), (GOOD[:-1], "value"),
    (LEGACY.replace("1990-02-03", "1990-2-3"), "value"), (LEGACY.replace("1990-02-03", "1990-02-30"), "value"), (LEGACY.replace("0101,", "9999,"), "value"), (LEGACY.replace(",01,", ",,"), "value"), (LEGACY.replace("Ana", ""), "value"),
    (GOOD.replace("Ana", 'A"na') + ",", "quoting"),
]


def test_reasons(spark):
    got = reasons(spark, [t for t, _ in CASES])
    assert [got[i].reason for i in range(len(CASES))] == [r for _, r in CASES]
    assert got[4].record.first_name == 'Ana "Inday", x\ny' and got[0].layout == "public" and got[2].layout == "legacy"
    assert got[6].detail == "quote inside an unquoted field at byte 7" and got[6].record is None


def test_long_record_and_clashing_columns(spark):
    text = GOOD.replace("Ana", '"' + "x,\n" * 200_000 + '"')
    rows = spark.createDataFrame([(1, text, "mine", "p", 5)], "line_id long, raw_text string, reason string, parsed string, layout int")
    r = load_records(rows, geography(spark)).first()
    assert r.reason is None and len(r.record.first_name) == 600_000 - 1


def test_empty_table_and_report(spark):
    rows = spark.createDataFrame([], "line_id long, source_reference string, line_no long, raw_text string")
    assert load_records(rows, geography(spark)).count() == 0 and file_report(load_records(rows, geography(spark))).count() == 0
    rows = spark.createDataFrame([(i, "a" if i < 30 else None, i, "x" if i % 2 else GOOD) for i in range(32)], "line_id long, source_reference string, line_no long, raw_text string")
    got = {r.source_reference: r for r in file_report(load_records(rows, geography(spark))).collect()}
    assert (got["a"].rows_read, got["a"].row_count_invalid, len(got["a"].sample_errors)) == (30, 15, 10)
    assert got["a"].sample_errors[0] == "row 1: expected 14 or 12 columns, found 1" and got[None].rows_read == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('a,"\n', max_size=40), min_size=1, max_size=20), st.integers(1, 70))
def test_states_are_those_of_a_sequential_pass(texts, chunk):
    data = np.frombuffer("\x00".join(texts).encode().replace(b"\x00", b"\xff") + b"\xff", np.uint8)
    state, want = FIELD_START, []
    for b in data.tolist():
        want.append(state)
        state = NEXT[state, CLASS[b]]
    assert states_before(data, chunk).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text('ab,"', max_size=30))
def test_against_the_csv_module(text):
    parsed = _parse([text]).to_pylist()[0]
    try:
        fields = next(csv.reader(io.StringIO(text, newline=""), strict=True), [""])
    except csv.Error:
        fields = None
    if fields is None:
        assert parsed["quoting"]
    elif not parsed["quoting"]:
        assert parsed["n_fields"] == len(fields) or text == ""


def test_constants():
    assert NEXT.shape == (5, 4) and (NEXT[:, END] == FIELD_START).all() and NEXT[QUOTED, 1] == QUOTED and NEXT[BAD, 2] == BAD
    pytest.importorskip("pyarrow")
