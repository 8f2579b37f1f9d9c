"""Problem 7: raw comma-separated records, the loadable ones typed and all others with the reason.

Method: a quote-aware finite-state tokenizer. The bytes of a batch are cut into equal chunks without regard to record
ends; each chunk's transition function (end state for every start state) is built for all chunks at once, the functions
are composed by a prefix scan, and a second pass from the then known start states marks separators and errors.
A record of any length is thus tokenized in parts that don't wait for each other. Values are checked in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEGACY_COLUMNS, PUBLIC_COLUMNS

FIELD_START, PLAIN, QUOTED, QUOTE_SEEN, BAD = range(5)
OTHER, COMMA, QUOTE, END = range(4)
#: State after a byte class; the end of a record leads to the start of the next.
NEXT = np.array(
    [
        [PLAIN, FIELD_START, QUOTED, FIELD_START],
        [PLAIN, FIELD_START, BAD, FIELD_START],
        [QUOTED, QUOTED, QUOTE_SEEN, FIELD_START],
        [BAD, FIELD_START, QUOTED, FIELD_START],
        [BAD, BAD, BAD, FIELD_START],
    ],
    np.uint8,
)
#: The same over lines of a file: a line end inside quotes ends no record.
NEXT_LINE = NEXT.copy()
NEXT_LINE[QUOTED, END] = QUOTED
END_BYTE = 0xFF  # occurs in no UTF-8 text
CLASS = np.zeros(256, np.uint8)
CLASS[[ord(","), ord('"'), END_BYTE]] = COMMA, QUOTE, END
ERRORS = {"": "", "bare": "quote inside an unquoted field", "after": "text after a closing quote", "open": "quote never closed"}


def chunk_transitions(classes: np.ndarray, table: np.ndarray = NEXT) -> np.ndarray:
    """End state of each chunk (row of byte classes) for each start state."""
    state = np.tile(np.arange(5, dtype=np.uint8), (len(classes), 1))
    for column in classes.T:
        state = table[state, column[:, None]]
    return state


def start_states(transitions: np.ndarray, first: int = FIELD_START) -> np.ndarray:
    """Start state of each chunk, by composing the transitions of all chunks before it in log2 steps."""
    composed, step = transitions.copy(), 1
    while step < len(composed):
        composed[step:] = np.take_along_axis(composed[step:], composed[:-step], axis=1)
        step *= 2
    return np.concatenate([[first], composed[:-1, first]]).astype(np.uint8)


def states_before(data: np.ndarray, chunk: int = 64, first: int = FIELD_START, table: np.ndarray = NEXT) -> np.ndarray:
    """The tokenizer's state before each byte."""
    padded = np.full(-(-len(data) // chunk) * chunk, END_BYTE, np.uint8)
    padded[: len(data)] = data
    classes = CLASS[padded].reshape(-1, chunk)
    states = np.empty(classes.shape, np.uint8)
    now = start_states(chunk_transitions(classes, table), first)
    for i in range(chunk):
        states[:, i] = now
        now = table[now, classes[:, i]]
    return states.ravel()[: len(data)]


def line_states(lines: list[bytes], first: int) -> tuple[np.ndarray, int]:
    """(state before each line, state after the last): a line continues a record if the state before it is QUOTED."""
    data = np.frombuffer(b"\xff".join(lines) + b"\xff", np.uint8)
    states = states_before(data, first=first, table=NEXT_LINE)
    ends = np.flatnonzero(data == END_BYTE)
    after = int(NEXT_LINE[states[-1], END])
    return states[np.concatenate([[0], ends[:-1] + 1])], after


PARSED = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("n_fields", T.IntegerType()),
        T.StructField("quoting", T.StringType()),
        T.StructField("byte_offset", T.LongType()),
    ]
)


def _parse(texts: list[str | None]) -> pa.StructArray:
    raw = [(t[:-1] if t.endswith("\r") else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    whole = b"\xff".join(raw) + b"\xff"
    data = np.frombuffer(whole, np.uint8)
    states = states_before(data)
    classes = CLASS[data]
    ends = np.flatnonzero(classes == END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = np.flatnonzero((classes == COMMA) & (states != QUOTED) & (states != BAD))
    wrong = np.flatnonzero((states != BAD) & (NEXT[states, classes] == BAD) | (classes == END) & (states == QUOTED))
    which = np.searchsorted(ends, wrong)
    error: dict[int, tuple[str, int]] = {}
    for at, r in zip(wrong[::-1].tolist(), which[::-1].tolist()):
        error[r] = (ERRORS["open" if classes[at] == END else "bare" if classes[at] == QUOTE else "after"], at - int(starts[r]))
    count = np.searchsorted(cuts, ends) - np.searchsorted(cuts, starts) + 1
    fields: list[list[str] | None] = []
    before = np.searchsorted(cuts, starts).tolist()
    cut, start, end, n = cuts.tolist(), starts.tolist(), ends.tolist(), count.tolist()
    for r, text in enumerate(raw):
        if r in error or n[r] not in (12, 14):
            fields.append(None)
            continue
        if b'"' not in text:
            fields.append(text.decode("utf-8", "surrogatepass").split(","))
            continue
        edges = [start[r] - 1, *cut[before[r] : before[r] + n[r] - 1], end[r]]
        parts = (whole[a + 1 : b] for a, b in zip(edges, edges[1:]))
        fields.append([(x[1:-1].replace(b'""', b'"') if x[:1] == b'"' else x).decode("utf-8", "surrogatepass") for x in parts])
    return pa.StructArray.from_arrays(
        [
            pa.array(fields, pa.list_(pa.string())),
            pa.array(n, pa.int32()),
            pa.array([error[r][0] if r in error else None for r in range(len(raw))], pa.string()),
            pa.array([error[r][1] if r in error else None for r in range(len(raw))], pa.int64()),
        ],
        names=["fields", "n_fields", "quoting", "byte_offset"],
    )


def tokenize(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """rows with a column ``parsed``: fields (null unless 12 or 14 of them are well quoted), n_fields, quoting error and its byte offset.

    One carriage return at the very end is not part of a record. A null text is an empty one: one field. A column that
    is already named ``parsed`` gives way.
    """
    source = rows.drop("parsed") if "parsed" in rows.columns else rows
    schema = T.StructType([*source.schema.fields, T.StructField("parsed", PARSED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parsed = _parse(batch.column(batch.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, parsed], names=[*batch.schema.names, "parsed"])

    return source.mapInArrow(run, schema)


def _field(n: int) -> Column:
    return F.regexp_replace(F.get(F.col("parsed.fields"), F.lit(n)), r"(?U)^\s+|\s+$", "")


def _is_day(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((m >= 1) & (m <= 12) & (d >= 1) & (d <= last), F.lit(False))


def _whole(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def _first(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(said)) for bad, said in checks))


def load_records(rows: DataFrame, geography: dict[str, DataFrame], text: str = "raw_text") -> DataFrame:
    """rows, each with its values or the reason why it cannot be loaded; no row is dropped.

    Added columns: layout (public, legacy or null), reason (quoting, column_count, value or null: loadable), detail
    (the error in words, with the offset or the field), and ``record``, a struct of trimmed values named as in the two
    layouts, null where there is a reason. ``geography`` maps region_code, province_code, city_code and barangay_code
    to tables with that column; each is fixed in size, and its distinct codes are broadcast. Of several faults the
    first in the order quoting, column_count, value counts, and within value the first field. Extra columns pass
    through; columns that bear an added name give way.
    """
    rows = rows.drop("layout", "reason", "detail", "record")
    df = tokenize(rows, text)
    public, legacy = F.col("parsed.n_fields") == 14, F.col("parsed.n_fields") == 12
    p = {name: _field(i) for i, name in enumerate(PUBLIC_COLUMNS)}
    g = {name: _field(i) for i, name in enumerate(LEGACY_COLUMNS)}
    names = [*dict.fromkeys([*PUBLIC_COLUMNS, *LEGACY_COLUMNS])]

    def value(name: str) -> Column:
        options = [F.when(kind, of[name]) for kind, of in ((public, p), (legacy, g)) if name in of]
        return F.coalesce(*options).alias(name)

    # Values are bound once, so that the checks below read columns and repeat no expression.
    sound = F.col("parsed.quoting").isNull()
    df = df.withColumn("record", F.when(sound & (public | legacy), F.struct(*(value(x) for x in names))))
    r = {name: F.col(f"record.{name}") for name in names}
    for code in ("region_code", "province_code", "city_code", "barangay_code"):
        known = geography[code].select(F.col(code).alias("__code")).where("__code is not null").distinct().withColumn(f"__{code}", F.lit(True))
        df = df.join(F.broadcast(known), r[code] == F.col("__code"), "left").drop("__code")
    parts = [r["month_mm"], r["day_dd"], r["year_yyyy"]]
    m, d, y = (_whole(c) for c in parts)
    given = sum((F.when(c != "", 1).otherwise(0) for c in parts), F.lit(0))
    iso = r["birthdate_iso"]
    iy, im, id_ = (F.substring(iso, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    blank = lambda name: (r[name] == "", f"{name} is required")
    value_error = F.when(
        public,
        _first(
            *(blank(x) for x in ("last_name", "first_name", "region", "province", "city_municipality", "barangay", "sex")),
            ((given > 0) & (given < 3), "month, day and year must be given together"),
            ((given == 3) & (m.isNull() | d.isNull() | y.isNull()), "month, day and year must be whole numbers"),
            ((given == 3) & ~(_is_day(y, m, d) & y.between(1800, 3000)), "birth date is not a valid calendar date"),
        ),
    ).when(
        legacy,
        _first(
            *(blank(x) for x in ("last_name", "first_name", "sex")),
            ((iso != "") & ~iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "birthdate_iso must be YYYY-MM-DD"),
            ((iso != "") & ~(_is_day(iy, im, id_) & (iy >= 1)), "birth date is not a valid calendar date"),
            *((F.col(f"__{x}").isNull(), f"{x} is not in its table") for x in ("region_code", "province_code", "city_code", "barangay_code")),
        ),
    )
    df = df.withColumn("__value", F.when(F.col("record").isNotNull(), value_error))
    reason = F.when(~sound, "quoting").when(~(public | legacy), "column_count").when(F.col("__value").isNotNull(), "value")
    detail = (
        F.when(~sound, F.concat("parsed.quoting", F.lit(" at byte "), F.col("parsed.byte_offset").cast("string")))
        .when(~(public | legacy), F.concat(F.lit("expected 14 or 12 columns, found "), F.col("parsed.n_fields").cast("string")))
        .otherwise(F.col("__value"))
    )
    df = df.withColumns({"layout": F.when(public, "public").when(legacy, "legacy"), "reason": reason, "detail": detail})
    return df.withColumn("record", F.when(F.col("reason").isNull(), F.col("record"))).select(*rows.columns, "layout", "reason", "detail", "record")


def file_report(loaded: DataFrame, reference: str = "source_reference", line: str = "line_no", samples: int = 10) -> DataFrame:
    """(source_reference, rows_read, row_count_invalid, rows_failed, sample_errors): one row per file, null being one.

    sample_errors are the messages of the first ``samples`` bad records by line. They are picked by a top-k within
    each task and again after the shuffle, so no file's errors meet in one task uncut.
    """
    from pyspark.sql import Window

    counts = loaded.groupBy(reference).agg(F.count(F.lit(1)).alias("rows_read"), F.count("reason").alias("row_count_invalid"))
    bad = loaded.where("reason is not null").select(F.col(reference).alias("__ref"), F.struct(F.col(line).alias("n"), F.concat(F.lit("row "), F.coalesce(F.col(line).cast("string"), F.lit("?")), F.lit(": "), "detail").alias("said")).alias("e"))
    top = bad.withColumn("k", F.row_number().over(Window.partitionBy("__ref").orderBy("e"))).where(F.col("k") <= samples)
    listed = top.groupBy("__ref").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["said"]).alias("sample_errors"))
    return counts.join(listed, F.col(reference).eqNullSafe(F.col("__ref")), "left").select(
        reference, "rows_read", "row_count_invalid", F.col("row_count_invalid").alias("rows_failed"), F.coalesce("sample_errors", F.array().cast("array<string>")).alias("sample_errors")
    )
