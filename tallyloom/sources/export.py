"""Export of records: policy, projection, formula guard, and one file with byte order mark and CRLF."""

from __future__ import annotations

import csv
import io
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, formula_guard
from ..schemas import PUBLIC_COLUMNS


def exportable(records: DataFrame, statuses: tuple[str, ...] = ("ACTIVE", "RETAINED"), withheld: tuple[str, ...] = ("POSSIBLE_DUPLICATE",)) -> DataFrame:
    """Records of some statuses, without some duplicate states; both lists are the caller's policy."""
    return records.where(F.col("record_status").isin(*statuses) & ~F.coalesce(F.col("duplicate_status").isin(*withheld), F.lit(False)))


def export_rows(records: DataFrame) -> DataFrame:
    """The 14 columns of the public layout: names else codes of places, padded date parts, every text guarded; null is ''."""
    two = lambda c, n: F.coalesce(F.lpad(F.col(c).cast("string"), n, "0"), F.lit(""))
    values = {
        "id": F.col("generated_id"), **{c: F.col(c) for c in ("last_name", "first_name", "middle_name", "extension_name")},
        "region": first_filled("region_name", "region_code"), "province": first_filled("province_name", "province_code"), "city_municipality": first_filled("city_name", "city_code"), "barangay": first_filled("barangay_name", "barangay_code"),
        "contact_no": F.col("contact_no"), "month_mm": two("birth_month", 2), "day_dd": two("birth_day", 2), "year_yyyy": two("birth_year", 4), "sex": F.col("sex"),
    }
    return records.select(*(formula_guard(F.coalesce(values[c], F.lit(""))).alias(c) for c in PUBLIC_COLUMNS))


def write_one_file(rows: DataFrame, path: str) -> int:
    """Rows, in their order, as one local file; they are streamed partition by partition, never held together."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part, n = f"{path}.part", 0
    with open(part, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(row)
            n += 1
    os.replace(part, path)
    return n


def write_many_files(rows: DataFrame, path: str) -> None:
    """The same format from all tasks at once, a file per task, each with the header."""
    rows.write.csv(path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_text(rows: list[list[str]], header: list[str]) -> str:
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\r\n").writerows([header, *rows])
    return buffer.getvalue()


def export_log(rows: DataFrame, path: str, export_id: str, at: str, by: str | None = None) -> DataFrame:
    """(export_id, file_name, export_type, rows_exported, created_at, performed_by): the log row of an export to a path."""
    name = path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    return rows.agg(F.count(F.lit(1)).alias("rows_exported")).select(F.lit(export_id).alias("export_id"), F.lit(name).alias("file_name"), F.lit("BENEFICIARIES").alias("export_type"), "rows_exported", F.lit(at).alias("created_at"), F.lit((by or "").strip() or None).cast("string").alias("performed_by"))
