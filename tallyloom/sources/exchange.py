"""Import files and exchange packages: headers, manifests, checksums, fingerprints, dimension files."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEGACY_COLUMNS, PUBLIC_COLUMNS
from .raw_records import FIELD_START, QUOTED, line_states

# Entries of a package and its version; columns of a dimension file that are used.
REQUIRED_ENTRIES = ("manifest.json", "beneficiaries.csv", "checksums.txt", "export_meta.json")
SPEC_VERSION = "v1"
MANIFEST_FIELDS = ("spec_version", "package_id", "created_at_utc", "source_lgu_name", "source_system_name", "rows_declared", "checksum_algorithm")
DIMENSION_POSITIONS = {"barangay_code": 21, "barangay_name": 23, "city_code": 24, "city_name": 25, "province_code": 26, "province_name": 27, "region_code": 28, "region_name": 29}


def layout_of(header: list[str]) -> str:
    """public or legacy: the header, trimmed and without a byte order mark, must be one of the two lists exactly."""
    names = [h.removeprefix("﻿").strip() if i == 0 else h.strip() for i, h in enumerate(header)]
    for layout, columns in (("public", PUBLIC_COLUMNS), ("legacy", LEGACY_COLUMNS)):
        if names == columns:
            return layout
    raise ValueError("the header is of neither layout")


def read_table(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """A file of either layout as text columns. The header decides if no layout is given; a wrong one is an error."""
    import csv

    if layout is None:
        first = spark.read.text(path).limit(1).first()
        layout = layout_of(next(csv.reader([first[0] if first else ""])))
    columns = PUBLIC_COLUMNS if layout == "public" else LEGACY_COLUMNS
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_reference, line_no, raw_text): the records of text files, for the fault-tolerant loader, cut at line feeds outside quotes.

    Files are read in blocks by the usual splits. Each block gives its transition function over line starts (inside a
    quote or not) with the number of records it begins in either case; these few numbers a block are composed at the
    driver, and a second pass cuts every block from its then known start. A quote opens only at the start of a field, so
    a stray one spoils its own line alone; one that is never closed runs on to the next quote. Record 1 is the header
    and is left out; a byte order mark and a carriage return at a record's end are dropped; empty lines are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
        """Runs of lines of one block, in order; a block may come in several runs."""
        for batch in batches:
            value, file, block = (c.to_pylist() for c in batch.columns)
            start = 0
            for i in range(1, len(value) + 1):
                if i == len(value) or (file[i], block[i]) != (file[start], block[start]):
                    yield file[start], block[start], [(v or "").encode("utf-8", "surrogatepass") for v in value[start:i]]
                    start = i

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[list[int]]] = {}
        for file, block, run in blocks(batches):
            found = ends.setdefault((file, block), [[FIELD_START, 0], [QUOTED, 0]])
            for f in found:
                before, f[0] = line_states(run, f[0])
                f[1] += sum(1 for s, t in zip(before.tolist(), run) if s != QUOTED and t.rstrip(b"\r"))
        yield pa.RecordBatch.from_pydict({"file": [k[0] for k in ends], "block": [k[1] for k in ends], **{f"{n}_{w}": [v[i][j] for v in ends.values()] for i, n in enumerate(("plain", "quoted")) for j, w in enumerate(("end", "records"))}}, pa.schema([("file", pa.string()), ("block", pa.int64()), *((f"{n}_{w}", pa.int64()) for n in ("plain", "quoted") for w in ("end", "records"))]))

    starts: dict[tuple[str, int], tuple[int, int]] = {}
    state, count, last = FIELD_START, 0, None
    for r in lines.mapInArrow(functions, "file string, block long, plain_end long, plain_records long, quoted_end long, quoted_records long").orderBy("file", "block").collect():
        if r["file"] != last:
            state, count, last = FIELD_START, 0, r["file"]
        starts[r["file"], r["block"]] = state, count
        name = "quoted" if state == QUOTED else "plain"
        state, count = r[f"{name}_end"], count + r[f"{name}_records"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple[str, int], list[int]] = {}
        for file, block, run in blocks(batches):
            at = now.setdefault((file, block), [*starts[file, block], 0])
            before, at[0] = line_states(run, at[0])
            numbers, pieces, texts = [], [], []
            for s, t in zip(before.tolist(), run):
                if s != QUOTED and not t.rstrip(b"\r"):
                    continue
                at[1] += s != QUOTED
                at[2] += 1
                numbers.append(at[1])
                pieces.append(at[2])
                texts.append(t.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(numbers, pa.int64()), pa.array([block] * len(texts), pa.int64()), pa.array(pieces, pa.int64()), pa.array(texts, pa.string())], names=["file", "number", "block", "piece", "text"])

    pieces = lines.mapInArrow(cut, "file string, number long, block long, piece long, text string")
    whole = pieces.groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))), lambda x: x["text"]), "\n").alias("text")).where("number > 1")
    name = F.element_at(F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/"), -1)
    line = F.col("number") - 1
    reference = F.concat(name, F.lit("#row="), F.when(line < 1_000_000, F.lpad(line.cast("string"), 6, "0")).otherwise(line.cast("string")))
    return whole.select(reference.alias("source_reference"), line.alias("line_no"), F.regexp_replace("text", "\r$", "").alias("raw_text"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, checksum): SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("checksum"))


def gate(checksum: str, stored: str | None) -> str:
    """new, same, or an error if a source of this name was taken in with other content."""
    if not stored:
        return "new"
    if stored != checksum:
        raise ValueError("the source has changed since it was taken in")
    return "same"


def checksum_list(text: str) -> dict[str, str]:
    """path -> hexadecimal digest, of lines '<digest>  <path>'."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if line.strip():
            parts = line.split(None, 1)
            if len(parts) != 2 or len(parts[0]) != 64:
                raise ValueError("a checksum line can't be read")
            out[parts[1].strip()] = parts[0].lower()
    return out


@dataclass(frozen=True)
class Package:
    manifest: dict
    table: str
    checksum: str


def open_package(content: bytes) -> Package:
    """A package after all checks: entries, names, manifest and digests."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if len(set(names)) != len(names):
            raise ValueError("an entry occurs twice")
        for n in names:
            if not n.strip() or n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n.split("/")[0]:
                raise ValueError(f"an entry has an unsafe name: {n!r}")
            if n not in REQUIRED_ENTRIES and n != "README.txt" and not n.startswith("attachments/"):
                raise ValueError(f"unexpected entry {n}")
        if missing := [n for n in REQUIRED_ENTRIES if n not in names]:
            raise ValueError(f"missing entries: {', '.join(missing)}")
        files = {n: z.read(n) for n in REQUIRED_ENTRIES}
    manifest = json.loads(files["manifest.json"])
    if any(f not in manifest for f in MANIFEST_FIELDS) or manifest["spec_version"] != SPEC_VERSION or str(manifest["checksum_algorithm"]).lower() != "sha256" or int(manifest["rows_declared"]) < 0:
        raise ValueError("the manifest is not of this version")
    listed = checksum_list(files["checksums.txt"].decode())
    for n in listed:
        if n not in REQUIRED_ENTRIES and n != "README.txt" and not n.startswith("attachments/"):
            raise ValueError(f"a checksum is listed for {n}")
    for n in ("manifest.json", "beneficiaries.csv", "export_meta.json"):
        if listed.get(n) != hashlib.sha256(files[n]).hexdigest():
            raise ValueError(f"the checksum of {n} is wrong")
    return Package(manifest, files["beneficiaries.csv"].decode("utf-8-sig"), hashlib.sha256(content).hexdigest())


def check_rows(package: Package, scanned: int) -> None:
    if int(package.manifest["rows_declared"]) != scanned:
        raise ValueError(f"the manifest declares {package.manifest['rows_declared']} rows, {scanned} were read")


def read_dimension(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """The eight used columns of a dimension file whose header is exactly the given list; every field is trimmed."""
    import csv

    first = spark.read.text(path).limit(1).first()
    if next(csv.reader([first[0] if first else ""])) != header:
        raise ValueError("the header of the dimension file is wrong")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    return df.select(*(F.trim(F.col(f"c{i}")).alias(n) for n, i in DIMENSION_POSITIONS.items()))
