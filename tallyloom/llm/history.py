"""Problem 2: new batches of person records checked against everything accepted before, without reprocessing it.

Method: each record's content is winnowed to fingerprints of short grams, so that a typing error leaves some of them
alone; they live in a persistent store (a folder of tables) next to partitioned Bloom filters. A batch's fingerprints are first tested against the filter of their partition; only
positives are looked up in the store, in the partitions that hold them; what they hit must share a coverage of one run
of the content and then pass an exact check of names and attributes. Store, filters and accepted records are updated
with the batch. The history is read for a lookup, but neither fingerprinted nor compared again.

The folder holds records, fingerprints and filters by batch and partition, and a manifest for each batch, written last:
a batch whose job was lost leaves files that no manifest names, and can be offered again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import drop, durable, new_path, shuffles_freed
from ..operators.skew import block_join
from .persons import DEFAULT, Lexicon, Name, births_agree, births_near, contacts_near, one_person, parse_birth
from .variants import FIELDS, NAMES, attributes, may_agree

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Partition numbers of segment s begin at s times this.
STRIDE = 1 << 20
RECORD = ["uuid", "ord", "root", "root_ord", "id", *FIELDS, "reference"]
RECORD_SCHEMA = f"uuid string, ord long, root string, root_ord long, id long, {', '.join(f'{c} string' for c in FIELDS)}, reference string, batch int, part int"
FINGERPRINT_SCHEMA = "fp long, id long, batch int, part int"
FILTER_SCHEMA = "bits binary, batch int, part int"


@dataclass(frozen=True)
class Run:
    """A run of content: some fields' parts joined, grams of ``k`` characters (of all but -k if negative), the least of every ``window`` kept.

    Texts that have ``k + window - 1`` characters in a row in common share a fingerprint. So the parts in which a typing
    error may fall stand at the ends of a run, what tells most stands next to the middle, and every gram is a rare one.
    A pair must share ``coverage`` of the fingerprints that the run of the new record has, and one at least.
    """

    fields: tuple[str, ...]
    parts: tuple[str, ...]
    k: int
    window: int
    coverage: float = 0.0


#: Two records that agree in two attributes, or in names and reference, share one run whole. Of those with one of them equal and
#: another one near (persons.births_near, contacts_near) one half of the near one is equal, so a run joins each half with the other attribute:
#: its 13 to 16 characters in a row are one fingerprint, and no gram straddles both halves, which told less and made over a third more fingerprints.
#: Where the place is the equal one and the birth date near, it is so common that the initials of given and family name must be equal as well.
#: Grams of birth and place without these are the least rare, so a pair must share most of them.
RUNS = (
    Run(("birth", "contact"), ("tail", "birth"), 12, 2),
    Run(("birth", "contact"), ("birth", "head"), 12, 2),
    Run(("birth", "contact"), ("day", "contact"), 12, 3),
    Run(("birth", "contact"), ("contact", "year"), 12, 3),
    Run(("birth", "place"), ("birth", "turned"), 15, 2, 0.8),
    Run(("name", "reference"), ("name", "reference"), -6, 4, 0.8),
    Run(("place", "contact"), ("tail", "place"), 14, 2),
    Run(("place", "contact"), ("place", "head"), 14, 2),
    Run(("birth", "place"), ("turned", "lead", "year"), 15, 2),
    Run(("birth", "place"), ("turned", "lead", "day"), 15, 2),
)


def _grams(texts: list[str], salt: int, k: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of one length at a time: their places in the list, and a row for each with the least hash of every ``window`` neighbouring grams; shorter texts are one gram."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    with np.errstate(over="ignore"):
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            size = k if k > 0 else max(1, n + k)
            width = max(n, size)
            codes = np.frombuffer("".join(texts[i].ljust(width) for i in which).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(which), width)
            grams = np.lib.stride_tricks.sliding_window_view(codes, size, axis=1)
            h = np.full(grams.shape[:2], salt, np.uint64)
            for j in range(size):
                h = (h ^ grams[:, :, j].astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
            views = np.lib.stride_tricks.sliding_window_view(h, min(window, h.shape[1]), axis=1)
            yield which, np.sort(views.min(axis=2), axis=1)


def winnowed(texts: list[str], salt: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, fp, n): the fingerprints of texts, by the text's place in the list, n being how many distinct ones it has."""
    taken, found, sizes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for which, least in _grams(texts, salt, k, window):
        first = np.ones(least.shape, bool)
        first[:, 1:] = least[:, 1:] != least[:, :-1]
        n = first.sum(axis=1)
        taken.append(np.repeat(which, n))
        found.append(least[first])
        sizes.append(np.repeat(n, n))
    return np.concatenate(taken), np.concatenate(found), np.concatenate(sizes)


def winnow(texts: list[str], salt: int, k: int, window: int) -> list[np.ndarray]:
    """The fingerprints of each text."""
    text, fp, _ = winnowed(texts, salt, k, window)
    return [fp[text == i] for i in range(len(texts))]


def content(at: dict[str, list[str]], lexicon: Lexicon = DEFAULT) -> dict[str, list[str]]:
    """The fields of records and the parts of them that runs name."""
    birth = [b.replace("-", "") for b in at["birth"]]
    return at | {
        "birth": birth, "year": [b[:4] for b in birth], "day": [b[4:] for b in birth],
        # The first digits of a number are nearly alike in all, so of the head the last digit stands first.
        "head": [c[4::-1] for c in at["contact"]], "tail": [c[5:] for c in at["contact"]], "turned": [p[2:] + p[:2] for p in at["place"]],
        "lead": [Name(*r, lexicon).lead.replace(".", "").ljust(2) for r in zip(*(at[c] for c in NAMES))],
        "name": [f"{a} {b}" if a and b else "" for a, b in zip(at["norm_first_name"], at["norm_last_name"])],
    }


def run_texts(at: dict[str, list[str]], run: Run) -> tuple[list[int], list[str]]:
    """The records that have a run's fields, by their places, and their texts."""
    full = [i for i, fields in enumerate(zip(*(at[f] for f in run.fields))) if all(fields)]
    return full, ["".join(parts) for parts in zip(*([at[p][i] for i in full] for p in run.parts))]


#: The number of a birth date that isn't given as YYYY-MM-DD.
_ODD = 99_999_999


def traits() -> Column:
    """Birth date, contact and sex of a record as digits of one number: what may_meet asks for."""
    birth = F.when(F.col("birth").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("birth") != "0000-00-00"), F.regexp_replace("birth", "-", "").try_cast("long")).when(F.col("birth") == "", 0).otherwise(_ODD)
    sex = F.when(F.col("sex") == "M", 1).when(F.col("sex") == "F", 2).otherwise(0)
    return (sex.cast("long") * 10**8 + birth) * 10**10 + F.coalesce(F.col("contact").try_cast("long"), F.lit(0))


def may_meet(a: str, b: str) -> Column:
    """False only for traits of two records that may_agree and the exact check reject whatever their places: births and contacts neither equal nor near, or another sex."""
    part = lambda c, below, size: F.pmod(F.expr(f"{c} div {below}"), F.lit(size))
    (x, y), (p, q), (s, t) = ([part(c, below, size) for c in (a, b)] for below, size in ((10**10, 10**8), (1, 10**10), (10**18, 10)))
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    turned = F.floor(x / 10000) * 10000 + F.pmod(x, F.lit(100)) * 100 + F.floor(F.pmod(x, F.lit(10000)) / 100)
    births = (x == _ODD) | (y == _ODD) | (x != 0) & (y != 0) & ((turned == y) | (F.levenshtein(digits(x, 8), digits(y, 8), 1) >= 0))
    contacts = (p != 0) & (q != 0) & (F.levenshtein(digits(p, 10), digits(q, 10), 2) >= 0)
    return ((s == t) | (s == 0) | (t == 0)) & (births | contacts)


def fingerprints(records: DataFrame, lexicon: Lexicon = DEFAULT, beside: tuple[str, ...] = ()) -> DataFrame:
    """(fp, run, n, ord, id): the fingerprints of each record's runs, n being how many the run has; ``beside`` names further numbers of a record to be carried along."""
    columns = ["ord", "id", *beside, "birth", "contact", "place", "reference", *NAMES]
    kept = 2 + len(beside)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = content({c: batch.column(i).to_pylist() for i, c in enumerate(columns) if i >= kept}, lexicon)
            for r, run in enumerate(RUNS):
                full, texts = run_texts(at, run)
                if full:
                    text, fp, n = winnowed(texts, r + 1, run.k, run.window)
                    taken = pa.array(np.array(full, np.int64)[text])
                    numbers = [pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), r, np.int8)), pa.array(n.astype(np.int16))]
                    yield pa.RecordBatch.from_arrays([*numbers, *(batch.column(i).take(taken) for i in range(kept))], names=["fp", "run", "n", *columns[:kept]])

    return records.select(*columns).mapInArrow(all_of, ", ".join(["fp long, run byte, n short", *(f"{c} long" for c in columns[:kept])]))


def fingerprint_count(records: DataFrame) -> int:
    """About how many fingerprints records have, from their fields alone; sizes a segment before they are made."""
    names = F.when((F.col("norm_first_name") != "") & (F.col("norm_last_name") != ""), F.lit(1))
    both = lambda a, b: F.count(F.when((F.col(a) != "") & (F.col(b) != ""), F.lit(1)))
    # Of n - k + 1 grams of a text, 1 + (n - k + 1 - window) * 2 / (window + 1) are expected to be the least of a window.
    weighed = 4 * both("birth", "contact") + 2 * both("place", "contact") + 4.4 * both("birth", "place") + 2.4 * F.count(F.when(F.col("reference") != "", names))
    return int(records.agg(weighed.alias("n")).first()["n"])


def _unlike(fp: DataFrame) -> DataFrame:
    """A column of fingerprints without those repeated nearby, so that one that many records share fills no task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column(0).to_numpy()))], names=["fp"])

    return fp.select("fp").mapInArrow(run, "fp long")


class Bloom:
    """A Bloom filter of a partition's fingerprints; double hashing on their 64 bits."""

    def __init__(self, bits: bytes | None, size: int, probes: int = 7):
        self.table = np.frombuffer(bits, np.uint8).copy() if bits else np.zeros(size // 8, np.uint8)
        self.probes = probes

    def _places(self, fp: np.ndarray) -> Iterator[np.ndarray]:
        m = np.uint64(len(self.table) * 8)
        with np.errstate(over="ignore"):
            a = fp.astype(np.uint64) * _MIX
            b = (a >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
            for i in range(self.probes):
                yield (a + np.uint64(i) * b) % m

    def add(self, fp: np.ndarray) -> None:
        for at in self._places(fp):
            np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def might_hold(self, fp: np.ndarray) -> np.ndarray:
        out = np.ones(len(fp), bool)
        for at in self._places(fp):
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def prepared(rows: DataFrame, ord_column: Column, record: str = "internal_uuid", reference: str = "source_reference") -> DataFrame:
    """The compared fields of each row with an id; a table without references has none. ids are 64 bits of the record's name and order; where two records share them, both are compared."""
    said = F.trim(F.coalesce(F.col(reference), F.lit(""))) if reference in rows.columns else F.lit("")
    base = rows.where(F.col(record).isNotNull()).select(F.col(record).alias("uuid"), ord_column.cast("long").alias("ord"), *attributes(), said.alias("reference"))
    return base.withColumn("id", F.xxhash64("uuid", "ord"))


@dataclass
class Segment:
    """A range of batches with one number of partitions; ``filters`` is the batch with its latest filters."""

    partitions: int
    fingerprints: int
    filters: int


class FingerprintStore:
    """What has been accepted, in a folder: records, fingerprints and filters.

    A pair must share the coverage of one run of the new record, or ``coverage`` if given. A segment takes
    ``partition_rows`` fingerprints a partition, with ``bits`` bits in its filter for each; when it is full, a segment
    twice as large as all before is opened, so there are few segments, no filter fills up and nothing is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, partition_rows: int = 500_000, bits: int = 10, coverage: float | None = None, least_partitions: int = 8, lexicon: Lexicon = DEFAULT):
        """Opens the store in a folder, or a new one; without a path it lives as long as the session."""
        self.spark, self.coverage, self.lexicon = spark, coverage, lexicon
        self.path = path or new_path(spark, "store")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.batches, self.order, self.segments = 0, 0, []
        self.partition_rows, self.bits, self.least = partition_rows, bits, least_partitions
        if found := self._manifests():
            state = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/manifests/{max(found)}").collect()))
            self.batches, self.order, self.partition_rows, self.bits, self.least = (state[k] for k in ("batches", "order", "partition_rows", "bits", "least"))
            self.segments = [Segment(**s) for s in state["segments"]]

    def _manifests(self) -> list[str]:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _commit(self) -> None:
        state = {"batches": self.batches, "order": self.order, "partition_rows": self.partition_rows, "bits": self.bits, "least": self.least, "segments": [asdict(s) for s in self.segments]}
        draft, final = (self._hadoop.Path(f"{self.path}/{x}") for x in ("manifest.draft", f"manifests/{self.batches:08d}.json"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.rename(draft, final)

    def _table(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """A table of committed batches, read in the given partitions only."""
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") < self.batches)
        return df if parts is None else df.where(F.col("part").isin(parts))

    def _write(self, df: DataFrame, name: str) -> None:
        """df as a batch of a table, in its partitions; a partition that is too large is written by several tasks."""
        path = f"{self.path}/{name}/batch={self.batches}"
        with shuffles_freed(self.spark):
            df.hint("rebalance", "part").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)

    def _part(self, c: Column, segment: int) -> Column:
        return (F.pmod(F.xxhash64(c), F.lit(self.segments[segment].partitions)) + segment * STRIDE).cast("int")

    def _touched(self, df: DataFrame) -> list[int] | None:
        """The partitions that a durable table names, None for all: more rows than partitions touch them all."""
        if df.count() > 4 * sum(s.partitions for s in self.segments):  # answered from the files' footers
            return None
        return sorted(r[0] for r in df.where("part is not null").select("part").distinct().collect())

    def _size(self) -> int:
        return max(1024, self.partition_rows * self.bits // 8 * 8)

    def _positives(self, fresh: DataFrame, rows: int) -> DataFrame:
        """(fp, part), each once, of a batch's fingerprints: where the filter of a partition may hold one."""
        size = self._size()
        places = []
        for i, s in enumerate(self.segments):
            # A batch much larger than a segment is tested in chunks, each with a copy of the filter.
            chunks = max(1, -(-rows // (s.partitions * self.partition_rows)))
            places.append(F.struct(self._part(F.col("fp"), i).alias("part"), F.pmod(F.shiftrightunsigned(F.col("fp"), 7), F.lit(chunks)).cast("int").alias("chunk"), F.lit(chunks).alias("chunks")))
        asked = _unlike(fresh).select("fp", F.explode(F.array(*places)).alias("x")).select("fp", "x.*")
        latest = F.lit(False)
        for i, s in enumerate(self.segments):
            latest = latest | ((F.col("batch") == s.filters) & (F.floor(F.col("part") / STRIDE) == i))
        chunks = F.lit(1)
        for i, s in enumerate(self.segments):
            chunks = F.when(F.floor(F.col("part") / STRIDE) == i, F.lit(max(1, -(-rows // (s.partitions * self.partition_rows))))).otherwise(chunks)
        filters = self._table("filters", FILTER_SCHEMA).where(latest).select("part", "bits", chunks.alias("chunks"))
        if rows <= 4 * sum(s.partitions for s in self.segments):  # more rows than partitions ask all filters
            filters = filters.join(asked.select("part").distinct(), "part")
        filters = filters.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("part", "chunk", "bits")

        def test(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            fp = np.unique(new["fp"].to_numpy(dtype=np.int64))
            held = Bloom(old["bits"].iloc[0], size).might_hold(fp) if len(old) and len(fp) else np.zeros(len(fp), bool)
            return pd.DataFrame({"fp": fp[held], "part": np.full(int(held.sum()), key[0], np.int32)})

        return asked.select("fp", "part", "chunk").groupBy("part", "chunk").cogroup(filters.groupBy("part", "chunk")).applyInPandas(test, "fp long, part int")

    def _remember(self, batch: DataFrame, made: DataFrame, rows: int) -> None:
        """Appends a batch with its fingerprints, updates the filters of the open segment, and commits."""
        last = self.segments[-1] if self.segments else None
        if last is None or last.fingerprints + rows > last.partitions * self.partition_rows:
            total = sum(s.fingerprints for s in self.segments) + rows
            self.segments.append(Segment(max(self.least, -(-2 * total // self.partition_rows)), 0, -1))
        at, size = len(self.segments) - 1, self._size()
        now = self.segments[at]
        old = self._table("filters", FILTER_SCHEMA).where(F.col("batch") == now.filters).select("part", "bits")

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blooms: dict[int, Bloom] = {}
            flush = lambda: pa.RecordBatch.from_pydict({"bits": [b.table.tobytes() for b in blooms.values()], "part": pa.array(list(blooms), pa.int32())})
            for rows in batches:
                fp, parts = (rows.column(i).to_numpy() for i in (0, 1))
                for p in np.unique(parts).tolist():
                    blooms.setdefault(p, Bloom(None, size)).add(fp[parts == p])
                if len(blooms) > 64:
                    yield flush()
                    blooms.clear()
            if blooms:
                yield flush()

        def together(key: tuple, filters: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(size // 8, np.uint8)
            for x in filters["bits"]:
                bits |= np.frombuffer(x, np.uint8)
            return pd.DataFrame({"bits": [bits.tobytes()], "part": np.array([key[0]], np.int32)})

        # One table after the other, as each is on disk twice while it is written, and filters from the fingerprints as written.
        self._write(batch.select(*RECORD).withColumn("part", self._part(F.col("id"), at)), "records")
        self._write(made.select("fp", "id", self._part(F.col("fp"), at).alias("part")), "fingerprints")
        written = self.spark.read.schema("fp long, part int").parquet(f"{self.path}/fingerprints/batch={self.batches}")
        # A file holds one partition, so a task makes few filters; only these are moved, no fingerprint is.
        filters = written.select("fp", "part").mapInArrow(partial, "bits binary, part int").unionByName(old)
        self._write(filters.groupBy("part").applyInPandas(together, "bits binary, part int"), "filters")
        self.segments[at] = Segment(now.partitions, now.fingerprints + rows, self.batches)
        self.batches += 1
        self._commit()

    def _verified(self, pairs: DataFrame, batch: DataFrame) -> DataFrame:
        """Durable covered pairs that are one person: (uuid, ord, old_uuid, old_ord, root, root_ord, within)."""
        touched = self._touched(pairs)
        old = self._table("records", RECORD_SCHEMA, touched).select(*RECORD) if self.segments and touched != [] else None
        own = batch.withColumns({"root": F.col("uuid"), "root_ord": F.col("ord")}).select(*RECORD)
        known = own if old is None else own.unionByName(old)
        b = known.select(F.col("id").alias("old_id"), *(F.col(c).alias(f"b_{c}") for c in ["uuid", "ord", "root", "root_ord", *FIELDS]))
        a = batch.select("id", *(F.col(c).alias(f"a_{c}") for c in ["uuid", "ord", *FIELDS]))
        two = b.join(pairs.select("id", "old_id", "within"), "old_id").join(a, "id").where("a_ord > b_ord").where(may_agree("a_{}", "b_{}"))
        out, lexicon = ["a_uuid", "a_ord", "b_uuid", "b_ord", "b_root", "b_root_ord", "within"], self.lexicon

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(out) :]))):
                    births = parse_birth(row[4]), parse_birth(row[11])
                    birth = 2 if row[4] and row[4] == row[11] else births_agree(*births)
                    near = births_near(*births) or contacts_near(row[5], row[12])
                    if one_person(Name(*row[:4], lexicon), Name(*row[7:11], lexicon), birth, bool(row[5]) and row[5] == row[12], bool(row[6]) and row[6] == row[13], True, near):
                        keep.append(i)
                taken = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(len(out))], names=["uuid", "ord", "old_uuid", "old_ord", "root", "root_ord", "within"])

        ordered = two.select(*out, *(f"a_{c}" for c in FIELDS[:7]), *(f"b_{c}" for c in FIELDS[:7]))
        return durable(ordered.mapInArrow(check, "uuid string, ord long, old_uuid string, old_ord long, root string, root_ord long, within boolean"), "links")

    def _covered(self, fresh: DataFrame, rows: int) -> DataFrame:
        """Durable (id, old_id, part, within): pairs that share enough of a run of the new record, part being where the old record lies.

        Pairs that share a place and half a contact grow as the product of batch and store, so what traits rule out is
        left where a fingerprint is joined, before pairs are counted, moved or written.
        """
        least = F.array(*(F.lit(r.coverage if self.coverage is None else self.coverage) for r in RUNS))[F.col("run")]
        part = F.lit(0)
        for i in range(len(self.segments)):
            part = F.when(F.col("segment") == i, self._part(F.col("old_id"), i)).otherwise(part)

        def covered(shared: DataFrame, within: bool) -> DataFrame:
            counted = shared.where(may_meet("traits", "old_traits")).groupBy("id", "old_id", "run", "segment").agg(F.count_distinct("fp").alias("shared"), F.first("n").alias("n"))
            pairs = counted.where(F.col("shared") >= F.col("n") * least).select("id", "old_id", "segment").distinct()
            return durable(pairs.select("id", "old_id", (F.lit(None).cast("int") if within else part).alias("part"), F.lit(within).alias("within")), "covered")

        # What is found in the batch and in the store is written in turn, so that the files of one join are gone before the next.
        a, b = fresh.select("fp", "run", "n", "ord", "id", "traits"), fresh.select("fp", F.col("ord").alias("old_ord"), F.col("id").alias("old_id"), F.col("traits").alias("old_traits"))
        found = [covered(block_join(a, b, "fp", "id", 2 * rows).where("ord > old_ord").withColumn("segment", F.lit(0)), True)]
        made: list[DataFrame] = []
        if self.segments:
            made = [durable(self._positives(fresh, rows), "positives")]
            touched = self._touched(made[0])
            if touched != []:
                held = self._table("fingerprints", FINGERPRINT_SCHEMA, touched).select("fp", F.col("id").alias("old_id"), F.floor(F.col("part") / STRIDE).cast("int").alias("segment"))
                # Few of the store's rows are hit, so they are reduced to these, once, before anything is moved for a batch's copies. A
                # filter forgets nothing, so one that is held in a partition is a positive there. Broadcasting pays only where the store is
                # much larger; a batch of a fixed share of it takes one plan at any size.
                asked = made[0].hint("merge") if 100 * made[0].count() > sum(s.fingerprints for s in self.segments) else made[0]
                made.append(durable(held.join(asked.select("fp"), "fp", "left_semi").withColumn("part", part), "hit"))
                old = self._table("records", RECORD_SCHEMA, self._touched(made[1])).select(F.col("id").alias("old_id"), traits().alias("old_traits"))
                hit = durable(made[1].drop("part").join(old, "old_id"), "hit")
                made.append(hit)
                found.append(covered(block_join(hit, a.drop("ord"), "fp", "old_id", 2 * rows), False))
        if len(found) > 1:
            made += found
            found = [durable(found[0].unionByName(found[1]), "covered")]
        for done in made:
            drop(done)
        return found[0]

    def accept(self, rows: DataFrame, ord_column: Column, record: str = "internal_uuid") -> None:
        """Takes rows in without looking for repeated persons: the history, each record under its own name."""
        batch = durable(prepared(rows, ord_column, record).withColumns({"root": F.col("uuid"), "root_ord": F.col("ord")}), "batch")
        self._remember(batch, fingerprints(batch, self.lexicon), fingerprint_count(batch))
        drop(batch)

    def offer(self, rows: DataFrame, ord_column: Column, record: str = "internal_uuid", shift: int | None = None) -> DataFrame:
        """(uuid, first), durable: the rows of a batch whose person was accepted before, in the store or by a smaller order in the batch, with that person's first record.

        Afterwards all rows are in the store, each under its person's first record. Order values must be positive,
        unique, and greater than those of all batches before. With ``shift``, rows are of several batches, those of one
        having one ``order >> shift``: the result is that of offering them one after the other, but the store is
        searched once for all.
        """
        batch = durable(prepared(rows, ord_column, record), "batch")
        fresh = durable(fingerprints(batch.withColumn("traits", traits()), self.lexicon, ("traits",)), "fresh")
        size = fresh.count()  # answered from the files' footers
        covered = self._covered(fresh, size)
        links = self._verified(covered, batch)
        # A row's label is the first record that it is linked with; labels spread over links within the offer until none changes.
        labels = durable(links.groupBy("uuid", "ord").agg(F.min(F.struct(F.col("root_ord").alias("o"), F.col("root").alias("r"))).alias("label")), "labels")
        edges = links.where("within")
        # A later batch learns from an earlier one, which was settled before and learns nothing.
        mutual = edges if shift is None else edges.where(F.shiftright("ord", shift) == F.shiftright("old_ord", shift))
        both = durable(mutual.select(F.col("ord").alias("x"), F.col("old_ord").alias("y"), F.col("old_uuid").alias("u")).unionByName(edges.select(F.col("old_ord").alias("x"), F.col("ord").alias("y"), F.col("uuid").alias("u"))), "both")
        changed = both.count()  # answered from the files' footers
        while changed:
            # Over an edge x-y, y learns x's label; u is y's name. A row without a label of its own is a first record so far.
            told = both.join(labels.select(F.col("ord").alias("x"), "label"), "x").select(F.col("u").alias("uuid"), F.col("y").alias("ord"), "label")
            spread = labels.unionByName(told).groupBy("uuid", "ord").agg(F.min("label").alias("label")).where("label.o < ord")
            following = durable(spread, "labels")
            was = labels.select("ord", F.col("label").alias("was"))
            changed = following.join(was, "ord", "left").where("was is null or was <> label").limit(1).count()
            drop(labels)
            labels = following
        accepted = batch.join(labels.select("ord", "label"), "ord", "left").withColumns({"root": F.coalesce("label.r", "uuid"), "root_ord": F.coalesce("label.o", "ord")})
        self._remember(accepted, fresh, size)
        repeated = durable(labels.select("uuid", F.col("label.r").alias("first")), "repeated")
        for done in (fresh, batch, covered, links, both, labels):
            drop(done)
        return repeated


def repeated_persons(history: DataFrame, batches: DataFrame, batch: str = "batch_no", row: str = "row_no", record: str = "internal_uuid", store: FingerprintStore | None = None) -> DataFrame:
    """(uuid_a, uuid_b), the smaller first: each batch row whose person was already accepted, with that person's first record.

    The history goes into a new store, or is in the given one already and ignored. Batches come in the order of their
    number, rows of a null number last. Rows without an id are not reported; rows without two of birth date, contact
    and place, and without names and reference, have no fingerprints and count as new. An empty history or no batch is
    allowed. The batches are offered together, so that the store is read once for all of them, with the result of offering
    one after the other. The list of batch numbers comes to the driver, no row does.
    """
    spark = batches.sparkSession
    if store is None:
        store = FingerprintStore(spark)
        store.accept(history, F.lit(0), record)
    numbers = sorted((r[0] for r in batches.select(batch).distinct().collect()), key=lambda n: (n is None, n))
    if not numbers:
        return spark.createDataFrame([], "uuid_a string, uuid_b string")
    places = spark.createDataFrame([(n, store.order + 1 + i) for i, n in enumerate(numbers)], f"__batch {batches.schema[batch].dataType.simpleString()}, __order long")
    store.order += len(numbers)
    rows = batches.join(F.broadcast(places), F.col(batch).eqNullSafe(F.col("__batch")))
    found = store.offer(rows, F.shiftleft("__order", 40) + F.coalesce(F.col(row), F.lit(1 << 39)), record, shift=40)
    return found.select(F.least("uuid", "first").alias("uuid_a"), F.greatest("uuid", "first").alias("uuid_b"))
