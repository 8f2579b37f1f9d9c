"""Problem 5: variant spellings of the names of one person.

Method: every canonical rewriting of a name (nicknames written out, legal forms, no token order, initials) is exploded
and equi-joined. A rewriting alone is shared by thousands of namesakes, so it is joined together with two agreeing
attributes of birth date, contact and place. A pair's score is the rarity of its shared rewritings; an exact check of
names and attributes follows. Records with one attribute equal and the birth date or contact of another mistyped meet
by the equal one and the unharmed part of the other (near_keys). Records that are equal in all these fields are one class, so copies join nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.skew import block_join
from .persons import DEFAULT, Lexicon, Name, birth_parts, births_agree, births_near, contacts_near, forms, one_person, parse_birth

NAMES = ["norm_last_name", "norm_first_name", "norm_middle_name", "norm_extension_name"]
#: The rarity of a form is counted if more than this share of the records has it; there are few such forms at any size, all others weigh alike.
COUNTED_SHARE = 1 / 2000


def attributes() -> list[Column]:
    """The compared fields of a person record, cleaned as far as the JVM can: names, birth, contact, place, sex."""
    digits = F.right(F.regexp_replace(F.coalesce(F.col("contact_no_norm"), F.lit("")), "[^0-9]", ""), F.lit(10))
    birth = F.trim(F.coalesce(F.col("birthdate_iso"), F.lit("")))
    return [
        *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in NAMES),
        F.when(birth != "1900-01-01", birth).otherwise("").alias("birth"),
        F.when((F.length(digits) == 10) & ~digits.rlike(r"^(\d)\1*$"), digits).otherwise("").alias("contact"),
        F.trim(F.coalesce(F.col("barangay_code"), F.lit(""))).alias("place"),
        F.upper(F.substring(F.trim(F.coalesce(F.col("sex"), F.lit(""))), 1, 1)).alias("sex"),
    ]


FIELDS = [*NAMES, "birth", "contact", "place", "sex"]


def class_id() -> Column:
    """128 bits of the compared fields: records that are equal in all of them are one class."""
    fields = F.to_json(F.array(*FIELDS))
    return F.unhex(F.md5(fields))


def agreement_keys() -> Column:
    """Hashes of the three pairs of attributes, without those of which one is missing."""
    pair = lambda n, a, b: F.when((F.col(a) != "") & (F.col(b) != ""), F.xxhash64(F.lit(n), a, b))
    return F.array_compact(F.array(pair(1, "birth", "place"), pair(2, "birth", "contact"), pair(3, "contact", "place")))


def may_agree(a: str, b: str) -> Column:
    """Whether the exact check (persons.one_person) needs to see a pair, told by its attributes without its names.

    ``a`` and ``b`` name the columns of either record. Two attributes must agree, or one and another be near; births in any
    other form than YYYY-MM-DD are left to the check.
    """
    x, y = (lambda c: F.col(a.format(c))), (lambda c: F.col(b.format(c)))
    agree = lambda c: (x(c) == y(c)) & (x(c) != "")
    iso = r"^(\d{4}-\d{2}-\d{2})?$"
    odd = ~(x("birth").rlike(iso) & y("birth").rlike(iso))
    count = sum((agree(c).cast("int") for c in ("birth", "contact", "place")), F.lit(0))
    turned = F.concat(F.substring(y("birth"), 1, 5), F.substring(y("birth"), 9, 2), F.lit("-"), F.substring(y("birth"), 6, 2))
    near = (F.levenshtein(x("birth"), y("birth")) == 1) | (x("birth") == turned) & (x("birth") != y("birth")) | F.levenshtein(x("contact"), y("contact")).between(1, 2)
    sex = (x("sex") == y("sex")) | (x("sex") == "") | (y("sex") == "")
    return sex & (odd | (count >= 2) | (count == 1) & near)


def near_keys() -> Column:
    """Hashes by which records meet that have one attribute equal and another one mistyped: two whose births or contacts are near share one.

    The place, which many share, is joined with the initials of given and family name. ``year`` and ``day`` are the birth_parts.
    """
    year, day, whole, placed = F.col("year") != "", F.col("day") != "", F.length("contact") == 10, (F.col("place") != "") & (F.col("lead") != "")
    parts = [(year, (F.lit("y"), F.col("year"))), (day, (F.lit("d"), F.col("day"))), (whole, (F.lit("p"), F.substring("contact", 1, 5))), (whole, (F.lit("s"), F.substring("contact", 6, 5)))]
    keys = [F.when(whole & has, F.xxhash64(F.lit("c"), "contact", *x)) for has, x in parts[:2]]
    keys += [F.when(day & has, F.xxhash64(F.lit("b"), "year", "day", *x)) for has, x in parts[2:]]
    keys += [F.when(placed & has, F.xxhash64(F.lit("a"), "place", "lead", *x)) for has, x in parts]
    return F.array_compact(F.array(*keys))


def with_forms(classes: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Classes with the forms and initials of their names and the parts of their births."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*NAMES, "birth"]}
            names = [Name(*n, lexicon) for n in zip(*(at[c] for c in NAMES))]
            births = [birth_parts(b) for b in at["birth"]]
            made = [pa.array([forms(n) for n in names], pa.list_(pa.string())), *(pa.array(x, pa.string()) for x in ([n.lead for n in names], [y for y, _ in births], [d for _, d in births]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "forms", "lead", "year", "day"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kept}, forms array<string>, lead string, year string, day string")


def counted_forms(formed: DataFrame, share: float = COUNTED_SHARE) -> tuple[dict[str, int], int]:
    """Count of each form that more than a share of all records has (at most forms-per-record / share of them), and the records."""
    n = formed.count()
    rows = formed.select(F.explode("forms").alias("form")).groupBy("form").count().where(F.col("count") > n * share).collect()
    return {r["form"]: r["count"] for r in rows}, n


def rarity(shared: set[str], counts: dict[str, int], n: int, share: float = COUNTED_SHARE) -> float:
    """Sum of -log(share of records) over shared forms; a form below the counted share weighs as that share."""
    return sum(-math.log(counts[f] / n) if f in counts else -math.log(share) for f in shared)


def name_variants(records: DataFrame, record: str = "internal_uuid", min_rarity: float = 0.0, other_names_only: bool = True, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(uuid_a, uuid_b, rarity), uuid_a < uuid_b: pairs of records of one person, by default those with differently typed names.

    Rarity ranks pairs; unless ``min_rarity`` is set, none that the exact check accepts is left out for a common name.
    Null and empty are equal in every field. Records without two of birth date, contact and place, or without any
    name, join nothing. Repeated ids count as records; a null id is dropped. An empty table gives no rows.
    """
    base = records.where(F.col(record).isNotNull()).select(F.col(record).alias("uuid"), *attributes()).withColumn("id", class_id())
    classes = durable(with_forms(base.groupBy("id", *FIELDS).agg(F.count(F.lit(1)).alias("copies")).withColumn("h", F.xxhash64(*FIELDS)), lexicon), "classes")
    formed = classes.select("h", agreement_keys().alias("keys"), "forms").where(F.size("keys") > 0)
    counts, n = counted_forms(formed)
    # Blocks carry 64 bits of a class; where two classes share them, both are compared with what they meet.
    rows = formed.select("h", "keys", F.explode("forms").alias("form")).select("h", "form", F.explode("keys").alias("key")).select("h", F.xxhash64("key", "form").alias("k"))
    rows = rows.unionByName(classes.select("h", F.explode(near_keys()).alias("k")))
    pairs = block_join(rows.withColumnRenamed("h", "h_a"), rows.withColumnRenamed("h", "h_b"), "k", "h_a", 32 * classes.count()).where("h_a < h_b").select("h_a", "h_b").distinct()
    side = lambda x: classes.select(*(F.col(c).alias(f"{c}_{x}") for c in ["h", "id", *FIELDS]))
    two = pairs.join(side("a"), "h_a").join(side("b"), "h_b")
    differ = ~F.lit(True)
    for c in NAMES:
        differ = differ | (F.col(f"{c}_a") != F.col(f"{c}_b"))
    if other_names_only:
        two = two.where(differ)
    two = two.where(may_agree("{}_a", "{}_b"))
    shared_counts = records.sparkSession.sparkContext.broadcast(counts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_counts.value
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f"{c}_{x}")).to_pylist() for x in "ab" for c in FIELDS[:7]]
            keep, scores = [], []
            for i, row in enumerate(zip(*columns)):
                a, b = Name(*row[:4], lexicon), Name(*row[7:11], lexicon)
                birth_a, birth_b = row[4], row[11]
                births = parse_birth(birth_a), parse_birth(birth_b)
                birth = 2 if birth_a and birth_a == birth_b else births_agree(*births)
                near = births_near(*births) or contacts_near(row[5], row[12])
                if one_person(a, b, birth, bool(row[5]) and row[5] == row[12], bool(row[6]) and row[6] == row[13], True, near):
                    score = rarity({*forms(a)} & {*forms(b)}, counts, n)
                    if score >= min_rarity:
                        keep.append(i)
                        scores.append(score)
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(scores, pa.float64())], names=["id_a", "id_b", "rarity"])

    ordered = two.select("id_a", "id_b", *(f"{c}_{x}" for x in "ab" for c in FIELDS[:7]))
    found = durable(ordered.mapInArrow(verify, "id_a binary, id_b binary, rarity double"), "variants")
    if not other_names_only:  # pairs within a class: its records are equal in all fields, so one of them stands for the others
        same = classes.where("copies > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("rarity"))
        found = found.unionByName(same)
    of = lambda x: base.select(F.col("id").alias(f"id_{x}"), F.col("uuid").alias(f"u_{x}"))
    out = found.join(of("a"), "id_a").join(of("b"), "id_b").where("u_a <> u_b and (id_a <> id_b or u_a < u_b)")
    return out.select(F.least("u_a", "u_b").alias("uuid_a"), F.greatest("u_a", "u_b").alias("uuid_b"), "rarity")
