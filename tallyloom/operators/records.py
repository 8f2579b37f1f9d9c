"""Person records: normal forms of a draft, validation, exact duplicates, duplicate candidates, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import birth_error, birth_iso
from ..functions.instants import iso_date
from ..functions.text import blank, blank_to_null, digits, entry_text, padded_id, with_provenance
from .durable import durable

NAMES = ("last_name", "first_name", "middle_name", "extension_name")
PLACES = ("region", "province", "city", "barangay")
LOOKUP_LIMIT = 25


def normalized(drafts: DataFrame) -> DataFrame:
    """drafts with cleaned texts, upper-case norm names and sex, contact digits and the canonical birth date with its parts; other columns pass.

    The parts of a birth date that cannot be read stay as they are.
    """
    texts = [*NAMES, "contact_no", *(f"{p}_{y}" for p in PLACES for y in ("code", "name"))]
    df = drafts.withColumns({c: entry_text(c) if c in NAMES[:2] else blank_to_null(entry_text(c)) for c in texts if c in drafts.columns})
    df = df.withColumns({f"norm_{c}": F.upper(c) for c in NAMES})
    birth = birth_iso(F.col("birthdate_iso"), F.col("birth_month"), F.col("birth_day"), F.col("birth_year"))
    df = df.withColumns({"contact_no_norm": F.nullif(digits("contact_no"), F.lit("")), "birthdate_iso": F.nullif(birth, F.lit("")), "sex": F.upper(F.coalesce(entry_text("sex"), F.lit("")))})
    day = iso_date(F.col("birthdate_iso"))
    return df.withColumns({c: F.coalesce(part(day).cast("long"), F.col(c)) for c, part in (("birth_month", F.month), ("birth_day", F.day), ("birth_year", F.year))})


def validation_error() -> Column:
    """The first fault of a draft in the fixed order names, places from the region down, sex, birth date; null if it is valid."""
    required = [*NAMES[:2], *(f"{p}_{y}" for p in PLACES for y in ("code", "name")), "sex"]
    return F.coalesce(*(F.when(blank(c), F.lit(f"{c} is required")) for c in required), birth_error(F.col("birthdate_iso"), F.col("birth_month"), F.col("birth_day"), F.col("birth_year")))


#: What a record is if nothing else is said.
DEFAULTS = {"record_status": "ACTIVE", "duplicate_status": "CLEAR", "source_type": "LOCAL"}


def with_defaults(drafts: DataFrame) -> DataFrame:
    """drafts whose statuses and source are trimmed and in capitals, the usual ones where they are blank."""
    return drafts.withColumns({c: F.coalesce(F.upper(blank_to_null(c)), F.lit(v)) for c, v in DEFAULTS.items()})


def created(drafts: DataFrame, store: DataFrame, order: list[Column], at: str, prefix: str = "G") -> DataFrame:
    """The records that valid drafts become, in the store's columns: cleaned, with defaults, stamps, an id each and a unique generated_id.

    A missing internal_uuid is made from the draft's order, so that a lost task makes the same one again. Drafts with
    a fault are left out (see validation_error); a generated_id that is taken gives way to the next free one.
    """
    valid = durable(drafts.where(validation_error().isNull()), "valid")
    made = F.sha2(F.concat_ws("|", F.lit(at), *(F.coalesce(o.cast("string"), F.lit("")) for o in order)), 256)
    shaped = F.concat_ws("-", F.substring(made, 1, 8), F.substring(made, 9, 4), F.concat(F.lit("4"), F.substring(made, 14, 3)), F.concat(F.lit("a"), F.substring(made, 18, 3)), F.substring(made, 21, 12))
    stamped = with_defaults(normalized(valid)).withColumns({"internal_uuid": F.coalesce(blank_to_null("internal_uuid"), shaped), "created_at": F.lit(at), "updated_at": F.lit(at), "deleted_at": F.lit(None).cast("string"), "source_reference": blank_to_null("source_reference")})
    return allocate_ids(durable(stamped, "created"), store, [o.asc() for o in order], prefix=prefix).select(*store.columns)


def found(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a unique key; none is an error."""
    row = df.where(F.col(key) == value).limit(1)
    if not row.count():
        raise LookupError(f"no row with {key} {value}")
    return row


def exact_key() -> Column:
    """A hash over the fields by which two records are exact duplicates; null and blank are equal."""
    fields = [*(f"norm_{c}" for c in NAMES), *(f"{p}_code" for p in PLACES), "birthdate_iso", "contact_no_norm", "sex"]
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.trim(F.col(c)), F.lit("")) for c in fields)), 256)


def exact_duplicates(drafts: DataFrame, store: DataFrame, draft_id: str = "internal_uuid") -> DataFrame:
    """(draft_id, duplicate_of): drafts equal to a record of the store that isn't deleted, with the least such record.

    The join carries one hash and one id per row; the store is reduced to one row per hash before it is joined.
    """
    known = store.where("record_status <> 'DELETED'").select(exact_key().alias("__k"), "internal_uuid").groupBy("__k").agg(F.min("internal_uuid").alias("duplicate_of"))
    return drafts.select(draft_id, exact_key().alias("__k")).join(known, "__k").select(draft_id, "duplicate_of")


#: Fields of a draft that candidates must equal, where the draft has them.
OPTIONAL = ("norm_middle_name", "norm_extension_name", "birthdate_iso", "contact_no_norm", "region_code", "province_code", "city_code", "barangay_code", "sex")


def duplicate_candidates(drafts: DataFrame, store: DataFrame, draft_id: str = "internal_uuid", limit: int = LOOKUP_LIMIT) -> DataFrame:
    """(draft_id, candidate, position): per draft the first ``limit`` records with its names; a filled optional field of the draft must match too.

    The limit is the lookup's page. The window keeps the best rows of a draft in each task before it shuffles them.
    Drafts without a last or a first name have no candidates.
    """
    names = ("norm_last_name", "norm_first_name")
    d = drafts.where(~blank(names[0]) & ~blank(names[1])).select(F.col(draft_id).alias("__d"), *(F.col(c).alias(f"d_{c}") for c in (*names, *OPTIONAL)))
    s = store.where("record_status <> 'DELETED'").select("internal_uuid", "generated_id", *names, *OPTIONAL)
    same = (F.col("d_norm_last_name") == F.col("norm_last_name")) & (F.col("d_norm_first_name") == F.col("norm_first_name")) & (F.col("__d") != F.col("internal_uuid"))
    for c in OPTIONAL:
        same = same & (blank(f"d_{c}") | (F.col(f"d_{c}") == F.col(c)))
    order = Window.partitionBy("__d").orderBy("norm_last_name", "norm_first_name", F.asc_nulls_first("norm_middle_name"), F.asc_nulls_first("norm_extension_name"), "generated_id", "internal_uuid")
    ranked = d.join(s, same).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return ranked.select(F.col("__d").alias(draft_id), F.col("internal_uuid").alias("candidate"), "position")


def precheck(drafts: DataFrame, store: DataFrame, draft_id: str = "internal_uuid") -> DataFrame:
    """(draft_id, candidates, exact, message) of every draft: how many records are offered, how many of these equal it, and what to say."""
    keys = lambda df, c, name: df.select(F.col(c).alias(c if c == draft_id and name == "__a" else "candidate"), exact_key().alias(name))
    own = drafts.select(draft_id, exact_key().alias("__a"))
    pairs = duplicate_candidates(drafts, store, draft_id).join(own, draft_id).join(keys(store, "internal_uuid", "__b"), "candidate")
    counts = pairs.groupBy(draft_id).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("__a") == F.col("__b")).alias("exact"))
    said = F.when(F.col("exact") > 0, "exact duplicate").when(F.col("candidates") > 0, "possible duplicates").otherwise("no duplicates")
    return drafts.select(draft_id).join(counts, draft_id, "left").fillna(0, ["candidates", "exact"]).withColumn("message", said)


def allocate_ids(accepted: DataFrame, taken: DataFrame, order: list[Column], preferred: str = "generated_id", prefix: str = "G", start: int = 1) -> DataFrame:
    """accepted rows with a unique generated_id: the preferred one for its first row if it is free, else the next free number.

    A collided row keeps the preferred id in its source_reference. Free numbers are the count of the rows before it
    plus the taken numbers below, found by one range-ordered numbering; no counter is locked and no row is collected.
    Numbers that preferred ids of this batch use count as taken.
    """
    from .ranking import global_row_number

    # Rows without a wish, often most, take no part in the search for the first of each wish.
    marked = accepted.withColumn("__want", blank_to_null(preferred))
    asked = marked.where("__want is not null").withColumn("__k", F.row_number().over(Window.partitionBy("__want").orderBy(*order)))
    asked = asked.join(taken.select(F.col("generated_id").alias("__t")).distinct(), F.col("__want") == F.col("__t"), "left").withColumn("__own", (F.col("__k") == 1) & F.col("__t").isNull()).drop("__t", "__k")
    own = asked.where("__own")
    rest = asked.where("not __own").unionByName(marked.where("__want is null").withColumn("__own", F.lit(False)))
    numbered = global_row_number(rest, order, "__n")
    pattern = f"^{prefix}-0*([1-9][0-9]*)$"
    number = lambda c: F.regexp_extract(c, pattern, 1).try_cast("long")
    used = taken.select(number(F.col("generated_id")).alias("u")).unionByName(own.select(number(F.col("__want")).alias("u"))).where(F.col("u") >= start).distinct()
    # The n-th free number is n plus the used numbers u with u - (its rank among used) < n.
    gaps = global_row_number(used, [F.asc("u")], "__r").select((F.col("u") - F.col("__r") - (start - 1)).alias("before")).groupBy("before").agg(F.count(F.lit(1)).alias("c"))
    both = numbered.select(F.col("__n").alias("x"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("row")).unionByName(gaps.select((F.col("before") + 1).alias("x"), "c", F.lit(False).alias("row")))
    placed = global_row_number(both, [F.asc("x"), F.asc("row")], "__p")
    running = _running_sum(placed, "__p", "c", "shift").where("row").select(F.col("x").alias("__n"), "shift")
    fresh = numbered.join(running, "__n").withColumn("generated_id", padded_id(F.col("__n") + F.col("shift") + (start - 1), prefix)).drop("__n", "shift")
    fresh = fresh.withColumn("source_reference", with_provenance("source_reference", "__want"))
    return own.withColumn("generated_id", F.col("__want")).unionByName(fresh).drop("__want", "__own")


def _running_sum(df: DataFrame, position: str, value: str, out: str, block: int = 100_000) -> DataFrame:
    """Sum of value over all positions up to a row's, by blocks of positions: two small windows instead of one global."""
    blocks = df.withColumn("__b", F.floor(F.col(position) / block))
    inner = F.sum(value).over(Window.partitionBy("__b").orderBy(position))
    sums = blocks.groupBy("__b").agg(F.sum(value).alias("__s"))
    carried = sums.withColumn("__c", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    return blocks.withColumn(out, inner).join(F.broadcast(carried), "__b").withColumn(out, F.col(out) + F.col("__c")).drop("__b", "__c")
