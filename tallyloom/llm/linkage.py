"""Problem 3: records of one person in two tables without a common key.

Method: MinHash candidate blocking across attributes, features of each pair's agreement, a logistic classifier trained
on weak labels, and probabilities calibrated on labels held out. The MinHash is of the q-grams of the name's words, in
bands of few values, each joined with the birth date: names that differ in a few letters meet if it is equal. Of two
equal attributes any names meet, which is the limit of bands of no value at all. Records with one attribute equal and
another one mistyped meet by keys of the equal one and the unharmed part of the other (variants.near_keys).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.skew import block_join
from .persons import DEFAULT, Lexicon, Name, birth_parts, births_agree, births_near, compare_names, contacts_near, forms, parse_birth
from .variants import COUNTED_SHARE, FIELDS, NAMES, agreement_keys, attributes, class_id, near_keys, rarity

#: The attributes with which a band of the name is joined. A place is too common for that, and a contact needs no band.
ANCHORS = ("birth",)
FEATURES = ("words", "typing errors", "initials", "contradiction", "rarity", "birth equal", "birth close", "birth far", "contact equal", "contact close", "place equal", "city equal", "sex differs", "weak name", "agreements", "near agreement")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Blocking:
    """q-gram length, bands, and MinHash values per band: more values make a block purer, more bands catch more errors.

    Two names of J equal q-grams among all of them meet with probability 1 - (1 - J ** rows) ** bands.
    """

    q: int = 3
    bands: int = 5
    rows: int = 3


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams of each row of a matrix of character codes."""
    windows = np.lib.stride_tricks.sliding_window_view(codes, q, axis=1).astype(np.uint64)
    h = np.zeros(windows.shape[:2], np.uint64)
    for k in range(q):
        h = (h ^ windows[:, :, k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def band_keys(texts: list[str], blocking: Blocking) -> np.ndarray:
    """A 64-bit block key of each text and band. Texts of one length are hashed together."""
    out = np.zeros((len(texts), blocking.bands), np.uint64)
    lengths = np.array([len(t) for t in texts])
    with np.errstate(over="ignore"):
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            width = max(n, blocking.q)
            flat = "".join(texts[i].ljust(width) for i in which)
            codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32).reshape(len(which), width)
            h = _hashes(codes, blocking.q)
            for band in range(blocking.bands):
                key = np.full(len(which), band + 1, np.uint64)
                for r in range(blocking.rows):
                    salt = np.uint64((band * 101 + r + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
                    m = (h ^ salt) * _MIX
                    m ^= m >> np.uint64(32)
                    key = (key ^ m.min(axis=1)) * _MIX
                    key ^= key >> np.uint64(31)
                out[which, band] = key
    return out


def name_text(name: Name) -> str:
    """The words of a name in their first formal reading and in alphabetical order, '' without a word."""
    return " ".join(sorted(min(name.lexicon.formal(w)) for w in name.words))


def blocks(records: DataFrame, blocking: Blocking, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(h, k): the block keys of each record: bands of its name with each anchor, its pairs of attributes, and its parts that a typing error leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [Name(*r, lexicon) for r in zip(*(c.to_pylist() for c in batch.columns[4:]))]
            births = [birth_parts(b) for b in batch.column(1).to_pylist()]
            texts = [name_text(n) for n in names]
            full = [i for i, t in enumerate(texts) if t]
            # The bands of a name stand in one array after the other; a record without a name has an empty list.
            ends = np.zeros(len(texts) + 1, np.int32)
            ends[1:] = np.cumsum(np.fromiter(map(bool, texts), np.int32, len(texts))) * blocking.bands
            keys = pa.array(band_keys([texts[i] for i in full], blocking).astype(np.int64).ravel())
            made = [pa.array(x, pa.string()) for x in ([n.lead for n in names], [y for y, _ in births], [d for _, d in births])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made, pa.ListArray.from_arrays(pa.array(ends), keys)], names=["h", "birth", "contact", "place", "lead", "year", "day", "bands"])

    made = records.select("h", "birth", "contact", "place", *NAMES).mapInArrow(run, "h long, birth string, contact string, place string, lead string, year string, day string, bands array<long>")
    # All keys of a record come from one pass over it.
    joined = lambda x: F.when(F.col(x) != "", F.transform("bands", lambda b: F.xxhash64(F.lit(x), F.col(x), b))).otherwise(F.array().cast("array<long>"))
    of_name = F.concat(*map(joined, ANCHORS))
    return made.select("h", F.explode(F.concat(of_name, near_keys(), agreement_keys())).alias("k"))


def pair_features(row: tuple, counts: dict[str, int], n: int, lexicon: Lexicon = DEFAULT) -> list[float]:
    """The features of a pair; row holds the 8 fields of one record, then of the other."""
    a, b = Name(*row[:4], lexicon), Name(*row[8:12], lexicon)
    same, typo, initial, contradiction = compare_names(a, b)
    births = parse_birth(row[4]), parse_birth(row[12])
    birth = 2 if row[4] and row[4] == row[12] else births_agree(*births)
    contact, place = bool(row[5]) and row[5] == row[13], bool(row[6]) and row[6] == row[14]
    near = bool(row[5] and row[13]) and not contact and sum(map(ne, row[5], row[13])) <= 2
    weak = same + typo < 2 and not (same + typo and initial)
    equal, close = (birth == 2) + contact + place, births_near(*births) or contacts_near(row[5], row[13])
    return [
        float(min(same, 4)), float(typo), float(initial), float(contradiction), min(rarity({*forms(a)} & {*forms(b)}, counts, n), 30.0) / 10,
        float(birth == 2), float(birth in (1, -1)), float(birth == -2), float(contact), float(near), float(place), float(row[6][:7] == row[14][:7] != ""),
        float(bool(row[7] and row[15]) and row[7] != row[15]), float(weak), float(equal >= 2), float(equal == 1 and close and same >= 2),
    ]


def weak_label(x: list[float]) -> int:
    """1: two attributes agree, one of them perhaps but for a typing error, and several words of the name; 0: a contradiction in names, sex or birth, or little in common; -1: no opinion."""
    f = dict(zip(FEATURES, x))
    if f["contradiction"] or f["sex differs"] or f["birth far"] or f["agreements"] + f["near agreement"] == 0 or f["weak name"]:
        return 0
    return 1 if f["words"] + f["typing errors"] >= 2 else -1


# What is believed of each feature before any label is seen, as weights of a logistic model, and its constant.
PRIOR = {"contradiction": -12.0, "birth far": -8.0, "sex differs": -8.0, "weak name": -12.0, "words": 1.0, "agreements": 6.0, "near agreement": 6.0}
PRIOR_CONSTANT = -3.0


class Classifier:
    """Logistic regression with Platt scaling."""

    def __init__(self, weights: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.slope, self.shift = weights, slope, shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.ones(len(x))]) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """The weights of greatest posterior probability under a normal prior around some weights, of precision ``ridge``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        # A long step from a saturated start overshoots; its direction is kept.
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> Classifier:
    """Fitted on two thirds of the labelled pairs, calibrated on the rest, at any number of them.

    Weights and calibration start from a prior (PRIOR; slope 1, shift 0) that labels move as far as they bear out:
    none leave it as it is, one class or few move it a little.
    """
    fit, held = np.arange(len(y)) % 3 != 0, np.arange(len(y)) % 3 == 0
    prior = np.array([*(PRIOR.get(f, 0.0) for f in FEATURES), PRIOR_CONSTANT])
    model = Classifier(_newton(np.column_stack([x[fit], np.ones(fit.sum())]), y[fit], prior, ridge))
    slope, shift = _newton(np.column_stack([model.margin(x[held]), np.ones(held.sum())]), y[held], np.array([1.0, 0.0]), ridge)
    if slope > 0:  # a calibration must keep the order of the pairs
        model.slope, model.shift = float(slope), float(shift)
    return model


def _side(df: DataFrame, record: str) -> DataFrame:
    for c in ("norm_middle_name", "norm_extension_name"):
        if c not in df.columns:
            df = df.withColumn(c, F.upper(F.trim(F.col(c.removeprefix("norm_")))))
    return df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), *attributes()).withColumn("id", class_id())


def _word_counts(sides: list[DataFrame], share: float) -> tuple[dict[str, int], int]:
    """Records of each word that more than a share of all have, over both tables; words are those of the names as typed."""
    both = sides[0].select(*NAMES[:3])
    for s in sides[1:]:
        both = both.unionByName(s.select(*NAMES[:3]))
    words = both.select(F.explode(F.array_distinct(F.split(F.upper(F.concat_ws(" ", *NAMES[:3])), r"[^\p{L}\p{Nd}]+"))).alias("w"))
    n = both.count()
    rows = words.where("length(w) > 2").groupBy("w").count().where(F.col("count") > n * share).collect()
    return {r["w"]: r["count"] for r in rows}, max(n, 1)


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, blocking: Blocking = Blocking(), sample: int = 60_000, least: float = 0.01, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(left_id, right_id, confidence): each candidate pair with the calibrated probability, of ``least`` or more, that it is one person.

    The classifier is fitted on a sample of at most about ``sample`` weakly labelled candidate pairs, chosen by hash;
    candidate search and all counts cover all rows. Rows without two of birth date, contact and place have no
    candidates but by their names. A pair is likely with two of them equal, or with one equal and the birth date or contact of another near. Nulls and empty texts are missing values; repeated rows give a pair each; empty tables give none.
    """
    sides = [_side(left, left_id), _side(right, right_id)]
    # Blocks carry 64 bits of a class; where two classes share them, both are compared.
    classes = [durable(s.select("id", *FIELDS).distinct().withColumn("h", F.xxhash64(*FIELDS)), "side") for s in sides]
    counts, n = _word_counts(classes, COUNTED_SHARE)
    keyed = [blocks(c, blocking, lexicon) for c in classes]
    pairs = block_join(keyed[0].withColumnRenamed("h", "h_a"), keyed[1].withColumnRenamed("h", "h_b"), "k", "h_a", 16 * classes[0].count()).select("h_a", "h_b").distinct()
    side = lambda x, df: df.select(*(F.col(c).alias(f"{c}_{x}") for c in ["h", "id", *FIELDS]))
    two = pairs.join(side("a", classes[0]), "h_a").join(side("b", classes[1]), "h_b")
    ordered = two.select("id_a", "id_b", *(f"{c}_{x}" for x in "ab" for c in FIELDS))
    shared = left.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            x = [pair_features(row, counts, n, lexicon) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], names=["id_a", "id_b", "x"])

    scored = durable(ordered.mapInArrow(run, "id_a binary, id_b binary, x array<float>"), "features")
    total = scored.count()
    share = min(1.0, sample / max(total, 1))
    chosen = scored.where((F.shiftrightunsigned(F.xxhash64("id_a", "id_b"), 11) / float(1 << 53)) < share).limit(2 * sample).select("x").collect()
    x = np.array([r.x for r in chosen], float).reshape(len(chosen), len(FEATURES))
    y = np.array([weak_label(list(r)) for r in x.tolist()], float)
    model = train(x[y >= 0], y[y >= 0])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).values.to_numpy().reshape(-1, len(FEATURES)) if batch.num_rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.probability(x.astype(float)))], names=["id_a", "id_b", "confidence"])

    rated = scored.mapInArrow(rate, "id_a binary, id_b binary, confidence double").where(F.col("confidence") >= least)
    of = lambda x, s, name: s.select(F.col("id").alias(f"id_{x}"), F.col("record").alias(name))
    return rated.join(of("a", sides[0], left_id), "id_a").join(of("b", sides[1], right_id), "id_b").select(left_id, right_id, "confidence")


def matches(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.where(F.col("confidence") >= threshold)
