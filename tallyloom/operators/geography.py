"""Four-level geography: chains, paths, children, ingest checks, and normalization of typed chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import jaro_winkler_of
from ..functions.text import blank, blank_to_null, collapse, location_key, lookup_key, trim_all
from .durable import durable

LEVELS = ("region", "province", "city", "barangay")
# Short names of special regions.
REGION_SHORT_NAMES = {"national capital region": "ncr", "cordillera administrative region": "car", "autonomous region in muslim mindanao": "armm", "bangsamoro autonomous region in muslim mindanao": "barmm"}


CHAIN = [f"{x}_{y}" for x in LEVELS for y in ("code", "name")]
INCOMPLETE = "could not resolve a unique full hierarchy chain"


def chains(regions: DataFrame, provinces: DataFrame, cities: DataFrame, barangays: DataFrame) -> DataFrame:
    """One row per barangay with codes and names of all levels, and whether its parents agree with each other (``consistent``).

    A blank province is the city's; an unknown region is the province's. A barangay whose city, province or region is
    not found is left out. Parents agree if province, city and barangay name the region, and city and barangay, where
    they name a province at all, name that province.
    """
    edge = lambda c: F.coalesce(trim_all(c), F.lit(""))
    b = barangays.where(~blank("barangay_code")).select(trim_all("barangay_code").alias("barangay_code"), edge("barangay_name").alias("barangay_name"), edge("city_code").alias("bc"), edge("region_code").alias("br"), F.col("province_code").alias("bp"))
    c = cities.where(~blank("city_code")).select(trim_all("city_code").alias("city_code"), edge("city_name").alias("city_name"), edge("region_code").alias("cr"), F.col("province_code").alias("cp"))
    p = provinces.where(~blank("province_code")).select(trim_all("province_code").alias("province_code"), edge("province_name").alias("province_name"), edge("region_code").alias("pr"))
    r = regions.where(~blank("region_code")).select(trim_all("region_code").alias("region_code"), edge("region_name").alias("region_name"))
    found = b.join(c, F.col("bc") == F.col("city_code")).withColumn("pc", F.coalesce(blank_to_null("bp"), blank_to_null("cp"))).join(p, F.col("pc") == F.col("province_code"))
    known = r.select(F.col("region_code").alias("known"))
    found = found.join(known, F.col("br") == F.col("known"), "left").withColumn("rc", F.coalesce("known", "pr")).join(r, F.col("rc") == F.col("region_code"))
    names = lambda c: F.coalesce(trim_all(c) == F.col("province_code"), F.lit(True))
    agree = (F.col("pr") == F.col("region_code")) & (F.col("cr") == F.col("region_code")) & (F.col("br") == F.col("region_code")) & names("cp") & names("bp")
    return found.select(*CHAIN, agree.alias("consistent"))


def chain_fault(rows: DataFrame, regions: DataFrame, provinces: DataFrame, cities: DataFrame, barangays: DataFrame) -> DataFrame:
    """rows with ``chain_fault``: the first fault of their four codes, null if they are one chain of the tables.

    Codes must be given and known; a province must lie in the region, a city in region and province, a barangay in
    region, province and city, where city and barangay may name no province.
    """
    of = dict(zip(LEVELS, (regions, provinces, cities, barangays)))
    df = rows
    for x in LEVELS:
        above = [f"{y}_code" for y in LEVELS[: LEVELS.index(x)] if f"{y}_code" in of[x].columns]
        t = of[x].select(F.trim(f"{x}_code").alias(f"__{x}"), *(F.trim(c).alias(f"__{x}_{c}") for c in above)).where(F.col(f"__{x}").isNotNull()).dropDuplicates([f"__{x}"])
        df = df.join(t, trim_all(f"{x}_code") == F.col(f"__{x}"), "left")
    code = {x: trim_all(f"{x}_code") for x in LEVELS}
    checks = [F.when(blank("region_code") | blank("province_code") | blank("city_code") | blank("barangay_code"), F.lit("location codes are required"))]
    checks += [F.when(F.col(f"__{x}").isNull(), F.concat(F.lit(f"unknown {x} "), code[x])) for x in LEVELS]
    for x in LEVELS[1:]:
        for y in LEVELS[: LEVELS.index(x)]:
            held = F.col(f"__{x}_{y}_code")
            wrong = held != code[y] if y == "province" else ~held.eqNullSafe(code[y])
            checks.append(F.when(wrong, F.concat(F.lit(f"{x} "), code[x], F.lit(f" does not belong to {y} "), code[y])))
    return df.select(*rows.columns, F.coalesce(*checks).alias("chain_fault"))


def path_of(regions: DataFrame, provinces: DataFrame, cities: DataFrame, barangays: DataFrame, code: str | None = None) -> DataFrame:
    """The strict path: inner joins on every level's own code, of one barangay or of all."""
    b = barangays if code is None else barangays.where(F.col("barangay_code") == code)
    out = b.select("barangay_code", "barangay_name", "city_code").join(cities.select("city_code", "city_name", "province_code"), "city_code")
    out = out.join(provinces.select("province_code", "province_name", "region_code"), "province_code").join(regions.select("region_code", "region_name"), "region_code")
    return out.select(*(f"{x}_{y}" for x in LEVELS for y in ("code", "name")))


def children(table: DataFrame, level: str, parent: str, code: str | None = None, by_name: bool = True) -> DataFrame:
    """A level's rows under one parent code (or all), ordered by name and code, or by code."""
    rows = table if code is None else table.where(F.col(f"{parent}_code") == code)
    return rows.orderBy(*([f"{level}_name", f"{level}_code"] if by_name else [f"{level}_code"]))


def distinct_by_code(rows: DataFrame, level: str, carried: list[str]) -> DataFrame:
    """(code, carried..., variants): one row per filled code; variants counts its distinct carried values.

    Partial aggregation on the distinct rows leaves each task, so repeated dimension rows are not shuffled.
    """
    values = F.struct(*carried)
    return rows.where(~blank(f"{level}_code")).groupBy(f"{level}_code").agg(F.min(values).alias("__v"), F.count_distinct(values).alias("variants")).select(f"{level}_code", *(F.col(f"__v.{c}").alias(c) for c in carried), "variants")


def ingest(rows: DataFrame) -> dict[str, DataFrame]:
    """The four dimensions of a denormalized table with eight code and name columns; all or nothing.

    A blank field, a code with two names or parents, a parent that names another parent than its child does, or no row
    at all is an error.
    """
    need = CHAIN
    bad = rows.select(F.count(F.lit(1)).alias("n"), *(F.count_if(blank(c)).alias(c) for c in need)).first()
    if not bad["n"]:
        raise ValueError("no rows")
    if wrong := [c for c in need if bad[c]]:
        raise ValueError(f"blank required fields: {', '.join(wrong)}")
    parents = {"region": [], "province": ["region_code"], "city": ["region_code", "province_code"], "barangay": ["region_code", "province_code", "city_code"]}
    out = {x: distinct_by_code(rows, x, [*parents[x], f"{x}_name"]) for x in LEVELS}
    for x, df in out.items():
        if clash := df.where("variants > 1").select(f"{x}_code").limit(5).collect():
            raise ValueError(f"conflicting {x} rows: {', '.join(r[0] for r in clash)}")
    if wrong := parent_faults(out).limit(5).collect():
        raise ValueError("; ".join(r["fault"] for r in wrong))
    return {x: df.drop("variants") for x, df in out.items()}


def parent_faults(dimensions: dict[str, DataFrame]) -> DataFrame:
    """(level, code, fault): rows of dimensions whose parent is unknown, or names other parents than they do."""
    out = None
    for x in LEVELS[1:]:
        for y in LEVELS[: LEVELS.index(x)]:
            shared = [f"{z}_code" for z in LEVELS[: LEVELS.index(y)]]
            child = dimensions[x].select(F.col(f"{x}_code").alias("code"), F.col(f"{y}_code").alias("parent"), *(F.col(c).alias(f"own_{c}") for c in shared))
            above = dimensions[y].select(F.col(f"{y}_code").alias("parent"), *shared, F.lit(True).alias("known"))
            at = lambda said: F.concat(F.lit(f"{x} "), F.col("code"), F.lit(said), F.col("parent"))  # noqa: B023, E731
            faults = [F.when(F.col("known").isNull(), at(f" references unknown {y} ")), *(F.when(~F.col(c).eqNullSafe(F.col(f"own_{c}")), at(f" names another {c.removesuffix('_code')} than {y} ")) for c in shared)]
            bad = child.join(above, "parent", "left").select(F.lit(x).alias("level"), "code", F.coalesce(*faults).alias("fault")).where("fault is not null")
            out = bad if out is None else out.unionByName(bad)
    return out


def ingest_counts(rows: DataFrame) -> DataFrame:
    """(rows_read, regions, provinces, cities, barangays, rows_skipped) of a denormalized table."""
    n = lambda x: F.count_distinct(F.when(~blank(f"{x}_code"), F.col(f"{x}_code")))
    return rows.agg(F.count(F.lit(1)).alias("rows_read"), n("region").alias("regions"), n("province").alias("provinces"), n("city").alias("cities"), n("barangay").alias("barangays")).withColumn("rows_skipped", F.col("rows_read") - F.col("barangays"))


def region_aliases(regions: DataFrame) -> DataFrame:
    """(alias, region_name): by what a region may be called, in lower case and with single spaces.

    Its code, its name, the up to two words after 'region' with, without and without spaces between them, and the
    short names of special regions. Of two regions with one alias the one with the least code has it.
    """
    key = lookup_key("region_name")
    words = F.split(key, " ")
    # Words after the first end where the word region stands again.
    after = F.when((F.size(words) > 1) & (words[0] == "region") & (words[1] != "region"), F.when((F.size(words) > 2) & (F.get(words, F.lit(2)) != "region"), F.concat_ws(" ", words[1], F.get(words, F.lit(2)))).otherwise(words[1]))
    short = F.coalesce(*(F.when(key == name, F.lit(s)) for name, s in REGION_SHORT_NAMES.items()))
    forms = F.array_compact(F.array(lookup_key("region_code"), key, after, F.replace(after, F.lit(" "), F.lit("")), F.concat(F.lit("region "), after), short))
    named = regions.where(~blank("region_code") & ~blank("region_name"))
    rows = named.select(trim_all("region_code").alias("region_code"), trim_all("region_name").alias("region_name"), F.explode(F.array_distinct(F.filter(forms, lambda x: x != ""))).alias("alias"))
    best = rows.groupBy("alias").agg(F.min(F.struct("region_code", "region_name")).alias("r"))
    return best.select("alias", F.col("r.region_name").alias("region_name"))


@dataclass(frozen=True)
class Options:
    """Least score that is applied unseen, difference below which two chains tie, and candidates kept."""

    threshold: float = 0.95
    tie: float = 0.01
    candidates: int = 10

    def __post_init__(self) -> None:
        if not (0 <= self.threshold <= 1 and 0 <= self.tie <= 1 and self.candidates > 0):
            raise ValueError("options out of range")


TYPED = ("region", "province", "city_municipality", "barangay")


def typed_chains(rows: DataFrame, columns: tuple[str, str, str, str] = TYPED) -> DataFrame:
    """The distinct typed chains of a table: four texts, trimmed and with single spaces, null being empty."""
    return rows.select(*(collapse(F.coalesce(F.col(c), F.lit(""))).alias(x) for c, x in zip(columns, LEVELS))).distinct()


def _narrowed(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, columns: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame]:
    """(state, entries, typed): each distinct typed chain with the codes (w_) to which exact matches narrow it, the catalog, and all typed chains.

    Level by level an equi-join by name and by code, under what the levels above left, narrows a chain to the codes
    that match; where none does, the level is passed over. A match gives the codes of the levels above it too, so a chain
    without a region's code is one of which no level matches. ``entry`` numbers the catalog in the order of its codes.
    """
    raw = typed_chains(rows, columns)
    named = raw.join(aliases.select(F.col("alias").alias("__a"), F.col("region_name").alias("__n")), F.lower("region") == F.col("__a"), "left").withColumn("asked", F.coalesce("__n", "region"))
    text_of = lambda x: F.col("asked" if x == "region" else x)
    typed = named.select(*LEVELS, F.unhex(F.md5(F.concat_ws("\x1f", *LEVELS))).alias("id"), *(F.lower(text_of(x)).alias(f"t_{x}") for x in LEVELS), *(location_key(text_of(x)).alias(f"k_{x}") for x in LEVELS))
    typed = durable(typed, "typed")
    entries = catalog.select(*CHAIN, "consistent", *(lookup_key(f"{x}_name").alias(f"n_{x}") for x in LEVELS), *(location_key(f"{x}_name").alias(f"l_{x}") for x in LEVELS))
    by_code = F.concat_ws("|", *(F.coalesce(f"{x}_code", F.lit("")) for x in LEVELS))
    entries = durable(entries.coalesce(1).sortWithinPartitions(by_code).withColumn("entry", F.monotonically_increasing_id()), "names")
    none = F.lit(None).cast("string")
    state = typed.select("id", *(f"t_{x}" for x in LEVELS), *(none.alias(f"w_{x}") for x in LEVELS), *(F.lit(False).alias(f"m_{x}") for x in LEVELS))
    for i, x in enumerate(LEVELS):
        upto = LEVELS[: i + 1]
        places = entries.select(*(F.col(f"{y}_code").alias(f"e_{y}") for y in upto), F.col(f"n_{x}").alias("__n")).distinct()
        called = places.unionByName(places.withColumn("__n", F.lower(f"e_{x}"))).distinct()
        inside = F.col(f"t_{x}") == F.col("__n")
        for y in upto[:-1]:
            inside = inside & (F.col(f"w_{y}").isNull() | (F.col(f"w_{y}") == F.col(f"e_{y}")))
        hit = state.where(F.col(f"t_{x}") != "").join(called, inside)
        hit = hit.select("id", *(f"t_{y}" for y in LEVELS), *((F.col(f"e_{y}") if y in upto else F.col(f"w_{y}")).alias(f"w_{y}") for y in LEVELS), *((F.lit(True) if y == x else F.col(f"m_{y}")).alias(f"m_{y}") for y in LEVELS)).distinct()
        hit = durable(hit, f"at-{x}")
        state = hit.unionByName(state.join(hit.select("id").distinct(), "id", "left_anti"))
    whole = F.lit(True)
    for x in LEVELS:
        whole = whole & ((F.col(f"t_{x}") == "") | F.col(f"m_{x}"))
    return state.select("id", whole.alias("whole"), *(f"w_{x}" for x in LEVELS)), entries, typed


def _scorer(top: int, rows: int = 200_000) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores the chains of a group against its part of the catalog and gives the ``top`` of each; ``rows`` candidates are held at once.

    n, in the first row of a chain's state, is how many candidates that state leaves; the score is null where no key is filled.
    """

    def score(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "whole": np.array([], bool), "entry": np.array([], np.int64), "score": np.array([], float), "n": np.array([], np.int64)})]
        if not len(new) or not len(old):
            return out[0]
        ids, whole, entry = new["id"].to_numpy(), new["whole"].to_numpy(bool), old["entry"].to_numpy(np.int64)
        codes, narrow = [old[f"{x}_code"].to_numpy(object) for x in LEVELS], list(zip(*(new[f"w_{x}"].to_numpy(object) for x in LEVELS)))
        keys = [np.unique(new[f"k_{x}"].to_numpy(object).astype(str), return_inverse=True) for x in LEVELS]
        names = [np.unique(old[f"l_{x}"].to_numpy(object).astype(str), return_inverse=True) for x in LEVELS]
        filled = sum((k[0] != "")[k[1]].astype(np.int64) for k in keys)
        inside: dict[tuple, np.ndarray] = {}

        def left_of(w: tuple) -> np.ndarray:
            if w not in inside:
                fits = np.ones(len(entry), bool)
                for c, code in zip(codes, w):
                    if isinstance(code, str):
                        fits &= c == code
                inside[w] = np.flatnonzero(fits)
            return inside[w]

        def block(first: int, last: int) -> None:
            found = [left_of(w) for w in narrow[first:last]]
            sizes = np.array([len(f) for f in found])
            at, chain = np.concatenate(found), np.repeat(np.arange(first, last), sizes)
            total = np.zeros(len(at))
            for (key, of_chain), (name, of_entry) in zip(keys, names):
                pairs, back = np.unique(of_chain[chain] * len(name) + of_entry[at], return_inverse=True)
                k, l = pairs // len(name), pairs % len(name)  # noqa: E741
                same = key[k] == name[l]
                s = np.where(same & (key[k] != ""), 1.0, 0.0)
                s[~same] = jaro_winkler_of(key, name, k[~same], l[~same])
                total = total + s[back]
            score = np.where(filled[chain] > 0, total / np.maximum(filled[chain], 1), np.nan)
            order = np.lexsort((entry[at], -score, chain))  # grouped by chain as before, so places count from each chain's start
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order, place = order[place < top], place[place < top]
            c = chain[order]
            out.append(pd.DataFrame({"id": ids[c], "whole": whole[c], "entry": entry[at[order]], "score": score[order], "n": np.where(place == 0, sizes[c - first], 0)}))

        first = held = 0
        for i, w in enumerate(narrow):
            held += len(left_of(w))
            if held >= rows:
                block(first, i + 1)
                first, held = i + 1, 0
        if first < len(narrow):
            block(first, len(narrow))
        return pd.concat(out[1:])

    return score


def _ranked(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, options: Options, columns: tuple[str, str, str, str], top: int, chains_a_task: int = 1_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sure, ranked, typed): chains that match exactly and alone; the ``top`` scored candidates of the others, best first; all typed chains.

    Candidates are many times the chains, so they are never rows of a table: chains meet the catalog's entries of their
    region (of all regions if no level matches) within a task, and only the best leave it.
    """
    state, entries, typed = _narrowed(rows, catalog, aliases, columns)
    state = durable(state.join(typed.select("id", *(f"k_{x}" for x in LEVELS)), "id").withColumn("scope", F.coalesce(F.concat(F.lit("r|"), "w_region"), F.lit("*"))), "state")
    parts = durable(state.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / chains_a_task).cast("long").alias("parts")), "parts")
    tasks = max(64, 8 * rows.sparkSession.sparkContext.defaultParallelism)
    chains_ = state.join(parts, "scope").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    places = entries.select("entry", *(f"{x}_code" for x in LEVELS), *(f"l_{x}" for x in LEVELS), F.explode(F.array(F.lit("*"), F.concat(F.lit("r|"), "region_code"))).alias("scope"))
    places = places.join(parts, "scope").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Groups are small in bytes and long in work: an explicit count keeps the runtime from merging them into few tasks.
    met = [df.drop("parts").repartition(tasks, "scope", "part").groupBy("scope", "part") for df in (chains_, places)]
    found = durable(met[0].cogroup(met[1]).applyInPandas(_scorer(top), "id binary, whole boolean, entry long, score double, n long"), "ranked")
    one = found.groupBy("id").agg(F.sum("n").alias("n"), F.min("entry").alias("entry"), F.first("whole").alias("whole"))
    alone = one.where("whole and n = 1").select("id", "entry")
    chain = entries.select("entry", *CHAIN, "consistent")
    sure = alone.join(chain, "entry").drop("entry")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "entry")
    scores = found.where("score is not null and not isnan(score)").join(alone.select("id"), "id", "left_anti")
    ranked = scores.withColumns({"place": F.row_number().over(order), "second": F.lead("score").over(order)}).where(F.col("place") <= options.candidates)
    return sure, ranked.join(chain, "entry").select("id", *CHAIN, "consistent", "score", "place", "second"), typed


def candidates(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, options: Options = Options(), columns: tuple[str, str, str, str] = TYPED) -> DataFrame:
    """(the four typed texts, place, score, codes and names): the best catalog chains of each typed chain that has no exact match of its own."""
    _, ranked, typed = _ranked(rows, catalog, aliases, options, columns, options.candidates + 1)
    return ranked.join(typed.select("id", *LEVELS), "id").select(*LEVELS, "place", "score", *CHAIN)


def normalize(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, options: Options = Options(), columns: tuple[str, str, str, str] = TYPED) -> DataFrame:
    """(the four typed texts, resolved codes and names, status, match_source, confidence, reason): one row per distinct typed chain.

    A level narrows the catalog's chains if any matches exactly, by code or by name in any letter case, and is passed
    over if none does. One survivor of which all filled levels match is EXACT; otherwise survivors are scored by the
    mean Jaro-Winkler similarity of the levels whose key is filled. Equal best scores are ambiguous, low ones need
    review, and so does a chain whose parents disagree in the tables.
    """
    sure, ranked, typed = _ranked(rows, catalog, aliases, options, columns, 2)
    exact = sure.select("id", *CHAIN, "consistent", F.lit("EXACT").alias("match_source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("said"))
    said = F.when(F.abs(F.col("score") - F.col("second")) < options.tie, "ambiguous location candidates").when(F.col("score") < options.threshold, "confidence below threshold")
    source = F.when((F.col("score") == 1) & said.isNull(), "EXACT").otherwise("FUZZY")
    scored = ranked.where("place = 1").select("id", *CHAIN, "consistent", source.alias("match_source"), F.col("score").alias("confidence"), said.alias("said"))
    done = typed.select("id", *LEVELS).join(exact.unionByName(scored), "id", "left")
    found = F.col("match_source").isNotNull()
    reason = F.when(~found, "no location candidate matched").when(F.col("said").isNotNull(), F.col("said")).when(~F.col("consistent"), INCOMPLETE)
    return done.select(
        *LEVELS, *CHAIN, F.when(reason.isNull(), "AUTO_APPLIED").otherwise("REVIEW_NEEDED").alias("status"), F.coalesce("match_source", F.lit("NONE")).alias("match_source"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), reason.alias("reason"),
    )


def exact_resolver(rows: DataFrame, catalog: DataFrame, columns: tuple[str, str, str, str] = ("region", "province", "city_municipality", "barangay")) -> DataFrame:
    """(the four typed texts, barangay_code, error): parent-scoped unique lookup, level by level, of each distinct typed chain.

    The first level of which nothing or more than one place fits gives the error. A blank province is passed over.
    """
    raw = rows.select(*(collapse(F.coalesce(F.col(c), F.lit(""))).alias(x) for c, x in zip(columns, LEVELS))).distinct()
    done = durable(raw.withColumns({f"k_{x}": location_key(x) for x in LEVELS} | {f"t_{x}": F.lower(x) for x in LEVELS}), "typed").withColumn("error", F.lit(None).cast("string"))
    places = {x: catalog.select(*dict.fromkeys(["region_code", "province_code", "city_code", f"{x}_code", f"{x}_name"])).distinct() for x in LEVELS}
    found = None
    for i, x in enumerate(LEVELS):
        above = LEVELS[:i]
        base = done if found is None else found
        want = places[x].select(*(F.col(f"{y}_code").alias(f"w_{y}") for y in above), F.col(f"{x}_code").alias("w_code"), F.lower(f"{x}_code").alias("w_low"), location_key(f"{x}_name").alias("w_key"), F.lit(x).alias("w_x")).distinct()
        inside = F.lit(True)
        for y in above:
            inside = inside & (F.col(f"r_{y}").isNull() | F.col(f"r_{y}").eqNullSafe(F.col(f"w_{y}")))
        # Two equi-joins, by key and by code; a place found by both counts once.
        asked = base.where(F.col("error").isNull() & (F.col(f"t_{x}") != ""))
        both = asked.join(want, (F.col(f"k_{x}") == F.col("w_key")) & inside).unionByName(asked.join(want, (F.col(f"t_{x}") == F.col("w_low")) & inside))
        hit = both.groupBy(*LEVELS).agg(F.count_distinct("w_code").alias("n"), F.min("w_code").alias("code"))
        base = base.join(hit, list(LEVELS), "left")
        skip = blank(x) if x == "province" else F.lit(False)
        error = F.when(F.col("error").isNotNull() | skip, F.col("error")).when(F.coalesce("n", F.lit(0)) == 0, F.concat(F.lit("no "), F.lit(x), F.lit(" found"))).when(F.col("n") > 1, F.lit(f"{x} is ambiguous"))
        # A level is read three times by the next one, so it is written.
        found = durable(base.withColumns({f"r_{x}": F.when(F.col("n") == 1, F.col("code")), "error": error}).drop("n", "code"), x)
    codes = found.select(*LEVELS, "error", *(F.when(F.col("error").isNull(), F.col(f"r_{x}")).alias(f"__{x}") for x in LEVELS))
    # A province that was passed over is the chain's own.
    whole = catalog.select(*CHAIN)
    return codes.join(whole, F.col("__barangay") == F.col("barangay_code"), "left").select(*LEVELS, *CHAIN, "error")


def shadow(normalized: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both resolvers side by side; drift_fields lists what differs: apply_state, and where both applied each of the eight codes and names."""
    old = legacy.select(*LEVELS, *(F.col(c).alias(f"legacy_{c}") for c in CHAIN), F.col("error").isNull().alias("legacy_applied"))
    both = normalized.join(old, list(LEVELS))
    applied = F.col("status") == "AUTO_APPLIED"
    differ = [F.when(applied & F.col("legacy_applied") & ~F.col(f"legacy_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in CHAIN]
    fields = F.array_compact(F.array(F.when(applied != F.col("legacy_applied"), F.lit("apply_state")), *differ))
    return both.select(*LEVELS, "status", "legacy_applied", *CHAIN, *(f"legacy_{c}" for c in CHAIN), fields.alias("drift_fields"))


def shadow_totals(drift: DataFrame) -> DataFrame:
    """(total_rows, auto_apply_rows, review_rows, drift_rows) of a shadow comparison."""
    df = drift.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("status") == "AUTO_APPLIED").alias("auto_apply_rows"), F.count_if(F.size("drift_fields") > 0).alias("drift_rows"))
    return df.select("total_rows", "auto_apply_rows", (F.col("total_rows") - F.col("auto_apply_rows")).alias("review_rows"), "drift_rows")


def differs() -> Column:
    """Whether a record's place (the eight columns) is not the resolved one (the same with the prefix resolved_), trimmed."""
    edge = lambda c: F.coalesce(trim_all(c), F.lit(""))
    out = F.lit(False)
    for c in CHAIN:
        out = out | (edge(c) != edge(f"resolved_{c}"))
    return out


def backfill(records: DataFrame, catalog: DataFrame, aliases: DataFrame, at: str, options: Options = Options()) -> DataFrame:
    """records with the outcome of resolving their places again: resolved_ columns, status, match_source, confidence, reason, updated.

    A record's typed place is its names, or its codes where a name is blank. A place that is applied but was not given
    whole is forced to review. ``updated`` are those that are applied and differ; nothing is written (see backfilled).
    """
    raw = {f"__{x}": F.coalesce(blank_to_null(f"{x}_name"), blank_to_null(f"{x}_code"), F.lit("")) for x in LEVELS}
    df = records.withColumns({k: collapse(v) for k, v in raw.items()})
    done = normalize(df, catalog, aliases, options, tuple(raw)).select(*(F.col(x).alias(f"__{x}") for x in LEVELS), *(F.col(c).alias(f"resolved_{c}") for c in CHAIN), "status", "match_source", "confidence", "reason")
    part = F.lit(False)
    for x in LEVELS:
        part = part | (F.col(f"__{x}") == "")
    forced = (F.col("status") == "AUTO_APPLIED") & part
    df = df.join(done, [f"__{x}" for x in LEVELS], "left").withColumns({"reason": F.when(forced, "raw location chain incomplete").otherwise(F.col("reason")), "status": F.when(forced, "REVIEW_NEEDED").otherwise(F.col("status"))})
    return df.withColumn("updated", (F.col("status") == "AUTO_APPLIED") & differs()).withColumn("applied_at", F.when(F.col("updated"), F.lit(at)))


def backfilled(records: DataFrame, done: DataFrame) -> DataFrame:
    """The snapshot after a backfill: places and updated_at of the updated records are the resolved ones."""
    values = {c: F.when(F.col("updated"), F.col(f"resolved_{c}")).otherwise(F.col(c)) for c in CHAIN}
    return done.withColumns(values | {"updated_at": F.coalesce("applied_at", "updated_at")}).select(*records.columns)


def backfill_counts(done: DataFrame) -> DataFrame:
    """(total_rows, auto_applied_rows, review_rows, updated_rows)."""
    applied = F.count_if(F.col("status") == "AUTO_APPLIED")
    return done.agg(F.count(F.lit(1)).alias("total_rows"), applied.alias("auto_applied_rows"), (F.count(F.lit(1)) - applied).alias("review_rows"), F.count_if("updated").alias("updated_rows"))


def lineage(done: DataFrame, run_id: str, order: list[Column]) -> DataFrame:
    """One ledger row per record of a backfill: number, reference (source_reference, else generated_id, else uuid), typed and resolved place, outcome."""
    from .ranking import global_row_number

    reference = F.coalesce(blank_to_null("source_reference"), blank_to_null("generated_id"), blank_to_null("internal_uuid"))
    rows = done.select(
        F.lit(run_id).alias("run_id"), reference.alias("item_reference"), *(F.col(f"__{x}").alias(f"raw_{x}") for x in LEVELS), *(f"resolved_{c}" for c in CHAIN), "confidence", "match_source", "status",
        (F.col("status") != "AUTO_APPLIED").alias("needs_review"), "reason", *(o.alias(f"__o{i}") for i, o in enumerate(order)),
    )
    numbered = global_row_number(rows, [F.asc_nulls_first(f"__o{i}") for i in range(len(order))], "row_number")
    return numbered.drop(*(f"__o{i}" for i in range(len(order)))).withColumn("item_id", F.concat(F.lit(f"{run_id}-"), F.col("row_number").cast("string")))
