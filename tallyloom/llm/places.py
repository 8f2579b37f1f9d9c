"""Problem 6: places as people typed them, mapped to the geography tables or reported as unmatched.

Method: a multi-pattern automaton over canonical names and their aliases finds the places that a text mentions, the
longest mentions that don't overlap winning; values that it leaves open go to token-set similarity: words that both
sides have cancel out, and the rest is compared letter by letter. Levels are resolved from the region down, each among
the children of what was found above, so a barangay is one of the named city. A geography of a checked size is sent to
all tasks; a larger one reaches them by a shuffle, with equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "NONE"
LEVELS = ("region", "province", "city", "barangay")

# Abbreviations of name parts, and words that only say which level a name has.
ABBREVIATIONS = {
    "sto": "santo", "sta": "santa", "pob": "poblacion", "poblasyon": "poblacion", "prop": "proper", "n": "norte", "nte": "norte", "s": "sur", "o": "oriental", "or": "oriental",
    "orient": "oriental", "occ": "occidental", "occid": "occidental", "d": "del", "brgy": "barangay", "bgy": "barangay", "brg": "barangay", "bgry": "barangay", "b": "barangay",
    "prov": "province", "mun": "municipality", "cty": "city", "reg": "region", "rgn": "region", "rehiyon": "region", "r": "region",
}
LEVEL_WORDS = {
    "region": {"region"},
    "province": {"province", "lalawigan", "of", "ng"},
    "city": {"city", "municipality", "bayan", "lungsod", "of", "ng"},
    "barangay": {"barangay", "no", "number"},
}
# What is typed where nothing is known, words that announce a part of a place, and words glued to a number.
FILLERS = ("", "unknown", "n a", "na", "none", "wala", "tba", "to be verified", "no permanent address")
PARTS = ("purok", "sitio", "zone", "block", "blk", "lot", "phase", "street", "st")
GLUED = ("b", "brgy", "bgy", "brg", "barangay", "pob", "no")


@dataclass(frozen=True)
class Vocabulary:
    """The words of one country's place names; another country brings its own.

    parts are words that, with the word or number after them, may stand beside a name without being part of it.
    """

    abbreviations: dict[str, str] = field(default_factory=lambda: ABBREVIATIONS)
    level_words: dict[str, set[str]] = field(default_factory=lambda: LEVEL_WORDS)
    fillers: tuple[str, ...] = FILLERS
    parts: tuple[str, ...] = PARTS
    glued: tuple[str, ...] = GLUED


DEFAULT = Vocabulary()
_ROMAN = re.compile(r"^(?=[ivxl])(xl|l?x{0,4})(ix|iv|v?i{0,4})$")


def tokens(text: str | None, vocabulary: Vocabulary = DEFAULT) -> list[str]:
    """Lower-case words without accents, abbreviations written out, numbers without leading zeros."""
    if not text:
        return []
    if "Ã" in text or "Â" in text:
        try:
            text = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    if vocabulary.glued:
        plain = re.sub(rf"\b({'|'.join(map(re.escape, vocabulary.glued))})(?=\d)", r"\1 ", plain)
    words = re.findall(r"[^\W_]+", plain)
    return [w.lstrip("0") or "0" if w.isdigit() and len(w) < 10 else vocabulary.abbreviations.get(w, w) for w in words]


def core(level: str, words: list[str], vocabulary: Vocabulary = DEFAULT) -> str:
    """What tells a name from others of its level; the whole if only level words are left."""
    kept = [w for w in words if w not in vocabulary.level_words[level]]
    if level == "barangay" and len(kept) > 1 and any(w.isdigit() for w in kept):
        kept = [w for w in kept if w != "poblacion"]  # "Barangay 3 (Pob.)"
    return " ".join(dict.fromkeys(kept or words))


def roman(word: str) -> int | None:
    if not _ROMAN.match(word):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in word]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))


def distance(a: str, b: str, most: int) -> int:
    """Edits (also of two neighbours exchanged) between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most and (not last or min(last) > most):
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _numbers(key: str) -> list[str]:
    return [w for w in key.split() if w.isdigit() or roman(w) is not None or len(w) == 1]


def _most(longest: int) -> int:
    return 1 if longest < 6 else 2 if longest < 14 else 3


def similarity(a: str, b: str) -> float:
    """Token-set similarity of two cores, 0 below a share of edits; numbers and numerals must be the same.

    Words that both have cancel out, whatever their order; the rest counts by its edits. Edits of the whole without
    spaces count where words were joined or cut.
    """
    if a == b:
        return 1.0
    if _numbers(a) != _numbers(b):
        return 0.0
    x, y = a.replace(" ", ""), b.replace(" ", "")
    longest = max(len(x), len(y))
    most = _most(longest)
    v, w = a.split(), b.split()
    left, right = sorted(set(v) - set(w)), sorted(set(w) - set(v))
    d = min(distance("".join(left), "".join(right), most), distance(x, y, most))
    return 0.0 if d > most else 0.99 - d / longest


class _Scope:
    """The places of one level among which a text is looked for: their keys, and letter counts that bound edits from below."""

    def __init__(self, keys: dict[str, list[str]], codes: list[str]):
        self.codes, self.inside = codes, set(codes)
        self.keys = [(k, c) for c in codes for k in keys[c]]
        self.known: dict[str, tuple[list[str], float]] = {}
        self.counts: np.ndarray | None = None

    @staticmethod
    def _count(keys: list[str]) -> np.ndarray:
        """Letters of each key by their code modulo 64; equal remainders only make the bound lower."""
        out = np.zeros((len(keys), 64), np.int16)
        for i, k in enumerate(keys):
            codes = np.frombuffer(k.replace(" ", "").encode("utf-32-le"), np.uint32)
            out[i] = np.minimum(np.bincount(codes & 63, minlength=64), 30_000)
        return out

    def best(self, key: str) -> tuple[list[str], float]:
        """The codes whose keys are most similar. A key whose letters differ too much can't be similar and isn't compared."""
        if self.counts is None:
            self.counts = self._count([k for k, _ in self.keys])
        off = self.counts - self._count([key])
        differ = np.maximum(np.where(off > 0, off, 0).sum(axis=1, dtype=np.int64), np.where(off < 0, -off, 0).sum(axis=1, dtype=np.int64))
        scored = [(similarity(key, self.keys[i][0]), self.keys[i][1]) for i in np.flatnonzero(differ <= 3).tolist()]
        score = max((s for s, _ in scored), default=0.0)
        return ([*dict.fromkeys(c for s, c in scored if s == score)] if score > 0 else []), score


class Gazetteer:
    """The four geography tables with their aliases. regions: (code, name); provinces: (code, region, name); cities: (code, region, province, name); barangays: (code, city, name)."""

    def __init__(self, regions: list, provinces: list, cities: list, barangays: list, vocabulary: Vocabulary = DEFAULT):
        self.vocabulary = vocabulary
        self.names: dict[str, str] = {}
        self.parents: dict[str, tuple] = {}
        self.level: dict[str, str] = {}
        self.keys: dict[str, list[str]] = {}
        self.children: dict[tuple[str, str], list[str]] = defaultdict(list)
        self.by_key: dict[tuple[str, str], list[str]] = defaultdict(list)
        for level, rows in (("region", [(c, (), n) for c, n in regions]), ("province", [(c, (r,), n) for c, r, n in provinces]), ("city", [(c, (r, p), n) for c, r, p, n in cities]), ("barangay", [(c, (k,), n) for c, k, n in barangays])):
            for code, parents, name in rows:
                self.names[code], self.level[code], self.parents[code] = name or "", level, parents
                self.keys[code] = self._aliases(level, name or "")
                for p in parents:
                    if p:
                        self.children[level, p].append(code)
                for key in self.keys[code]:
                    self.by_key[level, key].append(code)
        self.all = {level: [c for c, x in self.level.items() if x == level] for level in LEVELS}
        self.exact = {
            (self.names[r], self.names[p] if p else "", self.names[c], self.names[b])
            for b in self.all["barangay"]
            for c in [self.parents[b][0]]
            if c in self.parents
            for r, p in [self.parents[c]]
        }
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list[str]] = defaultdict(list)
        for code, keys in self.keys.items():
            for key in keys:
                patterns[key].append(code)
        for key, codes in patterns.items():
            if key:
                self.automaton.add_word(f" {key} ", (key, codes))
        if patterns:
            self.automaton.make_automaton()
        self.scopes: dict[tuple, _Scope] = {}

    def _core(self, level: str, text: str) -> str:
        return core(level, tokens(text, self.vocabulary), self.vocabulary)

    def _aliases(self, level: str, name: str) -> list[str]:
        found = [self._core(level, name)]
        if level == "region":  # number, number in digits, and what stands in brackets
            found += [self._core(level, part) for part in re.split(r"[()]", name)]
            found += [str(n) for w in found[0].split()[:1] if (n := roman(w))]
        return [k for k in dict.fromkeys(found) if k]

    def mentions(self, words: list[str]) -> list[tuple[int, int, list[str]]]:
        """(first word, end, codes): the longest mentions that don't overlap, from the left."""
        text = " " + " ".join(words) + " "
        starts = {m.start(): i for i, m in enumerate(re.finditer(" ", text))}
        spans = sorted(((end - len(key) - 1, end, codes) for end, (key, codes) in self.automaton.iter(text)), key=lambda x: (x[0] - x[1], x[0])) if len(self.automaton) else []
        out: list = []
        for a, b, codes in spans:
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, codes))
        return sorted((starts[a], starts[b], codes) for a, b, codes in out)

    def _scope(self, level: str, parents: tuple, codes: Iterator[str]) -> _Scope:
        """The places of a level under some parents, made once for each set of parents."""
        known = self.scopes.get((level, parents))
        if known is None:
            if len(self.scopes) > 20_000:
                self.scopes.clear()
            known = self.scopes[level, parents] = _Scope(self.keys, list(codes))
        return known

    def _beside(self, level: str, words: list[str]) -> bool:
        """Whether words say nothing of a name: level words, and parts of a place with the word after them."""
        left = [w for w in words if w not in self.vocabulary.level_words[level]]
        i = 0
        while i < len(left) and left[i] in self.vocabulary.parts:
            i += 2
        return i >= len(left)

    def match(self, level: str, text: str | None, scope: _Scope) -> tuple[list[str], float]:
        """The codes in a scope that fit a text best, and how well."""
        raw = (text or "").strip()
        if raw.isdigit() and len(raw) >= 9:
            return ([raw], 1.0) if raw in scope.inside else ([], 0.0)
        if raw in scope.known:
            return scope.known[raw]
        words = tokens(raw, self.vocabulary)
        key = core(level, words, self.vocabulary)
        found = [c for c in self.by_key.get((level, key), ()) if c in scope.inside]
        score = 1.0
        if not found:  # the longest mention, beside words that say nothing
            for a, b, codes in sorted(self.mentions(words), key=lambda m: m[0] - m[1]):
                found = [c for c in codes if c in scope.inside]
                if found and self._beside(level, words[:a] + words[b:]):
                    break
                found = []
        if not found and key:
            found, score = scope.best(key)
        if len(scope.known) > 200_000:
            scope.known.clear()
        scope.known[raw] = found, score if found else 0.0
        return scope.known[raw]

    def _filled(self, text: str | None) -> bool:
        return " ".join(tokens(text, self.vocabulary)) not in self.vocabulary.fillers

    def _chain(self, region: str | None, province: str | None, city: str | None, barangay: str | None, strict: bool = False) -> tuple[list[str], float]:
        """Barangays that fit, and the worse score of city and barangay; strict: a province that fits nothing is not passed over."""
        every = self._scope("region", (), self.all["region"]), self._scope("province", (), self.all["province"])
        regions: tuple | None = None
        if self._filled(region):
            regions = tuple(self.match("region", region, every[0])[0])
            if not regions:
                return [], 0.0
        within: tuple | None = None
        if self._filled(province):
            among = every[1] if regions is None else self._scope("province", regions, (p for r in regions for p in self.children["province", r]))
            within = tuple(self.match("province", province, among)[0]) or None
            if within is None and (strict or self.match("province", province, every[1])[1] == 1.0):
                return [], 0.0  # a province of another region
        inside = self.all["city"] if regions is None else [c for r in regions for c in self.children["city", r]]
        cities = self._scope("city", (regions, within), (c for c in inside if within is None or self.parents[c][1] in within))
        found, city_score = self.match("city", city, cities) if self._filled(city) else (cities.codes, 0.9)
        if not self._filled(barangay) or not found:
            return [], 0.0
        under = self._scope("barangay", tuple(found), (b for c in found for b in self.children["barangay", c]))
        found, score = self.match("barangay", barangay, under)
        return found, min(city_score, score)

    def resolve(self, region: str | None, province: str | None, city: str | None, barangay: str | None) -> str:
        """The code of the barangay meant, or NONE."""
        tries = [(region, province, city, barangay)]
        if not self._filled(city) and self._filled(barangay):
            parts = [p.strip() for p in (barangay or "").split(",") if p.strip()]
            if len(parts) > 1:
                over = province if self._filled(province) or len(parts) < 3 else parts[2]
                tries = [(region, over, parts[1], parts[0])]
            else:
                words = tokens(barangay, self.vocabulary)
                spans = self.mentions(words)
                tries += [(region, province, " ".join(words[a:b]), " ".join(words[:a])) for a, b, codes in spans if a and any(self.level[c] == "city" for c in codes)]
        elif self._filled(barangay):
            tries += [(region, *order, True) for order in ((city, province, barangay), (province, barangay, city), (barangay, city, province), (city, barangay, province), (barangay, province, city))]
        for attempt in tries:
            found, _ = self._chain(*attempt)
            if found:
                return found[0] if len(set(found)) == 1 else NONE
        return NONE


GEOGRAPHY = "level string, code string, parent string, above string, name string"


def _listed(regions: DataFrame, provinces: DataFrame, cities: DataFrame, barangays: DataFrame) -> DataFrame:
    """The four tables as one: (level, code, parent, above, name); a city's parents are its region and its province."""
    none = F.lit(None).cast("string")
    parts = [
        regions.select(F.lit("region"), "region_code", none, none, "region_name"), provinces.select(F.lit("province"), "province_code", "region_code", none, "province_name"),
        cities.select(F.lit("city"), "city_code", "region_code", "province_code", "city_name"), barangays.select(F.lit("barangay"), "barangay_code", "city_code", none, "barangay_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("level", "code", "parent", "above", "name").where("code is not null")


def gazetteer_of(rows: list[tuple], vocabulary: Vocabulary = DEFAULT) -> Gazetteer:
    """A gazetteer from rows (level, code, parent, above, name)."""
    of: dict[str, list] = {level: [] for level in LEVELS}
    for level, code, parent, above, name in sorted(rows, key=lambda r: (r[0], r[1])):
        of[level].append((code, *{"region": (), "province": (parent,), "city": (parent, above), "barangay": (parent,)}[level], name))
    return Gazetteer(*(of[level] for level in LEVELS), vocabulary)


def _resolved(gazetteer: Gazetteer, typed: list[tuple], known: dict) -> tuple[list[str], list[bool]]:
    codes = []
    for t in typed:
        if t not in known:
            if len(known) > 500_000:  # a memo, no limit on rows
                known.clear()
            known[t] = gazetteer.resolve(*t)
        codes.append(known[t])
    return codes, [tuple(x or "" for x in t) in gazetteer.exact for t in typed]


def map_places(rows: DataFrame, geography: tuple[DataFrame, DataFrame, DataFrame, DataFrame], columns: tuple[str, str, str, str] = ("region", "province", "city_municipality", "barangay"), out: str = "barangay_code", vocabulary: Vocabulary = DEFAULT, bound: int = 500_000, task_rows: int = 200_000) -> DataFrame:
    """rows with the code of the barangay meant (NONE: unmatched) and ``exact``: all four are the tables' names, character by character.

    ``geography`` are the tables of regions, provinces, cities and barangays. Up to ``bound`` rows in all they are
    broadcast. Beyond, they are copied to each group of about ``task_rows`` rows by a shuffle, with the same results:
    a name may be typed at any level and without its parents, so each task needs them all. Null and empty are equal,
    and name the province of a city without one. What fits several barangays equally well is NONE. Repeated rows get
    equal results; columns that bear a new name give way; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    listed = _listed(*geography)
    source = rows.drop(out, "exact")
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.StringType()), T.StructField("exact", T.BooleanType())])
    small = [tuple(r) for r in listed.limit(bound + 1).collect()]
    made: list[Gazetteer] = []
    if len(small) > bound:
        groups = -(-source.count() // task_rows)
        if not groups:
            return source.withColumns({out: F.lit(None).cast("string"), "exact": F.lit(None).cast("boolean")})
        keyed = source.withColumn("__g", F.pmod(F.xxhash64(*columns), F.lit(groups)))
        copied = listed.withColumn("__g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(keyed.select("__g").distinct(), "__g", "left_semi")

        def both(frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
            plain = lambda x: None if x is None or x != x else x
            gazetteer = gazetteer_of([tuple(map(plain, r)) for r in zip(*(table[c] for c in ("level", "code", "parent", "above", "name")))], vocabulary)
            typed = [tuple(map(plain, t)) for t in zip(*(frame[c] for c in columns))]
            codes, same = _resolved(gazetteer, typed, {})
            return frame.drop(columns="__g").assign(**{out: codes, "exact": same})

        return keyed.groupBy("__g").cogroup(copied.groupBy("__g")).applyInPandas(both, schema)
    shared = rows.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(gazetteer_of(shared.value, vocabulary))
        known: dict = {}
        for batch in batches:
            typed = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)))
            codes, same = _resolved(made[0], typed, known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string()), pa.array(same, pa.bool_())], names=[*batch.schema.names, out, "exact"])

    return source.mapInArrow(run, schema)
