"""Problem 10: one consistent form for texts that look the same.

Method: compatibility normalization and deletion of ignorable characters, then a Viterbi search through each token's
look-alike lattice. A lattice has at every letter all characters of that shape; the path with the fewest changes of
script wins, among those the one with the best character-bigram score in its script, among those Latin first. The
lattice depends on the token's shapes alone, so two tokens that look alike always get the same form, and tokens of
different shapes never do. Bigrams are counted over all texts, by script, from letters that stand beside each other.
Shapes come from a short fixed table and, where the session has it, from the Unicode confusables of Spark's own ICU.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable

# Letters of other scripts and the Latin letters and signs whose shape they have.
SHAPES = {
    "Cyrl": ("аеіјорсухѕһԁԛԝАВЕЗІЈКМНОРСТУХЅԌԚԜ", "aeijopcyxshdqwABE3IJKMHOPCTYXSGQW"),
    "Grek": ("ανορεικτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲϳ", "avopeiktuxyABEZHIKMNOPTYXCcj"),
    "Armn": ("օսոհցզԱՕՏԼ", "ounhgqUOSL"),
    "Latn": ("ɑɡıⱭꞬɩ", "agiAGi"),
    "Sign": ("‐‑⁃−∶ꞏ‚‘’ʼ′“”″", "----:·,''''\"\"\""),
}
#: Shapes that are no letters of the alphabet stay out of the lattice.
_SIGNS = {"3"}
SCRIPTS = ("Latn", "Grek", "Cyrl", "Armn")
#: Compatibility mappings that change no shape; superscripts, fractions, circled and styled forms look different.
_KEPT_TAGS = {"<wide>", "<narrow>", "<small>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}

_PLAIN = r"\x20-\x7eÀ-ÖØ-öø-İĴ-ľŁ-ňŊ-ž"
_SPECIAL = re.compile(f"[^{_PLAIN}]")
#: A letter that no plain Latin text has; all letters of the look-alike table but signs are such.
_FOREIGN = re.compile(f"[^\\W\\d_{_PLAIN}]")
_TOKEN = re.compile(r"[^\W\d_]+")
_SCRIPT_NAMES = {"LATIN": "Latn", "GREEK": "Grek", "CYRILLIC": "Cyrl", "ARMENIAN": "Armn"}


def script_of(c: str) -> str:
    """The script of a letter by the first word of its name; Zyyy for signs and what has no name."""
    if not c.isalpha():
        return "Zyyy"
    first = unicodedata.name(c, "Zyyy").partition(" ")[0]
    return _SCRIPT_NAMES.get(first, first)


class Shapes:
    """The look-alike table: the shape of each character, and the characters of each shape by script.

    ``extra`` adds (character, shape) to the fixed table. Of two letters of one script with one shape only the first
    counts, as a script tells its own letters apart; further Latin forms of a Latin letter all count.
    """

    def __init__(self, extra: Iterable[tuple[str, str]] = ()):
        self.extra = tuple(extra)
        self.prototype: dict[str, str] = {}
        self.alternatives: dict[str, dict[str, str]] = {}
        for script, (chars, like) in SHAPES.items():
            for c, shape in zip(chars, like):
                if shape not in _SIGNS:
                    self._add(c, shape, script)
        for c, shape in self.extra:
            script = script_of(c)
            if c not in self.prototype and (script == "Latn" or script not in self.alternatives.get(shape, {})):
                self._add(c, shape, script)
        self.signs = {*SHAPES["Sign"][0]}
        self.scripts = [*SCRIPTS, *sorted({s for of in self.alternatives.values() for s in of} - {*SCRIPTS})]
        self.letters = {"", *(c for of in self.alternatives.values() for c in of.values())}
        charset = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        self.lookalike = re.compile(charset({*self.prototype} - self.signs))
        self.choice = re.compile(charset({*self.prototype, *self.alternatives} - self.signs))
        self.ambiguous = re.compile(r"(?<![^\W\d_])" + charset(self.alternatives) + r"+(?![^\W\d_])")
        self.cache: dict[str, str] = {}

    def __reduce__(self) -> tuple:
        return Shapes, (self.extra,)

    def _add(self, c: str, shape: str, script: str) -> None:
        self.prototype[c] = shape
        if script not in ("Sign", "Latn"):
            self.alternatives.setdefault(shape, {"Latn": shape}).setdefault(script, c)

    def plain(self, c: str) -> str:
        """One character without its compatibility form, '' if it is ignorable, a space for any white space."""
        if c in self.cache:
            return self.cache[c]
        if c.isspace() or c in "\x1c\x1d\x1e\x1f⠀ㅤ":
            out = " "
        elif unicodedata.category(c) in ("Cf", "Cc") or c in "͏ᅟᅠ឴឵" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or 0x180B <= ord(c) <= 0x180F:
            out = ""
        else:
            # A look-alike's own compatibility form may have another shape, so the lattice takes it as it is.
            tag, _, codes = ("", "", "") if c in self.prototype else unicodedata.decomposition(c).partition(" ")
            out = "".join(self.plain(chr(int(x, 16))) for x in codes.split()) if tag in _KEPT_TAGS else c
            if out == c and c in self.signs:
                out = self.prototype[c]
        return self.cache.setdefault(c, out)


DEFAULT_SHAPES = Shapes()


def icu_shapes(spark: SparkSession) -> Shapes:
    """The fixed table with all cased letters (and Lisu, which has capitals only) that ICU calls confusable with one letter of the alphabet.

    ICU has one class for l, I and 1; capitals go to I and small letters to l. Letters that decompose look different, and
    of further Latin letters only small capitals of the very letter are taken, as most others differ at a glance. Without
    ICU in the session's Java classes it is the fixed table alone.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:
        return DEFAULT_SHAPES
    cased = lambda c: unicodedata.category(c) in ("Lu", "Ll") or unicodedata.name(c, "").startswith("LISU LETTER")
    letters = [c for c in map(chr, range(0x80, 0x20000)) if cased(c) and not unicodedata.decomposition(c)]
    found = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(found) != len(letters):
        return DEFAULT_SHAPES
    capital = lambda c: unicodedata.category(c) != "Ll"
    alike = lambda c, k: len(k) == 1 and k.isascii() and k.isalpha() and (script_of(c) != "Latn" or unicodedata.name(c) == f"LATIN LETTER SMALL CAPITAL {k.upper()}")
    return Shapes((c, "I" if k == "l" and capital(c) else k) for c, k in zip(letters, found) if alike(c, k))


class _Changed(dict):
    """Whether a word changes under a function, found once for each word."""

    def __init__(self, form: Callable[[str], str]):
        super().__init__()
        self.form = form

    def __missing__(self, word: str) -> bool:
        changed = self.form(word) != word
        if len(word) <= 64 and len(self) < 500_000:  # a memo, no limit on words
            self[word] = changed
        return changed


class Scorer:
    """Bigram scores by script. Without counts all bigrams score alike, and Latin wins where it is possible."""

    def __init__(self, counts: dict[tuple[str, str], int] | None = None, shapes: Shapes = DEFAULT_SHAPES):
        self.counts, self.shapes = counts or {}, shapes
        self.total = sum(self.counts.values()) + 1
        self.tokens: dict[str, str] = {}
        self.alternatives, self.prototype = shapes.alternatives, shapes.prototype
        #: Whether no bigram of look-alike shapes is more frequent in another script than in Latin: then no Latin token can change.
        self.latin_first = all(n <= self.counts.get((self.prototype.get(a, a), self.prototype.get(b, b)), 0) for (a, b), n in self.counts.items() if a in self.prototype or b in self.prototype)
        self.changed = _Changed(self._own)

    def __reduce__(self) -> tuple:
        return Scorer, (self.counts, self.shapes)

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.5) / self.total)

    def token(self, token: str) -> str:
        """The best path through the lattice of a token's shapes; '' stands before and after the token in bigrams."""
        shape = "".join(self.prototype.get(c, c) for c in token)
        if shape in self.tokens:
            return self.tokens[shape]
        # state: script -> (changes of script, -score, rank of scripts); back[i] has the script before each at place i.
        choices = [self.alternatives.get(p) or {script_of(p): p} for p in shape]
        order = self.shapes.scripts
        rank = {s: order.index(s) if s in order else len(order) for options in choices for s in options}
        states = {s: (0, -self.score("", c), rank[s]) for s, c in choices[0].items()}
        back: list[dict[str, str]] = []
        for before, options in zip(choices, choices[1:]):
            following, came = {}, {}
            for s, c in options.items():
                *state, _, came[s] = min((n + (s != t), cost - self.score(before[t], c), r + rank[s], rank[t], t) for t, (n, cost, r) in states.items())
                following[s] = tuple(state)
            states = following
            back.append(came)
        last = choices[-1]
        at = min((n, cost - self.score(last[s], ""), r, rank[s], s) for s, (n, cost, r) in states.items())[4]
        path = [at]
        for came in reversed(back):
            path.append(came[path[-1]])
        best = "".join(options[s] for options, s in zip(choices, reversed(path)))
        if len(shape) <= 64 and len(self.tokens) < 200_000:  # a memo, no limit on tokens
            self.tokens[shape] = best
        return best

    def _token(self, m: re.Match) -> str:
        """A token goes through the lattice if any character of it could be another one; a token of plain Latin letters needn't where Latin is first."""
        t, shapes = m[0], self.shapes
        if shapes.lookalike.search(t) or (not self.latin_first or _FOREIGN.search(t)) and shapes.choice.search(t):
            return self.token(t)
        return t

    def _own(self, text: str) -> str:
        """A text of plain letters whose tokens of look-alike shapes alone go through the lattice."""
        return self.shapes.ambiguous.sub(lambda m: self.token(m[0]), text)

    def canonical(self, text: str) -> str:
        if _SPECIAL.search(text):
            text = unicodedata.normalize("NFC", _SPECIAL.sub(lambda m: self.shapes.plain(m[0]), text))
            if _FOREIGN.search(text):
                return _TOKEN.sub(self._token, text)
        # No token reaches over white space, and few words are tokens that change, so most texts need no search.
        return text if self.latin_first or not any(map(self.changed.__getitem__, {*text.split()})) else self._own(text)


_LETTER = np.full(256, 52, np.int32)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
    _LETTER[ord(_c)] = _i
_LETTER[128:] = 53
_ODD = re.compile(r"[^\W\d_]*[^\W\d_\x00-\x7f][^\W\d_]*")


def count_bigrams(texts: Iterable[str]) -> Counter:
    """Bigrams of letters, '' being a token's edge: all within ASCII, and those of other tokens whose letters are of one script."""
    out: Counter = Counter()
    joined = " ".join(texts)
    classes = _LETTER[np.frombuffer(f" {joined} ".encode("utf-8", "replace"), np.uint8)]
    table = np.bincount(classes[:-1] * 54 + classes[1:], minlength=54 * 54).reshape(54, 54)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for a, b in np.argwhere(table[:53, :53]).tolist():
        if a != 52 or b != 52:
            out[letters[a] if a < 52 else "", letters[b] if b < 52 else ""] = int(table[a, b])
    # The pattern is slow on plain words, so it sees only those with another character.
    odd = " ".join(w for w in joined.split() if not w.isascii())
    for token, n in Counter(_ODD.findall(odd)).items():
        if len({script_of(c) for c in token}) == 1:
            edged = ["", *token, ""]
            for a, b in zip(edged, edged[1:]):
                out[a, b] += n
    return out


def bigram_scorer(documents: DataFrame, text: str = "text", shapes: Shapes | None = None) -> Scorer:
    """The scorer of a corpus. Only bigrams of the lattice's letters count, so their table, added up by the cluster, is bounded by the square of the look-alike table whatever the texts."""
    shapes = icu_shapes(documents.sparkSession) if shapes is None else shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(count_bigrams(x for x in batch.column(0).to_pylist() if x))
        total = Counter({k: n for k, n in total.items() if k[0] in shapes.letters and k[1] in shapes.letters})
        if total:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in total], "b": [b for _, b in total], "n": list(total.values())})

    rows = documents.select(F.col(text)).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Scorer({(r.a, r.b): r.n for r in rows}, shapes)


def canonical_text(documents: DataFrame, scorer: Scorer, text: str = "text", out: str = "canonical") -> DataFrame:
    """documents with the consistent form of a text; null stays null. A column that bears the new name gives way."""

    @F.pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        return s.map(scorer.canonical, na_action="ignore")

    return documents.withColumn(out, form(F.col(text)))


def look_keys(documents: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look, raw): 128-bit digests of the consistent form and of the text itself, of every text that isn't null or empty."""

    def digest(s: str) -> bytes:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = [digest(t) for t in texts]
            look = [r if (c := scorer.canonical(t)) == t else digest(c) for t, r in zip(texts, raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "look", "raw"])

    source = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, look binary, raw binary")


def same_look_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: all pairs of non-empty texts that look the same but differ in characters.

    Exact copies are one variant: variants are paired within a look, then copies are listed for each pair of variants,
    so nothing is joined that isn't a result. Repeated ids with equal texts give their pairs once each per row.
    An empty table, or one of null and empty texts, gives no rows.
    """
    keys = durable(look_keys(documents, bigram_scorer(documents, text), doc_id, text), "looks")
    variants = keys.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = variants.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    few = keys.join(several, "look", "left_semi")
    v = variants.join(several, "look", "left_semi")
    two = v.select("look", F.col("raw").alias("raw_a")).join(v.select("look", F.col("raw").alias("raw_b")), "look").where("raw_a < raw_b")
    a, b = (few.select(F.col("raw").alias(f"raw_{x}"), F.col("look").alias(f"look_{x}"), F.col("doc_id").alias(f"id_{x}")) for x in "ab")
    both = two.drop("look").join(a, "raw_a").join(b, "raw_b")
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))
