"""String similarities as column expressions: edit distance, Hamming, Jaro and Jaro-Winkler, by code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of first, middle, last name and extension in a pair's total.
WEIGHTS = {"first": 0.49, "middle": 0.05, "last": 0.45, "extension": 0.01}


def _bind(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity from 0 to 1 of two non-empty strings; a transposition is half a mismatch, not rounded down.

    One pass over a's characters keeps the positions taken in b, so nothing is sorted but the matches.
    """

    def scored(x: Column) -> Column:
        left, right = x["l"], x["r"]
        n, m = F.size(left), F.size(right)
        window = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")

        def step(taken: Column, i: Column) -> Column:
            lo, hi = F.greatest(i - window, F.lit(0)), F.least(i + window, m - 1)
            free = F.filter(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda j: (F.get(right, j) == F.get(left, i)) & ~F.exists(taken, lambda t: t["j"] == j))
            return F.when(F.size(free) > 0, F.concat(taken, F.array(F.struct(i.alias("i"), F.get(free, F.lit(0)).alias("j"))))).otherwise(taken)

        taken = F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<struct<i:int,j:int>>"), step)

        def finish(t: Column) -> Column:
            k = F.size(t).cast("double")
            order = F.array_sort(F.transform(t, lambda p: p["j"]))
            off = F.size(F.filter(F.zip_with(t, order, lambda p, q: F.get(left, p["i"]) != F.get(right, q)), lambda d: d))
            return F.when(k == 0, F.lit(0.0)).otherwise((k / n + k / m + (k - off / 2.0) / k) / 3.0)

        return _bind(taken, finish)

    return _bind(F.struct(_chars(a).alias("l"), _chars(b).alias("r")), scored)


def _winkler(a: Column, b: Column) -> Column:
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in (1, 2, 3, 4)]
    fits = [(F.length(a) >= k) & (F.length(b) >= k) & s for k, s in zip((1, 2, 3, 4), same)]
    prefix = sum((F.when(f, 1).otherwise(0) for f in fits), F.lit(0))
    return _bind(jaro(a, b), lambda j: j + prefix * 0.1 * (1.0 - j))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def edges(a: Column, b: Column, otherwise: Column) -> Column:
    """The score of empty and of equal strings; otherwise the given one."""
    return F.when((a == "") & (b == ""), 100.0).when((a == "") | (b == ""), 0.0).when(a == b, 100.0).otherwise(otherwise)


def levenshtein_score(a: Column | str, b: Column | str) -> Column:
    """0 to 100; both empty 100, one empty 0; null counts as empty."""
    a, b = _text(a), _text(b)
    return edges(a, b, F.round(100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))), 6))


def hamming_score(a: Column | str, b: Column | str) -> Column:
    """0 to 100; strings of unequal length score 0."""
    a, b = _text(a), _text(b)
    off = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return edges(a, b, F.when(F.length(a) != F.length(b), 0.0).otherwise(F.round(100 * (1 - off / F.length(a)), 6)))


def jaro_winkler_score(a: Column | str, b: Column | str) -> Column:
    """0 to 100; the prefix counts at any Jaro value."""
    a, b = _text(a), _text(b)
    return edges(a, b, F.round(100 * _winkler(a, b), 6))


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """0 to 1, not rounded; 0 if either is empty."""
    a, b = _text(a), _text(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.least(F.greatest(_winkler(a, b), F.lit(0.0)), F.lit(1.0)))


def total_score(first: Column, middle: Column, last: Column, extension: Column) -> Column:
    w = WEIGHTS
    return F.round(w["first"] * first + w["middle"] * middle + w["last"] * last + w["extension"] * extension, 6)
