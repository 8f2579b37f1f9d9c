"""Jaro-Winkler over whole arrays of pairs, for tasks that score many; the values are those of similarity.jaro_winkler."""

from __future__ import annotations

import numpy as np

#: Pairs scored at once, so that their characters stay in the processor's cache.
BLOCK = 8_192


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    width = max(1, int(lengths.max()))
    return np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width), lengths


def _jaro_winkler(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of filled texts as rows of code points with their lengths."""
    a, b = a[:, : int(n.max())], b[:, : int(m.max())]
    window = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    at = np.arange(b.shape[1])
    free, hit = at < m[:, None], np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(at - i) <= window[:, None])
        fits[i >= n] = False
        rows = np.flatnonzero(fits.any(axis=1))
        hit[rows, i] = True
        free[rows, fits[rows].argmax(axis=1)] = False
    taken = ~free & (at < m[:, None])
    k = hit.sum(axis=1)
    # The matched characters of both in their own order, side by side.
    left, right = (np.zeros((len(k), max(1, int(k.max()))), np.uint32) for _ in range(2))
    for x, held, out in ((a, hit, left), (b, taken, right)):
        rows, cols = np.nonzero(held)
        out[rows, np.cumsum(held, axis=1)[rows, cols] - 1] = x[rows, cols]
    off = (left != right).sum(axis=1)
    some = np.maximum(k, 1).astype(float)
    jaro = np.where(k == 0, 0.0, (k / n + k / m + (k - off / 2.0) / some) / 3.0)
    first = min(4, a.shape[1], b.shape[1])
    same = (a[:, :first] == b[:, :first]) & (np.arange(first) < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.clip(jaro + prefix * 0.1 * (1.0 - jaro), 0.0, 1.0)


def jaro_winkler_of(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The similarities, 0 to 1, of the texts a[left[i]] and b[right[i]]; 0 if either is empty."""
    out = np.zeros(len(left))
    if not len(left):
        return out
    (x, n), (y, m) = _codes(list(a)), _codes(list(b))
    order = np.argsort(n[left] + m[right], kind="stable")
    order = order[(n[left] > 0)[order] & (m[right] > 0)[order]]
    for start in range(0, len(order), BLOCK):
        part = order[start : start + BLOCK]
        i, j = left[part], right[part]
        out[part] = _jaro_winkler(x[i], n[i], y[j], m[j])
    return out
