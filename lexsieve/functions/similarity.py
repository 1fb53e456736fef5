"""Jaro-Winkler similarity, and the bounds that spare most pairs its computation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro over code points, with up to four common leading ones rewarded above 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _padded(strings: list[str], width: int, fill: int) -> np.ndarray:
    """Code points, a row a string."""
    out = np.full((len(strings), width), fill, np.int32)
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.int32)
    size = np.array([len(s) for s in strings], np.int64)
    row = np.repeat(np.arange(len(strings)), size)
    out[row, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)] = codes
    return out


def _jaro_of(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of the padded rows of x and y, none empty, all pairs at once: a step for each character of x."""
    n, place = len(x), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    mine, taken = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(x.shape[1]):
        free = (y == x[:, i, None]) & ~taken & (place >= (i - reach)[:, None]) & (place <= (i + reach)[:, None])
        first = free.argmax(axis=1)
        hit = free[np.arange(n), first]
        mine[hit, i] = True
        taken[hit, first[hit]] = True
    m = mine.sum(axis=1)
    # matched characters in their order, side by side
    width = int(m.max(initial=0))
    u = np.take_along_axis(x, np.argsort(~mine, axis=1, kind="stable")[:, :width], 1)
    v = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable")[:, :width], 1)
    swaps = ((u != v) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / some) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    prefix = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler_all(a: list[str], b: list[str], cells: int = 1 << 20) -> np.ndarray:
    """The similarity of each pair, as ``jaro_winkler_of`` gives it; pairs of about one length are scored together."""
    la, lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    out = np.where((la == 0) & (lb == 0), 1.0, 0.0)
    longest = np.maximum(la, lb)
    some = np.flatnonzero((la > 0) & (lb > 0))
    kind = np.ceil(np.log2(longest[some])).astype(np.int64)
    for c in np.unique(kind):
        mine, step = some[kind == c], max(1, cells >> int(c))
        for at in range(0, len(mine), step):
            k = mine[at : at + step]
            x, y = _padded([a[i] for i in k], int(la[k].max()), -1), _padded([b[i] for i in k], int(lb[k].max()), -2)
            out[k] = _jaro_of(x, y, la[k], lb[k])
    return out


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    some = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[some] = jaro_winkler_all(a[some].tolist(), b[some].tolist())
    return pd.Series(out).where(some, None)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two raw strings, 0 to 1; null if either is null."""
    return _jaro_winkler(a, b)


def least_jaro(threshold: float) -> float:
    """What Jaro must exceed for Jaro-Winkler to exceed the threshold, whatever the common prefix."""
    return (threshold - 0.4) / 0.6


_CAP = 32_767
#: Pairs of a word and a key that are bounded at once, and characters of them that are scored at once.
CELLS = 1 << 18


def _counts(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, set of characters, how often each string has each character), characters in 64 buckets."""
    size = np.array([len(s) for s in strings], np.int64)
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32) % 64
    table = np.bincount(np.repeat(np.arange(len(strings)), size) * 64 + codes, minlength=64 * len(strings)).reshape(-1, 64)
    return size, ((table > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), np.minimum(table, _CAP).astype(np.int16)


class Matcher:
    """Keys that words are compared with: all pairs are bounded by lengths and characters in numpy, the rest scored."""

    def __init__(self, keys: list[str], threshold: float):
        self.keys, self.threshold = keys, threshold
        self.size, self.chars, self.table = _counts(keys)

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, key, similarity) of the pairs above the threshold, by number."""
        j = least_jaro(self.threshold)
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        step = max(1, CELLS // max(1, len(self.keys)))
        for at in range(0, len(words), step):
            size, letters, table = _counts(words[at : at + step])
            if j <= 0:
                w, k = np.meshgrid(np.arange(len(size)), np.arange(len(self.keys)), indexing="ij")
                found.append(self._scored(words, w.ravel() + at, k.ravel()))
                continue
            # no more characters match than either has, without those that the other lacks
            a, b = letters[:, None], self.chars[None]
            most = np.minimum(size[:, None] - np.bitwise_count(a & ~b), self.size[None] - np.bitwise_count(b & ~a))
            may = lambda m, x, y: (m > 0) & (m / np.maximum(x, 1) + m / np.maximum(y, 1) > 3 * j - 1 - 1e-9)
            w, k = np.nonzero(may(most, size[:, None], self.size[None]))
            shared = np.minimum(table[w], self.table[k]).sum(axis=1, dtype=np.int64)
            capped = (table[w] == _CAP).any(axis=1) | (self.table[k] == _CAP).any(axis=1)
            keep = capped | may(shared, size[w], self.size[k])
            found.append(self._scored(words, w[keep] + at, k[keep]))
        w, k, score = (np.concatenate([x[i] for x in found]) for i in range(3))
        return w, k, score

    def _scored(self, words: list[str], w: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = jaro_winkler_all([words[i] for i in w], [self.keys[i] for i in k], CELLS)
        keep = score > self.threshold
        return w[keep], k[keep], score[keep]


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler(a, b)`` available to SQL."""
    spark.udf.register("jaro_winkler", _jaro_winkler)
