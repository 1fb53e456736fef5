"""Benchmark decontamination by greedy string tiling over shared-word seeds.

Texts are lowercase words (ASCII letters and digits and everything beyond ASCII; other bytes separate). Every run
of MIN_MATCH words of a benchmark item is a seed. A document that shares seeds with an item is tiled against it:
the longest match of unmarked words is marked in both, again and again, down to MIN_MATCH words; running hashes of
all windows find the matches. An item is leaked to the degree its words are covered by tiles, in whatever order
the passages stand in the document.

The seed index is broadcast while the benchmark's texts are within BROADCAST_BYTES; documents are then scanned
once, with no shuffle. A larger benchmark is joined with the documents' seeds by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X
from lexsieve.llm._spark import text_bytes

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BROADCAST_BYTES = 16 << 20
#: An item and a text with more pairs of equal windows are tiled by length, with the same tiles.
MAX_PAIRS = 1 << 18
OUT = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"


def tile(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, words), longest first, ties by start in a, then b.

    ``at_a``, ``at_b``: the starts of all pairs of equal windows of k words. Windows that follow one another on a
    diagonal are one match; a match that loses words to a tile goes on with what is left of it on either side.
    """
    order = np.lexsort((at_a, at_b - at_a))
    x, d = at_a[order], (at_b - at_a)[order]
    starts = X.run_starts(d, x - np.arange(len(x)))
    sizes = np.diff(np.append(starts, len(x))) + k - 1
    import heapq

    heap = [(-int(n), int(i), int(i + e)) for i, e, n in zip(x[starts], d[starts], sizes, strict=True)]
    heapq.heapify(heap)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = used_a[i : i + n] | used_b[j : j + n]
        if not taken.any():
            used_a[i : i + n] = True
            used_b[j : j + n] = True
            tiles.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), i + int(s), j + int(s)))
    return tiles


def _starts(words: np.ndarray, used: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, running hash) of the windows of ``size`` unmarked words."""
    at, h = X.windows(words, np.array([0, len(words)]), size)
    marks = np.concatenate(([0], np.cumsum(used)))
    free = marks[at + size] == marks[at]
    return at[free], h[free]


def tile_by_length(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile`` without its pairs of windows: the greatest length of which unmarked windows of both match is
    found by bisection over running hashes, again and again. For texts that repeat themselves, whose pairs are many."""
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))
    while most >= k:
        low, high, best = k, most, None
        while low <= high:
            size = (low + high) // 2
            at_a, h_a = _starts(a, used_a, size)
            at_b, h_b = _starts(b, used_b, size)
            first = np.flatnonzero(np.isin(h_a, h_b))
            if len(first):
                i = int(first[0])
                best = (int(at_a[i]), int(at_b[np.flatnonzero(h_b == h_a[i])[0]]), size)
                low = size + 1
            else:
                high = size - 1
        if best is None:
            break
        i, j, most = best
        used_a[i : i + most] = True
        used_b[j : j + most] = True
        tiles.append(best)
    return tiles


class Index:
    """Seeds of all items: ``seeds`` sorted, with the item and position of each."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        t = X.tokens(pa.array(texts, pa.string()), "word", lower=True)
        at, h = X.windows(t.hash, t.off, k)
        order = np.argsort(h, kind="stable")
        self.k, self.ids, self.hash, self.off = k, ids, t.hash, t.off
        self.seeds, self.item, self.pos = h[order], t.doc[at][order], t.pos()[at][order]

    def words(self, item: int) -> np.ndarray:
        return self.hash[self.off[item] : self.off[item + 1]]


def _matches(index: Index, words: np.ndarray, at: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item, coverage, tiles, longest) of a document, given those of its windows that are seeds."""
    # pairs of windows by item: a seed that stands often in both has the product of either number
    names, seed, often = np.unique(h, return_inverse=True, return_counts=True)
    lo, hi = np.searchsorted(index.seeds, names, "left"), np.searchsorted(index.seeds, names, "right")
    n = hi - lo
    flat = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    pairs = np.bincount(index.item[flat], np.repeat(often, n), len(index.ids))
    for k in np.flatnonzero(pairs > MAX_PAIRS):
        tiles = tile_by_length(index.words(int(k)), words, index.k)
        yield int(k), sum(x[2] for x in tiles) / len(index.words(int(k))), len(tiles), max(x[2] for x in tiles)
    # each of the text's windows against the index's entries of the other items
    keep = pairs[index.item[flat]] <= MAX_PAIRS
    of, entry = np.repeat(np.arange(len(names)), n)[keep], flat[keep]
    n = np.bincount(of, minlength=len(names))
    first = np.cumsum(n) - n
    n, first = n[seed], first[seed]
    each = entry[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    item, pos, doc_at = index.item[each], index.pos[each], np.repeat(at, n)
    order = np.argsort(item, kind="stable")
    item, pos, doc_at = item[order], pos[order], doc_at[order]
    cuts = np.append(X.run_starts(item), len(item))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = int(item[a])
        mine = index.words(k)
        tiles = tile(mine, words, pos[a:b], doc_at[a:b], index.k)
        yield k, sum(x[2] for x in tiles) / len(mine), len(tiles), max(x[2] for x in tiles)


def _scan(shared, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        seeds = np.unique(index.seeds)
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "item_id": [], "coverage": [], "n_tiles": [], "longest_tile": []}
            for piece in X.slices(batch, "text", 1 << 20):
                t = X.tokens(piece.column("text"), "word", lower=True)
                at, h = X.windows(t.hash, t.off, index.k)
                if not len(at) or not len(seeds):
                    continue
                hit = seeds[np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)] == h
                at, h = at[hit], h[hit]
                doc = t.doc[at]
                cuts = np.append(X.run_starts(doc), len(doc))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    d = int(doc[a])
                    base = int(t.off[d])
                    for item, share, n, longest in _matches(index, t.hash[base : t.off[d + 1]], at[a:b] - base, h[a:b]):
                        if share >= min_coverage:
                            for c, v in zip(out.values(), (piece.column("doc_id")[d].as_py(), index.ids[item], share, n, longest), strict=True):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=list(out))

    return run


def _seed_rows(k: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                t = X.tokens(piece.column("text"), "word", lower=True)
                at, h = X.windows(t.hash, t.off, k)
                ids = np.asarray(piece.column(name))[t.doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], names=["seed", name])

    return run


def _pairs(k: int, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item")), strict=True):
                index = Index([item_id], [item], k)
                t = X.tokens(pa.array([text], pa.string()), "word", lower=True)
                at, h = X.windows(t.hash, t.off, k)
                hit = np.isin(h, index.seeds)
                if hit.any():
                    out += [(doc_id, item_id, share, n, longest) for _, share, n, longest in _matches(index, t.hash, at[hit], h[hit]) if share >= min_coverage]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of each document and item of which tiles of at least
    ``min_match`` words cover the share ``min_coverage`` or more.

    Null ids and null texts on either side take no part, and neither do items and documents of fewer than
    ``min_match`` words, empty ones included. Long texts, repetitive ones too, are tiled whole. Of matches as long the one
    that starts first in the item, then in the document, is marked first; a coverage equal to ``min_coverage`` is
    reported. A row repeated in the documents is reported as often, and so is each text under one id; repeated items
    count once, and two texts under one item id are two items. An empty table on either side gives an empty result.
    Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    if text_bytes(items) <= broadcast_bytes:
        rows = sorted(map(tuple, items.collect()))
        shared = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], min_match))
        return docs.mapInArrow(_scan(shared, min_coverage), OUT)
    a = docs.mapInArrow(_seed_rows(min_match, "doc_id"), "seed long, doc_id long").distinct()
    b = items.mapInArrow(_seed_rows(min_match, "item_id"), "seed long, item_id long").distinct()
    pairs = a.join(b, "seed").select("doc_id", "item_id").distinct()
    pairs = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(docs, "doc_id")
    return pairs.select("doc_id", "text", "item_id", "item").mapInArrow(_pairs(min_match, min_coverage), OUT)


def brute_force_tiles(a: list[str], b: list[str], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by comparing every pair of positions, for tests."""
    ua, ub, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        i, j, n = best
        ua[i : i + n] = [True] * n
        ub[j : j + n] = [True] * n
