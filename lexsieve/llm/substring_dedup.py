"""Exact substring repeats by fixed-block anchors.

Every document's words (runs of bytes above U+0020) are cut into non-overlapping reference blocks of B words,
and every rolling window of B words probes them. A repeat of at least L >= 2B - 1 words holds a whole reference
block of its other occurrence, so each of its windows of L words starts at most L - B words before a hit. Only
those windows are then hashed in full and counted, and runs of repeated windows that follow one other occurrence
word by word are joined into maximal repeats. Hashes travel packed, by shuffle part, in binary columns: some
eight bytes a window instead of a row each; probes carry 40 bits of a hash, the confirming windows all 64. No pairs of documents are formed: each window refers to the first
occurrence (by doc_id, position) of its words, and that one to the second, so a group of n copies costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X
from lexsieve.llm._spark import text_bytes

MIN_WORDS = 50
BLOCK = 25
#: Windows in one shuffle part, and bytes of text packed into one row for each part.
PART_WINDOWS = 3_000_000
PACK_BYTES = 8 << 20

_PACKED = "part int, docs binary, cnt binary, lo binary, hi binary, pos binary"
OUT = "doc_id long, start_word int, n_words int, ref_doc_id long, ref_start_word int"


class _Packer:
    """Collects (hash, document, position) and gives rows of _PACKED, one for each part."""

    def __init__(self, parts: int, high: type):
        self.high = high  # the type that holds the hash's bits above 32
        self.parts, self.h, self.doc, self.pos, self.n = parts, [], [], [], 0

    def add(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        self.h.append(h)
        self.doc.append(doc)
        self.pos.append(pos.astype(np.int32))
        self.n += len(h)

    def rows(self) -> pa.RecordBatch:
        h, doc, pos = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.h, np.uint64), (self.doc, np.int64), (self.pos, np.int32)))
        self.h, self.doc, self.pos, self.n = [], [], [], 0
        part = X.part_of(h, self.parts)
        order = np.argsort(part, kind="stable")
        h, doc, pos, part = h[order], doc[order], pos[order], part[order]
        bounds = np.append(X.run_starts(part), len(part))
        lo, hi = h.astype(np.uint32), (h >> np.uint64(32)).astype(self.high)
        out: dict[str, list] = {k: [] for k in ("part", "docs", "cnt", "lo", "hi", "pos")}
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            d = X.run_starts(doc[a:b])
            out["part"].append(int(part[a]))
            out["docs"].append(X.planes(doc[a:b][d]))
            out["cnt"].append(X.planes(np.diff(np.append(d, b - a)).astype(np.int32)))
            out["lo"].append(X.planes(lo[a:b]))
            out["hi"].append(X.planes(hi[a:b]))
            out["pos"].append(X.planes(pos[a:b]))
        types = [pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def _unpack(table: pa.Table, high: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = {name: X.unplanes(table.column(name), t) for name, t in (("docs", np.int64), ("cnt", np.int32), ("lo", np.uint32), ("hi", high), ("pos", np.int32))}
    h = cols["lo"].astype(np.uint64) | (cols["hi"].astype(np.uint64) << np.uint64(32))
    return h, np.repeat(cols["docs"], cols["cnt"]), cols["pos"]


def _probe(parts: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held = _Packer(parts, np.uint8), 0
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                t = X.tokens(piece.column("text"), "space")
                at, h = X.windows(t.hash, t.off, block)
                ids = np.asarray(piece.column("doc_id"))
                pack.add(h, ids[t.doc[at]], t.pos()[at])
                held += piece.nbytes
                if held >= PACK_BYTES:
                    yield pack.rows()
                    held = 0
        if pack.n:
            yield pack.rows()

    return run


def _by_doc(doc: np.ndarray, *cols: np.ndarray, names: tuple[str, ...]) -> pa.Table:
    cuts = X.run_starts(doc)
    bounds = np.append(cuts, len(doc))
    data = {"doc_id": pa.array(doc[cuts], pa.int64())}
    for name, c in zip(names, cols, strict=True):
        data[name] = pa.array([c[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return pa.table(data)


def _hits(block: int):
    def run(table: pa.Table) -> pa.Table:
        h, doc, pos = _unpack(table, np.uint8)
        refs = np.unique(h[pos % block == 0])
        if len(refs) == 0:
            return _by_doc(np.zeros(0, np.int64), np.zeros(0, np.int32), names=("hits",))
        keep = refs[np.minimum(np.searchsorted(refs, h), len(refs) - 1)] == h
        h, doc, pos = h[keep], doc[keep], pos[keep]
        order = np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        one = X.run_starts(h, doc, pos)  # repeated rows of one document count once
        h, doc, pos = h[one], doc[one], pos[one]
        starts = X.run_starts(h)
        many = np.repeat(np.diff(np.append(starts, len(h))) > 1, np.diff(np.append(starts, len(h))))
        doc, pos = doc[many], pos[many]
        order = np.lexsort((pos, doc))
        return _by_doc(doc[order], pos[order], names=("hits",))

    return run


def _confirm(parts: int, length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held = _Packer(parts, np.uint32), 0
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                t = X.tokens(piece.column("text"), "space")
                at, h = X.windows(t.hash, t.off, length)
                wanted = np.zeros(len(t.hash) + 1, dtype=np.int32)
                for k, lists in enumerate(piece.column("hits")):
                    a, b = int(t.off[k]), int(t.off[k + 1])
                    if b - a < length:
                        continue
                    for x in lists:
                        p = np.frombuffer(x.as_buffer(), dtype=np.int32)
                        p = p[p < b - a]  # another text under the same doc_id may be longer
                        np.add.at(wanted, np.maximum(p - (length - block), 0) + a, 1)
                        np.add.at(wanted, p + a + 1, -1)
                keep = np.cumsum(wanted[:-1])[at] > 0
                at, h = at[keep], h[keep]
                ids = np.asarray(piece.column("doc_id"))
                pack.add(h, ids[t.doc[at]], t.pos()[at])
                held += piece.nbytes
                if held >= PACK_BYTES and pack.n:
                    yield pack.rows()
                    held = 0
        if pack.n:
            yield pack.rows()

    return run


def _refs(table: pa.Table) -> pa.Table:
    h, doc, pos = _unpack(table, np.uint32)
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    one = X.run_starts(h, doc, pos)
    h, doc, pos = h[one], doc[one], pos[one]
    starts = X.run_starts(h)
    sizes = np.diff(np.append(starts, len(h)))
    first = np.repeat(starts, sizes)
    many = np.repeat(sizes > 1, sizes)
    ref = np.where(np.arange(len(h)) == first, np.minimum(first + 1, max(len(h) - 1, 0)), first)
    doc, pos, ref_doc, ref_pos = doc[many], pos[many], doc[ref][many], pos[ref][many]
    order = np.lexsort((pos, doc))
    return _by_doc(doc[order], pos[order], ref_doc[order], ref_pos[order], names=("pos", "ref_doc", "ref_pos"))


def _spans(length: int):
    def run(table: pa.Table) -> pa.Table:
        got = [np.concatenate([np.frombuffer(x.as_buffer(), dtype=t) for x in table.column(c)]) for c, t in (("pos", np.int32), ("ref_doc", np.int64), ("ref_pos", np.int32))]
        pos, ref_doc, ref_pos = got
        order = np.lexsort((ref_pos, ref_doc, pos))
        pos, ref_doc, ref_pos = pos[order], ref_doc[order], ref_pos[order]
        index = np.arange(len(pos))
        starts = X.run_starts(pos - index, ref_doc, ref_pos.astype(np.int64) - index)
        sizes = np.diff(np.append(starts, len(pos)))
        n = len(starts)
        return pa.table(
            {
                "doc_id": pa.array(np.full(n, table.column("doc_id")[0].as_py(), dtype=np.int64)),
                "start_word": pa.array(pos[starts].astype(np.int32)),
                "n_words": pa.array((sizes + length - 1).astype(np.int32)),
                "ref_doc_id": pa.array(ref_doc[starts]),
                "ref_start_word": pa.array(ref_pos[starts].astype(np.int32)),
            }
        )

    return run


def substring_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """Maximal runs of at least ``min_words`` words that occur elsewhere too, in another document or the same one.

    Returns (doc_id, start_word, n_words, ref_doc_id, ref_start_word), one row for each run of windows of
    ``min_words`` words whose reference moves along with them. The reference of a window is the first of all its
    occurrences by (doc_id, position), and for that first one the second. Runs of one document may overlap where
    the reference changes.

    Null or empty texts and texts of fewer words give no row; rows with a null id take no part. Rows repeated
    under one id count as one occurrence. Empty input gives an empty result; columns other than the two named
    are not looked at.
    """
    if min_words < 2 * block - 1:
        raise ValueError("min_words must be at least 2 * block - 1")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    parts = max(4, -(-text_bytes(docs) // 6 // PART_WINDOWS))
    hits = docs.mapInArrow(_probe(parts, block), _PACKED).groupBy("part").applyInArrow(_hits(block), "doc_id long, hits binary")
    hits = hits.groupBy("doc_id").agg(F.collect_list("hits").alias("hits")).withColumnRenamed("doc_id", "hit_id")
    found = docs.join(hits, F.col("doc_id") == F.col("hit_id")).select("doc_id", "text", "hits")
    windows = found.mapInArrow(_confirm(parts, min_words, block), _PACKED).groupBy("part").applyInArrow(_refs, "doc_id long, pos binary, ref_doc binary, ref_pos binary")
    return windows.groupBy("doc_id").applyInArrow(_spans(min_words), OUT)


def repeats_by_brute_force(rows: list[tuple], min_words: int = MIN_WORDS) -> pd.DataFrame:
    """The same result from Python lists, for tests."""
    import re

    seen: dict[tuple, set] = {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        w = [x for x in re.split("[\x00-\x20]+", text) if x]
        for i in range(len(w) - min_words + 1):
            seen.setdefault(tuple(w[i : i + min_words]), set()).add((doc, i))
    flat = []
    for places in seen.values():
        if len(places) > 1:
            p = sorted(places)
            flat += [(d, i, *(p[1] if (d, i) == p[0] else p[0])) for d, i in p]
    out: list[list] = []
    for d, i, r, j in sorted(flat):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] - min_words + 1 == i and out[-1][3] == r and j - out[-1][4] == i - out[-1][1]:
            out[-1][2] += 1
        else:
            out.append([d, i, min_words, r, j])
    return pd.DataFrame(out, columns=["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word"])
