"""Tokenising and hashing of Arrow text columns in numpy, without Python objects for each token.

A token's hash is a polynomial over its bytes modulo 2**64, taken as a difference of prefix sums, so that
all tokens of a slice are hashed in a few vector operations; windows of tokens are hashed the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_U = np.uint64
_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "token": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 1)
        base = _BASE[kind]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[kind] = (both[0], both[1])
    return have


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _tables() -> dict[str, np.ndarray]:
    space = np.ones(256, dtype=bool)
    space[: 0x21] = False
    word = np.zeros(256, dtype=bool)
    word[0x80:] = True
    for a, b in ("09", "az", "AZ"):
        word[ord(a) : ord(b) + 1] = True
    return {"space": space, "word": word}


#: Bytes inside tokens. "space": all above U+0020. "word": ASCII letters and digits and all beyond ASCII.
INSIDE = _tables()


class Tokens:
    """Tokens of a slice of texts: ``hash``, byte ``start`` and ``end`` in the document, ``off`` by document."""

    __slots__ = ("end", "hash", "off", "start")

    def __init__(self, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray):
        self.hash, self.start, self.end, self.off = hash_, start, end, off

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def pos(self) -> np.ndarray:
        """Each token's index in its document."""
        return np.arange(len(self.hash)) - np.repeat(self.off[:-1], np.diff(self.off))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    if n == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def _spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    is_in = inside[data]
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[off] = True
    before = np.empty_like(is_in)
    before[0] = False
    before[1:] = is_in[:-1]
    start = np.flatnonzero(is_in & (~before | cuts[:-1]))
    after = np.empty_like(is_in)
    after[-1] = False
    after[:-1] = is_in[1:]
    end = np.flatnonzero(is_in & (~after | cuts[1:])) + 1
    return start, end


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), whatever their number and overlap; starts ascend."""
    out = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(start, base + SEGMENT)))
        top = int(end[lo:hi].max())
        pw, ipw = _powers("byte", top - base + 1)
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base:top]] * pw[: top - base], out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * ipw[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def tokens(texts: pa.Array, mode: str = "word", lower: bool = False) -> Tokens:
    """Tokens of the texts. ``lower`` folds the case of all letters first; offsets are then of the folded text."""
    if lower:
        texts = pc.utf8_lower(texts)
    data, off = raw(texts)
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    start, end = _spans(data, off, INSIDE[mode])
    hashes = prefix_hashes(data, start, end)
    tok_off = np.searchsorted(start, off)
    base = np.repeat(off[:-1], np.diff(tok_off))
    return Tokens(hashes, start - base, end - base, tok_off)


def windows(values: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first token, hash) of every run of k tokens inside one document."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(off[1:], np.diff(off))
    at = np.flatnonzero(np.arange(n) + k <= ends)
    out = np.empty(len(at), dtype=np.uint64)
    lo = 0
    while lo < len(at):
        base = int(at[lo])
        hi = max(lo + 1, int(np.searchsorted(at, base + SEGMENT - k)))
        top = int(at[hi - 1]) + k
        pw, ipw = _powers("token", top - base + 1)
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(values[base:top] * pw[: top - base], out=sums[1:])
        a = at[lo:hi] - base
        out[lo:hi] = mix((sums[a + k] - sums[a]) * ipw[a])
        lo = hi
    return at, out


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``max_bytes`` of text; a longer text comes alone and whole."""
    col = batch.column(text)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    lo = 0
    ends = np.cumsum(size)
    while lo < len(size):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """A hash's shuffle part, from its high half."""
    return (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int32)


def run_starts(*cols: np.ndarray) -> np.ndarray:
    """Indices at which any of the sorted columns changes, 0 included."""
    n = len(cols[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, all lowest ones first: slowly changing high bytes then compress well in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The arrays of a binary column that ``planes`` wrote, one after another."""
    size = np.dtype(dtype).itemsize
    out = []
    for x in column:
        b = np.frombuffer(x.as_buffer(), dtype=np.uint8)
        out.append(np.ascontiguousarray(b.reshape(size, len(b) // size).T).reshape(-1).view(dtype))
    return np.concatenate(out) if out else np.zeros(0, dtype)


def stems(texts: pa.Array, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, words by document) of all lowercase words and of their first bytes, as many as ``lengths`` say."""
    data, off = raw(pc.utf8_lower(texts))
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    start, end = _spans(data, off, INSIDE["word"])
    count = np.diff(np.searchsorted(start, off))
    doc = np.repeat(np.arange(len(count)), count)
    hashes, docs = [prefix_hashes(data, start, end)], [doc]
    for n in lengths:
        long = end - start > n
        hashes.append(prefix_hashes(data, start[long], start[long] + n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs), count
