"""SentencePiece models run by the tokenizers library: parse the protobuf, rebuild its parts, encode and decode.

The model file is read field by field (no protobuf library): pieces with scores and types, the trainer's model type
and byte fallback, and the normaliser's flags and character map. A unigram model keeps its scores; a BPE model's
scores order its merges, every way to split a piece into two others being one merge. Space becomes the metaspace
marker; text is split before each run of markers, which is lossless as long as no piece has a marker after another
character, and each distinct word goes to the library once. Control pieces never match text. Parity with the sentencepiece
library is asserted on PROBES whenever a model is built (``verify``), and on whole tables in the tests.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 256 << 10
THREADS = 2
MAX_WORDS = 300_000
JOINED = 64
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PROBES = ("", " ", "a", "Hello world", "  two  spaces   and more ", "tab\tand\nnewline\r\n", "naïve café Ünïcödé", "中文字 日本語", "emoji 🙂🙃 end", "x" * 300, "<s> </s> <unk> <0x41>", MARK + "mark " + MARK, " " * 40 + "x", "1234567890 3.14 a@b.c")


def _fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(field number, value) of a protobuf message; nested messages as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: Any = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield key >> 3, value


def parse(data: bytes) -> dict[str, Any]:
    """A model's pieces [(piece, score, type)] and the settings that bear on encoding."""
    model: dict[str, Any] = {"pieces": [], "type": 1, "byte_fallback": False, "suffix": False, "dummy_prefix": True, "trim": True, "escape": True, "charsmap": b""}
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for f, v in _fields(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = v
                elif f == 3:
                    kind = v
            model["pieces"].append((piece, score, kind))
        elif field == 2:
            for f, v in _fields(value):
                name = {3: "type", 35: "byte_fallback", 24: "suffix"}.get(f)
                if name:
                    model[name] = v if name == "type" else bool(v)
        elif field == 3:
            for f, v in _fields(value):
                name = {2: "charsmap", 3: "dummy_prefix", 4: "trim", 5: "escape"}.get(f)
                if name:
                    model[name] = v if name == "charsmap" else bool(v)
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges by descending score. Runs of markers share one score and so merge from the left: the longest first,
    which is always the leftmost."""
    known = {p for p, _, kind in pieces if kind in (NORMAL, USER)}
    out = []
    for piece, score, kind in pieces:
        if kind not in (NORMAL, USER) or len(piece) < 2:
            continue
        run = 0 if piece.strip(MARK) else -len(piece)
        out += [(-score, run, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
    return [(a, b) for *_, a, b in sorted(out)]


def build(data: bytes):
    """The tokenizers.Tokenizer of a model file's bytes."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    pieces = m["pieces"]
    if m["suffix"] or not m["escape"]:
        raise ValueError("white space as suffix or unescaped isn't supported")
    unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
    if m["type"] == 1:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=m["byte_fallback"])
    elif m["type"] == 2:
        model = models.BPE(vocab={p: k for k, (p, _, _) in enumerate(pieces)}, merges=_merges(pieces), unk_token=pieces[unknown][0], byte_fallback=m["byte_fallback"], fuse_unk=True)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(model)
    steps: list = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["trim"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts: list = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else parts)
    return t


class Codec:
    """A model's tokenizer, and a table of the ids of words met so far.

    Texts are split into words by ``split``; words that aren't in the table are encoded by the library, all of a
    batch at once and multithreaded; a text's ids are then gathered from the table. Past MAX_WORDS the table
    starts anew, so its size doesn't follow the corpus. Without a lossless split, whole texts are encoded.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, decoders

        self.model = parse(data)
        self.full = build(data)
        normal = [p for p, _, kind in self.model["pieces"] if kind in (NORMAL, USER)]
        self.split = None
        if self.full.pre_tokenizer is not None:
            line = "" if any("\n" in p for p in normal) else "\n"
            self.split = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else "")).findall
        self.plain = not self.model["charsmap"] and not self.model["trim"]
        self.bare = Tokenizer(self.full.model)
        self.inner = Tokenizer(self.full.model)
        self.inner.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        feed = next((k for k, (p, _, kind) in enumerate(self.model["pieces"]) if kind == BYTE and p == "<0x0A>"), None)
        self.line = feed if self.model["byte_fallback"] and not any("\n" in p for p in normal) else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.good = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.used = 0

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray, good: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while len(self.start) <= n + m:
            self.start, self.good = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.good, np.zeros_like(self.good)))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : n + 1 + m] = self.used + np.cumsum(size)
        self.good[n : n + m] = good
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Enter new words with their ids and whether these decode to the word. A line feed that is a byte token joins
        words to texts of JOINED words: it never merges, so its id marks where they end."""
        joined = [w for w in words if w != "\n"] if self.line is not None else []
        groups = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        alone = words if self.line is None else ["\n"] * ("\n" in words)
        texts = ["\n".join(g) for g in groups] + alone
        each = [np.array(x.ids, np.int32) for x in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        good = np.array([x == y.replace(MARK, " ") for x, y in zip(self.decode_words(each), texts, strict=True)], dtype=bool)
        if groups:
            feed = np.array([self.line], np.int32)
            ids = np.concatenate([x for e in each[: len(groups)] for x in (e, feed)])
            ends = np.flatnonzero(ids == self.line)
            of_word = np.repeat(good[: len(groups)], [len(g) for g in groups])
            starts = np.append(0, ends[:-1] + 1)
            for k in np.flatnonzero(~of_word):
                of_word[k] = self.decode_words([ids[starts[k] : ends[k]]])[0] == joined[k].replace(MARK, " ")
            self._add(joined, ids[ids != self.line], ends - starts, of_word)
        if alone:
            rest = each[len(groups) :]
            self._add(alone, np.concatenate(rest), np.array([len(x) for x in rest]), good[len(groups) :])

    def decode_words(self, each: list) -> list[str]:
        """Texts of ids inside a text, whose first space stays."""
        return self.inner.decode_batch(each, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text, whether each decodes to itself). An empty text has no ids, not even the
        marker's."""
        if self.split is None:
            each = [np.array(e.ids if x else [], np.int32) for e, x in zip(self.full.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
            same = np.array([x == y for x, y in zip(texts, self.decode(each), strict=True)], dtype=bool)
            return np.concatenate([np.zeros(0, np.int32), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64), same
        if len(self.known) > MAX_WORDS:
            self.clear()
        first = MARK if self.model["dummy_prefix"] else ""
        plain = np.array([MARK not in x for x in texts], dtype=bool)
        if self.plain:
            words = [self.split(first + x.replace(" ", MARK)) if x else [] for x in texts]
        else:
            clean = [self.full.normalizer.normalize_str(x) if x else "" for x in texts]
            plain &= np.array([first + x.replace(" ", MARK) == y for x, y in zip(texts, clean, strict=True)], dtype=bool)
            words = [self.split(x) for x in clean]
        flat = list(itertools.chain.from_iterable(words))
        found = list(map(self.known.get, flat))
        if None in found:
            self._learn(list(dict.fromkeys(w for w, k in zip(flat, found, strict=True) if k is None)))
            found = list(map(self.known.get, flat))
        at = np.array(found, dtype=np.int64)
        n = self.start[at + 1] - self.start[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        gather = np.repeat(self.start[at] - ends[:-1], n) + np.arange(int(ends[-1]))
        cuts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        bad = np.concatenate(([0], np.cumsum(~self.good[at])))
        return self.ids[gather], ends[cuts], plain & (bad[cuts[1:]] == bad[cuts[:-1]])

    def decode(self, each: list) -> list[str]:
        return self.full.decode_batch(each, skip_special_tokens=False)


@cache
def codec(path: str) -> Codec:
    """The codec of a model file, its parity checked, once in each worker."""
    with open(path, "rb") as f:
        data = f.read()
    c = Codec(data)
    verify(c, data, PROBES)
    return c


def verify(c: Codec, data: bytes, texts: tuple[str, ...] | list[str]) -> None:
    """Raise if ids or decoded texts differ from those of the sentencepiece library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, off, same = c.encode(list(texts))
    for k, text in enumerate(texts):
        mine, theirs = ids[off[k] : off[k + 1]].tolist(), sp.encode(text)
        if mine != theirs:
            raise ValueError(f"ids differ from the sentencepiece library's on {text[:60]!r}: {mine[:20]} {theirs[:20]}")
        back = c.decode([mine])[0]
        if back != sp.decode(theirs) or bool(same[k]) != (back == text):
            raise ValueError(f"decoded text differs from the sentencepiece library's on {text[:60]!r}")


def _threads(n: int) -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))


def _encode(path: str, batch_bytes: int, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        c = codec(path)
        for batch in batches:
            for part in X.slices(batch, "text", batch_bytes):
                texts = part.column("text").to_pylist()
                ids, off, same = c.encode([x or "" for x in texts])
                null = np.array([x is None for x in texts])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(off).astype(np.int32), mask=null), pa.array(same, mask=null)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, batch_bytes: int = BATCH_BYTES, threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; round_trip says whether decoding the ids gives the text,
    which is found by decoding each distinct word once (a marker in the text itself decodes to a space).

    A null text has nulls, an empty one no ids, a long one those of the whole text; of segmentations of one score the
    library's stands. Null ids of documents stay null, repeated rows and texts under one id are each encoded, an empty
    table gives an empty one, and other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_encode(model, batch_bytes, threads), "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def _decode(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids").to_pylist()
                texts = c.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else y for x, y in zip(ids, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give a null text, no ids an empty one, and as many as there are a
    whole text. Repeated rows are each decoded, an empty table gives an empty one, other columns are not looked at."""
    encoded = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return encoded.mapInArrow(_decode(model, threads), "doc_id long, text string")
