"""Token counts of a byte-level BPE vocabulary: Arrow batches in, lengths only out.

Rows are regrouped into batches of about BATCH_BYTES of text. A text longer than that is cut before a space that
stands between an ASCII letter or digit and an ASCII letter: the pattern that splits a text into pre-tokens always
has a boundary there, so the pieces' counts add up to the whole text's. The ids of one batch are held by its worker while they
are counted; only the counts leave it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text falls into pre-tokens: contractions, words, numbers and other runs with one space before, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_BYTES = 256 << 10
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


@cache
def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a file of base64 tokens and ranks; kept for the life of a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = BATCH_BYTES) -> list[str]:
    """The text cut at safe boundaries into pieces of about ``size`` characters; whole where there is none."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _counts(path: str, pattern: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in X.slices(batch, "text", batch_bytes):
                texts, owner = [], []
                for k, t in enumerate(part.column("text").to_pylist()):
                    for piece in pieces(t or "", batch_bytes):
                        texts.append(piece)
                        owner.append(k)
                lengths = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
                n = np.bincount(np.array(owner, np.int64), np.array(lengths, np.float64), part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, mask=np.asarray(part.column("text").is_null()))], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of every row: null for a null text, 0 for an empty one, the whole count of a long one. Strings
    of special tokens in a text are ordinary text. Null ids stay null, repeated rows and texts under one id are each
    counted, an empty table gives an empty one, and other columns are not looked at."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_counts(vocabulary, pattern, batch_bytes), "doc_id long, n_tokens long")
