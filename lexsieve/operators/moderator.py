"""Detection and censoring of texts by a lexicon.

Verdicts and censored texts are computed within each row, so nothing is shuffled, exploded or numbered. The lexicon's
keys, if there are at most INLINE_KEYS, are a part of the expression itself. More keys, and matching by similarity,
are a set or a matcher broadcast to Python workers, which get the words' canonical forms and give back those that match;
each worker judges a word once as long as it remembers it. Workers split texts into words piece by piece, so what
they hold is bounded by the batch that Spark sends (64 MB) and those pieces. A lexicon whose keys don't fit
BROADCAST_BYTES is joined by shuffle with the distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexsieve.functions.canonical import JOINT, SPACE, Flags, any_of, canonical_words, with_canonical, words
from lexsieve.functions.similarity import Matcher, jaro_winkler_all, least_jaro
from lexsieve.sources.lexicon import Lexicon

INLINE_KEYS = 20_000
#: Characters of a key beyond which no regular expression is made of the keys.
LONG_KEY = 200
#: Bytes of keys that may be sent to every worker.
BROADCAST_BYTES = 32 << 20
#: Words that a worker remembers its verdict on, but for those of the pieces at hand.
REMEMBERED = 100_000
#: Characters of texts that a worker splits into words at once.
PIECE_CHARS = 1 << 18


def effective_threshold(threshold: float | None) -> float | None:
    """The threshold of similarity matching, or None for exact matching only: that is so outside (0, 1)."""
    return threshold if threshold is not None and 0 < threshold < 1 else None


class Moderator:
    """``lexicon``'s flags canonicalise texts as they did its entries. Null texts give null verdicts.

    Two extensions, off unless asked for: with ``phrases`` entries of several words match as many words in a row, each of
    which is a hit; with ``patterns`` lines with signs of regular expressions match a whole word in its normal form
    (composed, lower case, without signs) as the expressions they are. Both count in ``detect`` and what it decides, and
    in ``censor``. A line that isn't an expression raises ValueError.
    """

    def __init__(self, lexicon: Lexicon, phrases: bool = False, patterns: bool = False):
        self.lexicon, self.flags, self.phrases, self.patterns = lexicon, lexicon.flags, phrases, patterns
        self._extra: tuple[dict[int, list[str]], str] | None = None
        self._keys: list[str] | None = None
        self._many: list[str] | None = None

    @property
    def languages(self) -> list[str]:
        return list(self.lexicon.languages)

    def with_words(self, more: list[str]) -> Moderator:
        return Moderator(self.lexicon.with_words(more), self.phrases, self.patterns)

    def _inline(self) -> list[str] | None:
        """The keys, if they are few enough to stand in an expression."""
        if self._keys is None:
            self._keys = sorted(r["canon"] for r in self.lexicon.keys().limit(INLINE_KEYS + 1).collect())
        return self._keys if len(self._keys) <= INLINE_KEYS else None

    def _all(self) -> list[str] | None:
        """The keys, if they may be sent to the workers."""
        keys = self._inline()
        if keys is None and self._many is None:
            size = self.lexicon.keys().agg(F.sum(F.octet_length("canon") + 64)).first()[0] or 0
            self._many = sorted(r["canon"] for r in self.lexicon.keys().collect()) if size <= BROADCAST_BYTES else []
        return keys if keys is not None else self._many or None

    def _in_row(self, threshold: float | None) -> Callable[[Column], Column] | None:
        """Whether a canonical word is a key, as a condition on it; None if that takes more than an expression."""
        keys = self._inline()
        if effective_threshold(threshold) is not None or keys is None:
            return None
        return lambda w: w.isin(keys) if keys else F.lit(False)

    def _holds_key(self, joined: str) -> Column:
        """Whether any of a text's canonical forms, joined, is a key: one pass of a regular expression where keys are of a
        usual length, else a look at each form. Null for a null text."""
        keys = self._inline() or []
        if max(map(len, keys), default=0) <= LONG_KEY:
            return F.col(joined).rlike(any_of(keys))
        return F.exists(F.split(joined, JOINT), lambda w: w.isin(keys))

    def _with_hits(self, df: DataFrame, text: str, threshold: float | None) -> DataFrame:
        """``df`` with ``__hits``: the distinct canonical words of the text that match, where no in-set will do."""
        fuzzy = effective_threshold(threshold)
        keys = self._all()
        if keys is not None:
            out = with_canonical(df, text, "__forms", self.flags)
            return out.withColumn("__hits", _matching(df, keys, fuzzy)("__forms")).drop("__forms")
        # a word matches or doesn't, whatever text it stands in: rows meet their words by the text's hash, and it does no
        # harm that two texts may share one
        each = df.select(F.xxhash64(text).alias("__text"), F.explode(F.array_distinct(canonical_words(F.col(text), self.flags))).alias("canon")).where("canon != ''")
        found = each.distinct().join(self._matched_words(each.select("canon").distinct(), fuzzy), "canon").groupBy("__text").agg(F.collect_list("canon").alias("__hits"))
        return df.withColumn("__of", F.xxhash64(text)).join(found, F.col("__of") == F.col("__text"), "left").drop("__of", "__text")

    def _matched_words(self, distinct: DataFrame, threshold: float | None) -> DataFrame:
        """Words that equal a key, or are more similar to one than the threshold."""
        exact = distinct.join(self.lexicon.keys(), "canon", "left_semi")
        if threshold is None:
            return exact
        rest = distinct.join(exact, "canon", "left_anti")
        return exact.unionByName(self.similar_words(rest, threshold).select("canon")).distinct()

    def similar_words(self, canon: DataFrame, threshold: float) -> DataFrame:
        """(canon, key, score) of each word and every key more similar than the threshold; null words have none.

        Keys that fit BROADCAST_BYTES go to the workers: no join, no shuffle. More are joined on the lengths that allow
        the threshold.
        """
        keys = self._all()
        if keys is not None:
            matcher = canon.sparkSession.sparkContext.broadcast(Matcher(keys, threshold))

            def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    said = [w for w in batch.column("canon").to_pylist() if w is not None]
                    w, k, score = matcher.value.pairs(said)
                    yield pa.RecordBatch.from_arrays([pa.array([said[i] for i in w], pa.string()), pa.array([keys[i] for i in k], pa.string()), pa.array(score)], names=["canon", "key", "score"])

            return canon.select("canon").mapInArrow(compared, "canon string, key string, score double")
        key = self.lexicon.keys().select(F.col("canon").alias("key"))
        low = 3 * least_jaro(threshold) - 2
        if low > 0:
            n = F.char_length("key")
            near = key.select("key", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(n * low).cast("int")), F.ceil(n / low).cast("int"))).alias("len"))
            pairs = canon.select("canon", F.char_length("canon").alias("len")).join(near, "len").select("canon", "key")
        else:
            pairs = canon.select("canon").crossJoin(key)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = jaro_winkler_all(batch.column("canon").to_pylist(), batch.column("key").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["canon", "key", "score"]).filter(pa.array(score > threshold))

        return pairs.where("canon is not null").mapInArrow(scored, "canon string, key string, score double")

    def _extensions(self) -> tuple[dict[int, list[str]], str]:
        """(phrases by their number of words, one expression of all patterns); both empty unless asked for."""
        if self._extra is None:
            by_size: dict[int, list[str]] = {}
            for r in self.lexicon.unreachable().select("canon").distinct().collect() if self.phrases else []:
                by_size.setdefault(r["canon"].count(" ") + 1, []).append(r["canon"])
            lines = sorted({r["raw"] for r in self.lexicon.changed().collect()}) if self.patterns else []
            pattern = self.lexicon.raw.sparkSession._jvm.java.util.regex.Pattern
            for line in lines:
                try:
                    pattern.compile(line)
                except IllegalArgumentException as e:
                    raise ValueError(f"not a regular expression: {line}") from e
            self._extra = by_size, "|".join(f"(?:{x})" for x in lines)
        return self._extra

    def _flagged(self, df: DataFrame, text: str, threshold: float | None) -> DataFrame:
        """``df`` with ``__flags``: of each word whether it is a hit, by a key, a phrase or a pattern."""
        by_size, pattern = self._extensions()
        is_key = self._in_row(threshold)
        out = with_canonical(df if is_key is not None else self._with_hits(df, text, threshold), text, "__joined_canon", self.flags)
        out = out.withColumn("__words", F.split("__joined_canon", JOINT))
        hit = is_key if is_key is not None else lambda w: F.coalesce(F.array_contains("__hits", w), F.lit(False))
        out = out.withColumn("__flags", F.transform("__words", hit))
        either = lambda a, b: a | b
        for size, keys in sorted(by_size.items()):
            begins = F.transform("__words", lambda w, i: F.array_join(F.slice("__words", i + 1, size), " ").isin(keys))  # noqa: B023
            out = out.withColumn("__begins", begins)
            inside = F.transform("__begins", lambda x, i: F.exists(F.slice("__begins", F.greatest(i - size + 2, F.lit(1)), F.least(i + 1, F.lit(size))), lambda y: y))  # noqa: B023
            out = out.withColumn("__flags", F.zip_with("__flags", inside, either))
        if pattern:
            normal = Flags(transliterate=False, lookalikes=False)
            out = with_canonical(out, text, "__normal", normal)
            out = out.withColumn("__flags", F.zip_with("__flags", F.transform(F.split("__normal", JOINT), lambda w: w.rlike(rf"\A(?:{pattern})\z") & (w != "")), either))
        return out.drop("__words", "__joined_canon", "__normal", "__begins", "__hits")

    def detect(self, df: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
        """``df`` with ``found``: whether any word matches."""
        if self.phrases or self.patterns:
            return self._flagged(df, text, threshold).withColumn("found", F.when(F.col(text).isNotNull(), F.exists("__flags", lambda x: x))).drop("__flags")
        if self._in_row(threshold) is not None:
            return with_canonical(df, text, "__canon", self.flags).withColumn("found", self._holds_key("__canon")).drop("__canon")
        out = self._with_hits(df, text, threshold)
        return out.withColumn("found", F.when(F.col(text).isNotNull(), F.coalesce(F.size("__hits") > 0, F.lit(False)))).drop("__hits")

    def censor(self, df: DataFrame, mask: str = "*", text: str = "text", threshold: float | None = None) -> DataFrame:
        """``df`` with ``found`` and ``censored``: each matching word, signs attached to it included, masked by as many
        of the first character of ``mask``; white space stays as it is, and a clean text is itself."""
        if not mask:
            raise ValueError("the mask is empty")
        hide = lambda w, hit: F.when(hit, F.repeat(F.lit(mask[0]), F.char_length(w))).otherwise(w)
        if self.phrases or self.patterns:
            out = self._flagged(df, text, threshold)
            found, masked = F.exists("__flags", lambda x: x), F.zip_with(words(F.col(text)), "__flags", hide)
        else:
            is_key = self._in_row(threshold)
            out = with_canonical(df if is_key is not None else self._with_hits(df, text, threshold), text, "__joined_canon", self.flags)
            found = self._holds_key("__joined_canon") if is_key is not None else F.coalesce(F.size("__hits") > 0, F.lit(False))
            is_hit = is_key if is_key is not None else lambda c: F.array_contains("__hits", c)
            # zipped, not looked up by index: the optimizer would move a looked-up array's expression into the lambda
            masked = F.zip_with(words(F.col(text)), F.split("__joined_canon", JOINT), lambda w, c: hide(w, is_hit(c)))
        out = out.withColumn("found", F.when(F.col(text).isNotNull(), found))
        lead = F.regexp_extract(text, f"^{SPACE}*", 0)
        after = F.regexp_extract_all(F.regexp_replace(text, f"^{SPACE}+", ""), F.lit(f"{SPACE}+"), F.lit(0))
        whole = F.concat(lead, F.array_join(F.zip_with(masked, after, lambda w, s: F.concat(w, F.coalesce(s, F.lit("")))), ""))
        return out.withColumn("censored", F.when(F.col("found"), whole).otherwise(F.col(text))).drop("__joined_canon", "__hits", "__flags")

    def status(self, df: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
        """``df`` with ``status``: BLOCKED or OK."""
        return self.detect(df, text, threshold).withColumn("status", F.when(F.col("found"), "BLOCKED").when(~F.col("found"), "OK")).drop("found")

    def clean(self, df: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
        """The rows without a matching word."""
        return self.detect(df, text, threshold).where(~F.col("found")).drop("found")

    def _holding(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``__canon``, without the rows that surely hold no key."""
        out = with_canonical(df, text, "__canon", self.flags)
        return out.where(self._holds_key("__canon")) if self._in_row(None) is not None else out

    def hits(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, pos, token, canon, lang, raw): every matching word with each entry it matches.

        Only words that are a key leave their row, where the keys fit an expression.
        """
        entries = self.lexicon.entries().select("canon", "lang", "raw")
        is_key = self._in_row(None)
        df = self._holding(df.select(key, text), text)
        said = F.zip_with(words(F.col(text)), F.split("__canon", JOINT), lambda w, c: F.struct(w.alias("token"), c.alias("canon")))
        placed = F.transform(said, lambda w, i: F.struct(i.alias("pos"), w["token"].alias("token"), w["canon"].alias("canon")))
        each = df.select(key, F.explode(F.filter(placed, lambda w: is_key(w["canon"]) if is_key is not None else w["canon"] != "")).alias("w")).select(key, "w.pos", "w.token", "w.canon")
        return each.join(F.broadcast(entries) if is_key is not None else entries, "canon").select(key, "pos", "token", "canon", "lang", "raw")

    def top_hits(self, df: DataFrame, text: str = "text", n: int = 20) -> DataFrame:
        """(canon, hits): the most frequent matching words, ties by word."""
        is_key = self._in_row(None)
        canon = F.split("__canon", JOINT)
        each = self._holding(df.select(text), text).select(F.explode(F.filter(canon, is_key) if is_key is not None else canon).alias("canon")).where(F.col("canon") != "")
        found = each if is_key is not None else each.join(self.lexicon.keys(), "canon", "left_semi")
        return found.groupBy("canon").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "canon").limit(n)


def _matching(df: DataFrame, keys: list[str], threshold: float | None) -> Callable[[Column], Column]:
    """Takes canonical words joined by JOINT, gives the distinct ones that equal a key or are more similar to one."""
    shared = df.sparkSession.sparkContext.broadcast((frozenset(keys), None if threshold is None else Matcher(keys, threshold)))

    @F.arrow_udf("array<string>")
    def matching(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, matcher = shared.value
        verdict: dict[str, bool] = {"": False}
        for texts in batches:
            hits: list[dict[str, None] | None] = [None] * len(texts)
            for group in _pieces(texts):
                said = [(row, dict.fromkeys(piece.split(JOINT))) for row, piece in group]
                if len(verdict) > REMEMBERED:
                    verdict = {"": False}
                new = [w for w in dict.fromkeys(w for _, ws in said for w in ws) if w not in verdict]
                verdict.update((w, w in known) for w in new)
                if matcher is not None:
                    rest = [w for w in new if not verdict[w]]
                    for i in np.unique(matcher.pairs(rest)[0]):
                        verdict[rest[i]] = True
                for row, ws in said:
                    hits[row] = (hits[row] or {}) | {w: None for w in ws if verdict[w]}
            yield pa.array([None if ws is None else list(ws) for ws in hits], pa.list_(pa.string()))

    return matching


def _pieces(texts: pa.Array, chars: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """(row, part of its text) in groups of about ``chars`` characters, PIECE_CHARS unless given; a longer text is cut
    between words, so no more than a group stands as Python words at a time. Null texts have no part."""
    chars = chars or PIECE_CHARS
    group, left = [], chars
    for row, scalar in enumerate(texts):
        text = scalar.as_py()
        at = 0
        while text is not None:
            end = text.find(JOINT, at + left) if len(text) - at > left else -1
            group.append((row, text[at:] if end < 0 else text[at:end]))
            left -= len(group[-1][1])
            if left <= 0:
                yield group
                group, left = [], chars
            if end < 0:
                break
            at = end + 1
    if group:
        yield group


#: Characters with the Unicode property White_Space; Python's own class has more.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(f"[^{_SPACES}]+")


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [m.start() for m in _TOKEN.finditer(t)])


def word_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, token, start, len): a text's words with offsets in code points, in one pass over each text."""
    zipped = F.arrays_zip(words(F.col(text)).alias("token"), _starts(text).alias("start"))
    return df.select(key, F.posexplode(zipped).alias("pos", "s")).select(key, "pos", "s.token", "s.start", F.char_length("s.token").alias("len"))


__all__ = ["Flags", "Moderator", "effective_threshold", "word_spans"]
