"""Canonical forms as Column expressions. NFKC is ICU's, which is a part of Spark, and sees only texts that it may change."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexsieve.functions import chars
from lexsieve.functions.chars import BUILT_IN, Tables

#: The characters of the Unicode property White_Space. Those of one byte are spelt out one by one, which makes a class
#: look them up in a table, and the others stand behind a range that most text fails at once.
SPACES = r"\t\n\x0B\f\r \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
SPACE = f"[{SPACES}]"
WORD = r"\P{IsWhite_Space}+"
PIECE = rf"{WORD}|{SPACE}+"
#: Joins the words of a text while they are canonicalised together; no step makes or removes it.
JOINT = "\n"


#: Characters that NFKC may change.
_CHANGING = rf"[\x{{80}}-\x{{10FFFF}}&&[^{chars.INERT}]]"


@dataclass(frozen=True)
class Flags:
    """Steps of canonicalisation. leet, fold_diacritics and lookalikes_first are extensions: off unless asked for."""

    normalize: bool = True
    aggressive: bool = True
    transliterate: bool = True
    lookalikes: bool = True
    leet: bool = False
    fold_diacritics: bool = False
    lookalikes_first: bool = False
    #: Character tables, ours unless others are given.
    tables: Tables = field(default=BUILT_IN, compare=False)

    @property
    def keeps_underscore(self) -> bool:
        return self.normalize and not self.aggressive


def _nfkc(text: Column) -> Column:
    """NFKC of a text, which is empty for null."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def inert(text: Column) -> Column:
    """Whether NFKC surely leaves the text as it is: all its characters are of scripts that have nothing to compose."""
    return ~text.rlike(_CHANGING)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition."""
    return F.when(~inert(text), _nfkc(text)).otherwise(text)


def strip_diacritics(text: Column) -> Column:
    """Letters without combining marks (an extension)."""
    return F.coalesce(_without_marks(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _translate(text: Column, table: dict[str, str]) -> Column:
    whole = sorted(table, key=lambda c: table[c] == "")
    return F.translate(text, "".join(whole), "".join(table[c] for c in whole))


def fold_decorated(text: Column, tables: Tables = BUILT_IN) -> Column:
    return _translate(text, tables.decorated)


def strip_signs(text: Column, keep_underscore: bool = False) -> Column:
    """Only letters, digits, white space and, if asked, underscores."""
    ascii_signs = "".join(f"\\x{c:02X}" for c in range(128) if not (chr(c).isalnum() or chr(c) in "\t\n\x0b\x0c\r " or keep_underscore and chr(c) == "_"))
    return F.regexp_replace(text, rf"[{ascii_signs}[\x{{80}}-\x{{10FFFF}}&&[^\p{{IsAlphabetic}}\p{{N}}\p{{IsWhite_Space}}]]]", "")


def collapse_spaces(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _folded(text: Column, keep_underscore: bool, tables: Tables, collapse: Callable[[Column, bool], Column]) -> Column:
    """NFKC, lower case, decoration folded, signs dropped, spaces collapsed (which is told whether NFKC made the text). An
    inert text has nothing to compose, and nothing to fold either unless a given table says so."""
    composed = F.when(~inert(text), _nfkc(text))
    slow = strip_signs(fold_decorated(F.lower(composed), tables), keep_underscore)
    lower = F.lower(text)
    fast = strip_signs(lower if tables.proven else fold_decorated(lower, tables), keep_underscore)
    return F.coalesce(collapse(slow, True), collapse(fast, False))


def normalize_text(text: Column, keep_underscore: bool = False, tables: Tables = BUILT_IN) -> Column:
    """NFKC, lower case, decoration folded, signs dropped, spaces collapsed."""
    return _folded(text, keep_underscore, tables, lambda t, _: collapse_spaces(t))


def contains_cyrillic(text: Column) -> Column:
    return text.rlike("[Ѐ-ӿ]")


def to_latin(text: Column, tables: Tables = BUILT_IN) -> Column:
    """Cyrillic letters as Latin ones; hard and soft sign vanish."""
    out = text
    for c, latin in tables.to_latin.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(c), F.lit(latin))
    return _translate(out, {c: latin for c, latin in tables.to_latin.items() if len(latin) < 2})


def to_cyrillic(text: Column, tables: Tables = BUILT_IN) -> Column:
    """Latin letters as Cyrillic ones, the longest sequence first."""
    if tables.proven:
        for latin, c in chars.SEQUENCES:
            text = F.replace(text, F.lit(latin), F.lit(c))
        return _translate(text, chars.TO_CYRILLIC)
    table = tables.to_cyrillic
    longest = sorted((x for x in table if len(x) > 1), key=lambda x: -len(x))
    if not longest:
        return _translate(text, table)
    # a greedy scan from the left: at each place the longest sequence that stands there
    images = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    scan = F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*("".join(f"\\x{{{ord(c):x}}}" for c in x) for x in longest), "."])), F.lit(0))
    return F.array_join(F.transform(scan, lambda x: F.coalesce(F.try_element_at(images, x), x)), "")


def fold_lookalikes(text: Column, tables: Tables = BUILT_IN) -> Column:
    return _translate(text, tables.lookalikes)


def fold_leet(text: Column) -> Column:
    """Digits and signs written for letters, in a word that has a letter (an extension)."""
    return F.when(text.rlike(r"\p{IsAlphabetic}"), _translate(text, chars.LEET)).otherwise(text)


def any_of(keys: Iterable[str]) -> str:
    """A regular expression that finds any of the keys as a whole among forms joined by JOINT: a trie of their letters,
    so that a word is given up at the first letter that no key goes on with."""
    root: dict = {}
    for key in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        ends = [] if "" not in node else [rf"(?:{JOINT}|\z)"]
        parts = [f"\\x{{{ord(c):x}}}{spell(rest)}" for c, rest in sorted(node.items()) if c]
        both = ends + parts
        return both[0] if len(both) == 1 else f"(?:{'|'.join(both)})"

    return rf"(?:\A|{JOINT}){spell(root)}" if root else r"(?!)"


def _steps(text: Column, flags: Flags, collapse: Callable[[Column, bool], Column]) -> Column:
    tables = flags.tables
    if flags.leet:
        text = F.array_join(F.transform(F.split(text, JOINT), fold_leet), JOINT)
    if flags.normalize or flags.aggressive:
        text = _folded(text, flags.keeps_underscore, tables, collapse)
    if flags.fold_diacritics:
        text = strip_diacritics(text)
    if flags.lookalikes and flags.lookalikes_first:
        text = fold_lookalikes(text, tables)
    if flags.transliterate:
        # letters that aren't Cyrillic stay as they are, so the test for Cyrillic changes nothing
        text = to_cyrillic(to_latin(text, tables), tables)
    if flags.lookalikes and not flags.lookalikes_first:
        text = fold_lookalikes(text, tables)
    return text


def canonicalize(text: Column, flags: Flags = Flags()) -> Column:  # noqa: B008
    """The canonical form of one word or entry."""
    return _steps(text, flags, lambda t, _: collapse_spaces(t))


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def canonical_joined(text: Column, flags: Flags = Flags(), joined: bool = False) -> Column:  # noqa: B008
    """The canonical forms of a text's words in one string, joined by JOINT.

    One expression for the whole text, without exploding it, an array of its words, or a function call for each: the
    spaces between words become a character that every step leaves alone.
    """

    def collapse(t: Column, composed: bool) -> Column:
        # spaces inside a word can only come from NFKC
        return F.trim(F.regexp_replace(F.regexp_replace(t, rf"[{SPACES}&&[^\n]]+", " "), r" *\n *", JOINT)) if composed else t

    return _steps(text if joined else _joined(text), flags, collapse)


def _joined(text: Column) -> Column:
    """The text with one JOINT for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", JOINT), F.lit(JOINT))


def with_canonical(df: DataFrame, text: str, name: str, flags: Flags = Flags()) -> DataFrame:  # noqa: B008
    """``df`` with ``canonical_joined`` of a column. Each step that the next ones use several times is a projection of its
    own, which the optimizer doesn't merge, so it is computed once."""
    df = df.withColumn("__joined", _joined(F.col(text)))
    return df.withColumn(name, canonical_joined(F.col("__joined"), flags, joined=True)).drop("__joined")


def canonical_words(text: Column, flags: Flags = Flags()) -> Column:  # noqa: B008
    """Canonical forms of a text's words, in step with ``words``; a word of signs only has the empty form, and a text
    without words that form alone."""
    return F.split(canonical_joined(text, flags), JOINT)


def register(spark: SparkSession, flags: Flags = Flags(), name: str = "canonicalize") -> None:  # noqa: B008
    """Make ``canonicalize(text)`` available to SQL, as an expression that is inlined into the query."""
    plan = spark.createDataFrame([], "t string").select(canonicalize(F.col("t"), flags).alias("c"))._jdf.queryExecution().analyzed()
    quoted = _CHANGING.replace("\\", "\\\\")
    body = plan.expressions().head().child().sql().replace(f"RLIKE(t, {_CHANGING})", f"rlike(t, '{quoted}')")
    spark.sql(f"create or replace temporary function {name}(t string) returns string return {body}")
