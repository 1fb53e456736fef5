"""Lexicons: entries by language from text files, mappings or code, canonicalised once and matched as a set."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions.canonical import Flags, canonicalize
from lexsieve.sources import folders
from lexsieve.sources.tables import inline

RAW = "lang string, line_no int, raw string"
CUSTOM = "custom"


class UnsupportedLanguage(ValueError):
    def __init__(self) -> None:
        super().__init__("This language is not supported")


class Lexicon:
    """Entries (lang, line_no, raw) and their canonical forms under some flags.

    ``languages`` are the loaded ones: sorted when all are, else in the order asked for. A lexicon never changes;
    its methods return others. Custom words are kept until another selection of languages is made.
    """

    def __init__(self, raw: DataFrame, languages: Iterable[str], flags: Flags = Flags(), available: Iterable[str] | None = None, custom: tuple[str, ...] = ()):  # noqa: B008
        self.raw, self.languages, self.flags = raw, list(languages), flags
        self.available = list(available if available is not None else self.languages)
        self.custom = custom

    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, languages: Iterable[str] | None = None, flags: Flags = Flags()) -> Lexicon:  # noqa: B008
        """One ``<language>.txt`` a language, one entry a line, nothing trimmed; a leading byte order mark is dropped."""
        files = spark.read.text(f"{path.rstrip('/')}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
        lang = F.regexp_extract("file", r"([^/]*)\.txt$", 1)
        lines = files.select(lang.alias("lang"), F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("line_no", "raw"))
        raw = lines.select("lang", "line_no", "raw").where(F.col("raw") != "")
        available = [r["lang"] for r in files.select(lang.alias("lang")).distinct().orderBy("lang").collect()]
        return cls(raw, available, flags).select(languages)

    @classmethod
    def from_mapping(cls, spark: SparkSession, contents: Mapping[str, str], flags: Flags = Flags()) -> Lexicon:  # noqa: B008
        """Language to the content of its list."""
        rows = inline(spark, list(contents.items()), "lang string, content string")
        raw = rows.select("lang", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "raw")).where(F.col("raw") != "")
        return cls(raw, sorted(contents), flags)

    def select(self, languages: Iterable[str] | None = None) -> Lexicon:
        """The lexicon narrowed to these languages; all if None, empty if none. Codes are lowercased and trimmed.

        Raises UnsupportedLanguage if any isn't available. Custom words are dropped.
        """
        if languages is None:
            return Lexicon(self.raw, sorted(self.available), self.flags, self.available)
        wanted = [c.strip().lower() for c in languages]
        if any(c not in self.available for c in wanted):
            raise UnsupportedLanguage
        wanted = [c for c in wanted if c.isalpha()]
        return Lexicon(self.raw.where(F.col("lang").isin(wanted)), wanted, self.flags, self.available)

    def with_words(self, words: Iterable[str]) -> Lexicon:
        """The lexicon and these words, under the language ``custom``."""
        return Lexicon(self.raw, self.languages, self.flags, self.available, (*self.custom, *words))

    def entries(self) -> DataFrame:
        """(lang, line_no, raw, canon) of every entry that isn't empty in canonical form."""
        raw = self.raw
        if self.custom:
            raw = raw.unionByName(inline(raw.sparkSession, [(CUSTOM, k, w) for k, w in enumerate(self.custom)], RAW))
        return raw.withColumn("canon", canonicalize(F.col("raw"), self.flags)).where(F.col("canon") != "")

    def keys(self) -> DataFrame:
        """The distinct canonical forms."""
        return self.entries().select("canon").distinct()

    def sizes(self) -> DataFrame:
        """(lang, entries, keys): lines and distinct canonical forms of each language."""
        return self.entries().groupBy("lang").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("canon").alias("keys"))

    def overlap(self) -> DataFrame:
        """(canon, langs): forms that several languages share."""
        shared = self.entries().groupBy("canon").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
        return shared.where(F.size("langs") > 1).select("canon", F.array_join("langs", ",").alias("langs"))

    def unreachable(self) -> DataFrame:
        """(lang, raw, canon): entries of several words, which no single word equals; only a similarity match finds them."""
        return self.entries().where(F.col("canon").contains(" ")).select("lang", "raw", "canon")

    def changed(self) -> DataFrame:
        """(lang, raw, canon): entries whose signs were dropped, such as lines written as patterns."""
        return self.entries().where(F.col("raw").rlike(r"[\\\[\](){}|*+?^$]")).select("lang", "raw", "canon")

    def packs(self) -> DataFrame:
        """(lang, words): each language's trimmed, non-blank lines in order, as a JSON array."""
        lines = self.raw.select("lang", "line_no", F.trim("raw").alias("raw")).where(F.col("raw") != "")
        ordered = lines.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("line_no", "raw"))).alias("lines"))
        return ordered.select("lang", F.to_json(F.col("lines.raw")).alias("words"))

    def write_packs(self, path: str, name: str = "word-lists", version: str = "1.0.0") -> None:
        """``packs/<language>.json``, a JSON array each, with ``index.json``, ``package.json`` and ``README.md`` beside them.

        The index lists languages in order with their file and number of words. What is at ``path`` is replaced.
        """
        spark, packs = self.raw.sparkSession, self.packs()
        files = [(r["lang"], r["words"]) for r in packs.orderBy("lang").toLocalIterator()]
        folders.delete(spark, path)
        index = []
        for lang, words in files:  # a lexicon is small, and each of its lists a file of its own
            folders.put(spark, f"{path}/packs/{lang}.json", words)
            index.append({"lang": lang, "file": f"packs/{lang}.json", "words": len(json.loads(words))})
        folders.put(spark, f"{path}/index.json", json.dumps(index, ensure_ascii=False))
        folders.put(spark, f"{path}/package.json", json.dumps({"name": name, "version": version, "files": ["index.json", "packs"], "languages": [x["lang"] for x in index]}, ensure_ascii=False))
        folders.put(spark, f"{path}/README.md", f"# {name}\n\n| language | words |\n|-|-|\n" + "".join(f"| {x['lang']} | {x['words']} |\n" for x in index))

    @classmethod
    def from_packs(cls, spark: SparkSession, path: str, languages: Iterable[str] | None = None, flags: Flags = Flags()) -> Lexicon:  # noqa: B008
        """The lists that ``write_packs`` wrote."""
        files = spark.read.text(f"{path.rstrip('/')}/packs/*.json", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"([^/]*)\.json$", 1).alias("lang"), "value")
        raw = files.select("lang", F.posexplode(F.from_json("value", "array<string>")).alias("line_no", "raw"))
        available = [r["lang"] for r in read_pack_index(spark, path).orderBy("lang").collect()]
        return cls(raw, available, flags).select(languages)


def read_pack_index(spark: SparkSession, path: str) -> DataFrame:
    """(lang, words, file) of the packs in a folder."""
    index = spark.read.text(f"{path.rstrip('/')}/index.json", wholetext=True)
    return index.select(F.inline(F.from_json("value", "array<struct<lang:string,words:bigint,file:string>>")))


def combined(lexicons: Iterable[Lexicon]) -> DataFrame:
    """The entries of several lexicons."""
    return reduce(DataFrame.unionByName, [x.entries() for x in lexicons])
