"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions import canonical as C
from lexsieve.functions import chars
from lexsieve.functions.canonical import Flags
from lexsieve.functions.similarity import jaro_winkler
from lexsieve.operators.moderator import Moderator, word_spans
from lexsieve.plans import prepare as P
from lexsieve.plans import score as S
from lexsieve.sources.lexicon import Lexicon, read_pack_index
from lexsieve.sources import folders
from lexsieve.sources.tables import PRESETS, Source
from lexsieve.streaming.moderate import moderated

#: A small lexicon of our own. Lists proper come from a folder; see Lexicon.from_dir.
LEXICON = {
    "de": "trottel\nachlich\nidiot\nmist",
    "en": "idiot\nmoron\nscum\ntrash\nloser\nclown\nstupid\nworthless\npathetic\ndisgusting\nshat\nedan\nbad word\nf[o]+l",
    "fr": "con\nenchier\nchier\nimbécile\nidiot",
    "po": "cu\nburro\nidiota",
    "sp": "su\ntonto\nbasura\nidiota",
}
PLAIN = Flags(transliterate=False, lookalikes=False)
FULL = Flags()
LITERALS = ["привет", "щука", "schuka", "hello", "мир и труд", "объезд", "яблоко ёж", "b4d", "", "tsch yaya"]
SIMILAR = [("martha", "marhta"), ("hello", "hellp"), ("cheeseburger", "cheese fries"), ("blorbish", "blorbishes"), ("abc", "xyz"), ("exactt", "exact"), ("same", "same"), ("dixon", "dicksonx")]
#: Ways to hide a word, and whether the default flags see through them.
EVASIONS = [("🅼🅾🆁🅾🅽", True), ("ｍｏｒｏｎ", True), ("m.o.r.o.n", True), ("MORON!!", True), ("mоrоn", True), ("m​oron", True), ("m0r0n", False), ("m o r o n", False), ("moronic", False), ("", False)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lexicon(spark: SparkSession, flags: Flags = PLAIN) -> Lexicon:
    return Lexicon.from_mapping(spark, LEXICON, flags)


# --- SQL of the same expressions -------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ENTRIES = "(values " + ", ".join(f"({_quoted(lang)}, {k}, {_quoted(w)})" for lang, text in LEXICON.items() for k, w in enumerate(text.split("\n"))) + ") as l(lang, line_no, raw)"


def _normal(x: str, keep: str = "") -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s{keep}]', '', 'g'), '\\s+', ' ', 'g'))"


def _sql_map(table: dict[str, str], x: str) -> str:
    return f"list_reduce(list_prepend('', list_transform(regexp_extract_all({x}, '(sch|ts|zh|ch|sh|yu|ya|[\\s\\S])', 1), lambda c: coalesce(map_extract(map([{', '.join(map(_quoted, table))}], [{', '.join(map(_quoted, table.values()))}]), c)[1], c))), lambda a, b: a || b)"


def _latin(x: str) -> str:
    for c, v in chars.TO_LATIN.items():
        x = f"replace({x}, {_quoted(c)}, {_quoted(v)})"
    return x


def _cyrillic(x: str) -> str:
    return _sql_map(dict(chars.SEQUENCES) | chars.TO_CYRILLIC, x)


def _alike(x: str) -> str:
    return f"translate({x}, {_quoted(''.join(chars.LOOKALIKES))}, {_quoted(''.join(chars.LOOKALIKES.values()))})"


def _full(x: str) -> str:
    return _alike(_cyrillic(_latin(_normal(x))))


def _keys(canon: Callable[[str], str], where: str = "true") -> str:
    return f"(select distinct {canon('raw')} as canon from {_ENTRIES} where {where} and {canon('raw')} <> '')"


def _tokens(table: str, key: str) -> str:
    return f"(select {key}, unnest(regexp_extract_all(text, '\\S+')) as token from {table})"


def _found(table: str, key: str, canon: Callable[[str], str], where: str = "true") -> str:
    return f"(select distinct {key} from {_tokens(table, key)} where {canon('token')} in (select canon from {_keys(canon, where)}))"


# --- words and canonical forms ---------------------------------------------------------------------------------


@query(
    "with p as (select item_id, unnest(regexp_extract_all(text, '\\S+|\\s+')) as piece, generate_subscripts(regexp_extract_all(text, '\\S+|\\s+'), 1) as i from benchmark),"
    " q as (select *, coalesce(sum(length(piece)) over (partition by item_id order by i rows between unbounded preceding and 1 preceding), 0) as start from p)"
    " select item_id, cast(row_number() over (partition by item_id order by i) - 1 as int) as pos, piece as token, cast(start as int) as start, cast(length(piece) as int) as len from q where regexp_matches(piece, '\\S')"
)
def tokenize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_spans(_table(spark, sf_dir, "benchmark"), "item_id")


@query(f"select doc_id, {_normal('text')} as canon from documents")
def normalize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", C.normalize_text(F.col("text")).alias("canon"))


@query(f"select page_id, {_normal('url', '_')} as canon from pages")
def normalize_underscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", C.normalize_text(F.col("url"), keep_underscore=True).alias("canon"))


def _literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(LITERALS)], "id int, text string")


_SQL_LITERALS = "(values " + ", ".join(f"({k}, {_quoted(t)})" for k, t in enumerate(LITERALS)) + ") as t(id, text)"


@query(f"select id, regexp_matches(text, '[Ѐ-ӿ]') as cyrillic from {_SQL_LITERALS}")
def contains_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark).select("id", C.contains_cyrillic(F.col("text")).alias("cyrillic"))


@query(f"select id, {_latin('text')} as latin from {_SQL_LITERALS}")
def translit_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark).select("id", C.to_latin(F.col("text")).alias("latin"))


@query(f"select conv_id, turn, {_cyrillic('text')} as cyrillic from conversations")
def translit_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", C.to_cyrillic(F.col("text")).alias("cyrillic"))


@query(f"select id, {_alike('text')} as folded from {_SQL_LITERALS}")
def homoglyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark).select("id", C.fold_lookalikes(F.col("text")).alias("folded"))


@query(f"select conv_id, turn, {_full('text')} as canon from conversations")
def canonical_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", C.canonicalize(F.col("text"), FULL).alias("canon"))


@query("select * from (values " + ", ".join(f"({k}, {str(hit).lower()})" for k, (_, hit) in enumerate(EVASIONS)) + ") as t(id, found)")
def evasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(EVASIONS)], "id int, text string")
    return Moderator(lexicon(spark, FULL)).detect(texts).select("id", "found")


# --- lexicons --------------------------------------------------------------------------------------------------


@query(f"select distinct lang from {_ENTRIES}")
def lexicon_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lexicon(spark).languages], "lang string")


@query(f"select lang, count(*) as entries, count(distinct {_normal('raw')}) as keys from {_ENTRIES} group by lang")
def lexicon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark).sizes()


@query(f"select canon, string_agg(lang, ',' order by lang) as langs from (select distinct lang, {_normal('raw')} as canon from {_ENTRIES}) group by canon having count(*) > 1")
def lexicon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark).overlap()


@query(f"select lang, raw, {_normal('raw')} as canon from {_ENTRIES} where {_normal('raw')} like '% %'")
def lexicon_dead_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark).unreachable()


@query(f"select lang, raw, {_normal('raw')} as canon from {_ENTRIES} where regexp_matches(raw, '[\\[\\](){{}}|*+?^$]')")
def lexicon_pattern_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark).changed()


@query("select * from (values " + ", ".join(f"({_quoted(lang)}, {_quoted(json.dumps(text.split(chr(10)), ensure_ascii=False, separators=(',', ':')))})" for lang, text in LEXICON.items()) + ") as t(lang, words)")
def lexicon_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark).packs()


@query(f"select lang, {_normal('raw')} as canon from {_ENTRIES} where lang in ('en', 'fr')")
def lexicon_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of two lists of a folder of text files, with byte order marks and both kinds of line ends."""
    path = f"{folders.app_dir(spark)}/lists"
    for lang, text in LEXICON.items():
        folders.put(spark, f"{path}/{lang}.txt", "\ufeff" + text.replace("\n", "\r\n" if lang == "fr" else "\n") + "\n\n")
    return Lexicon.from_dir(spark, path, [" EN ", "fr"], PLAIN).entries().select("lang", "canon")


@query(f"select lang, count(*) as words, 'packs/' || lang || '.json' as file from {_ENTRIES} group by lang")
def lexicon_pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of packs, with as many words in each file as it says."""
    path = f"{folders.app_dir(spark)}/packs"
    lexicon(spark).write_packs(path)
    index = read_pack_index(spark, path)
    there = Lexicon.from_packs(spark, path, flags=PLAIN).raw.groupBy("lang").agg(F.count(F.lit(1)).alias("words"))
    return index.join(there, ["lang", "words"]).select("lang", "words", "file")


# --- detection -------------------------------------------------------------------------------------------------


@query(f"select doc_id, doc_id in (select doc_id from {_found('documents', 'doc_id', _normal)}) as found from documents")
def detect_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).detect(_table(spark, sf_dir, "documents")).select("doc_id", "found")


@query(f"with d as (select *, row_number() over () as k from conversations) select conv_id, turn, k in (select k from {_found('d', 'k', _full)}) as found from d")
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark, FULL)).detect(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "found")


@query(f"select lang, count(distinct doc_id) as documents from (select doc_id, {_normal('token')} as canon from {_tokens('documents', 'doc_id')}) join (select distinct lang, {_normal('raw')} as canon from {_ENTRIES}) using (canon) group by lang")
def detect_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = Moderator(lexicon(spark)).hits(_table(spark, sf_dir, "documents"), "doc_id")
    return hits.groupBy("lang").agg(F.countDistinct("doc_id").alias("documents"))


_SUBSET = "lang in ('fr', 'de')"


@query(f"select doc_id from {_found('documents', 'doc_id', _normal, _SUBSET)}")
def detect_language_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark).select(["fr", "de"])).detect(_table(spark, sf_dir, "documents")).where("found").select("doc_id")


@query(f"select doc_id from documents where doc_id not in (select doc_id from {_found('documents', 'doc_id', _normal)})")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).clean(_table(spark, sf_dir, "documents")).select("doc_id")


_CUSTOM = ["Thonsh!", "eren"]


@query(f"with d as (select *, row_number() over () as k from conversations) select conv_id, turn from d where k in (select k from {_tokens('d', 'k')} where {_normal('token')} in (select canon from {_keys(_normal)} union all values ('thonsh'), ('eren')))")
def custom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).with_words(_CUSTOM).detect(_table(spark, sf_dir, "conversations")).where("found").select("conv_id", "turn")


@query(f"with d as (select *, row_number() over () as k from conversations) select conv_id, turn, case when k in (select k from {_found('d', 'k', _normal)}) then 'BLOCKED' else 'OK' end as status from d")
def moderation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).status(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "status")


@query(
    f"with k as (select list(canon) as keys from {_keys(_normal)}) select doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\S+|\\s+'), lambda p: case when list_contains(keys, {_normal('p')}) then repeat('*', length(p)) else p end), '') as censored from documents, k"
)
def censor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).censor(_table(spark, sf_dir, "documents")).select("doc_id", "censored")


@query(
    f"with t as (select doc_id, unnest(regexp_extract_all(text, '\\S+')) as token, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 as pos from documents)"
    f" select doc_id, cast(pos as int) as pos, token, e.canon, lang, raw from t join (select lang, raw, {_normal('raw')} as canon from {_ENTRIES}) e on {_normal('token')} = e.canon"
)
def attributed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).hits(_table(spark, sf_dir, "documents"), "doc_id")


@query(f"select canon, count(*) as hits from (select {_normal('token')} as canon from {_tokens('documents', 'doc_id')}) where canon in (select canon from {_keys(_normal)}) group by canon order by hits desc, canon limit 10")
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Moderator(lexicon(spark)).top_hits(_table(spark, sf_dir, "documents"), n=10)


# --- similarity ------------------------------------------------------------------------------------------------


@query("select a, b, round(jaro_winkler_similarity(a, b), 9) as score from (values " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in SIMILAR) + ") as t(a, b)")
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(SIMILAR, "a string, b string").select("a", "b", F.round(jaro_winkler(F.col("a"), F.col("b")), 9).alias("score"))


#: DuckDB's function compares bytes: letters beyond ASCII become capitals and signs, which no canonical form has.
_LETTERS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^{|}~"


def _bytes(x: str) -> str:
    return f"translate({x}, '{_LETTERS}', '{_BYTES}')"


def _sql_fuzzy(table: str, key: str, t: float) -> str:
    similar = f"select w.canon from (select distinct {_normal('token')} as canon from {_tokens(table, key)}) w, {_keys(_normal)} k where w.canon <> '' and (w.canon = k.canon or jaro_winkler_similarity({_bytes('w.canon')}, {_bytes('k.canon')}) > {t})"
    return f"select distinct {key} from {_tokens(table, key)} where {_normal('token')} in ({similar})"


def _fuzzy(spark: SparkSession, sf_dir: str, table: str, key: str, t: float) -> DataFrame:
    return Moderator(lexicon(spark)).detect(_table(spark, sf_dir, table), threshold=t).where("found").select(key)


@query(_sql_fuzzy("benchmark", "item_id", 0.95))
def detect_fuzzy_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir, "benchmark", "item_id", 0.95)


@query(_sql_fuzzy("benchmark", "item_id", 0.90))
def detect_fuzzy_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir, "benchmark", "item_id", 0.90)


@query(_sql_fuzzy("documents", "doc_id", 0.95))
def detect_fuzzy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir, "documents", "doc_id", 0.95)


@query(
    f"select canon, key, round(jaro_winkler_similarity({_bytes('canon')}, {_bytes('key')}), 9) as score from (select distinct {_normal('token')} as canon from {_tokens('documents', 'doc_id')}) w, (select canon as key from {_keys(_normal)}) k"
    f" where canon <> '' and jaro_winkler_similarity({_bytes('canon')}, {_bytes('key')}) > 0.9"
)
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Moderator(lexicon(spark))
    words = _table(spark, sf_dir, "documents").select(F.explode(C.canonical_words(F.col("text"), PLAIN)).alias("canon")).where("canon != ''").distinct()
    return m.similar_words(words, 0.9).select("canon", "key", F.round("score", 9).alias("score"))


# --- preparation -----------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id")


_L = "(select d.*, quality, toxic from documents d join labels using (doc_id))"
_SQL_CLEAN = "length(trim(text, E' \\n\\t\\r')) between 3 and 512"


def _sql_first(label: str) -> str:
    return f"(select text as comment_text, label from (select text, {label} as label, row_number() over (partition by text order by doc_id) as k from {_L} where {_SQL_CLEAN}) where k = 1)"


def _prepared(spark: SparkSession, sf_dir: str, labels: str, df: DataFrame | None = None) -> DataFrame:
    df = df if df is not None else _labelled(spark, sf_dir).withColumn("label", F.col("toxic"))
    return P.prepare(df, labels, F.col("doc_id"), text_col="text").select("comment_text", "label")


@query(f"select comment_text, label from {_sql_first('toxic')}")
def prep_label_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, "label")


_TOXICITY = "case when doc_id % 5 = 0 then null else (doc_id % 10) / 10.0 end"


@query(f"select comment_text, label from {_sql_first(f'cast(coalesce({_TOXICITY}, 0) >= 0.5 as int)')}")
def prep_toxicity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).drop("toxic").withColumn("toxicity", F.expr(_TOXICITY))
    return _prepared(spark, sf_dir, "toxicity", df)


@query(f"select comment_text, label from {_sql_first('cast(greatest(toxic, quality, cast(doc_id % 2 as int)) as int)')}")
def prep_row_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).withColumn("insult", F.col("quality")).withColumn("threat", (F.col("doc_id") % 2).cast("int"))
    return _prepared(spark, sf_dir, "toxic_columns", df)


_PAIRS = "(select a.doc_id, a.text as toxic_text, b.text as neutral_text from documents a join documents b on b.doc_id = a.doc_id + 1)"


@query(
    f"select comment_text, label from (select text as comment_text, label, row_number() over (partition by text order by half, doc_id) as k from (select doc_id, toxic_text as text, 1 as label, 0 as half from {_PAIRS} union all select doc_id, neutral_text, 0, 1 from {_PAIRS}) where {_SQL_CLEAN}) where k = 1"
)
def prep_pairs_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("neutral_sentence"))
    pairs = docs.withColumnRenamed("text", "toxic_sentence").join(after, "doc_id")
    return P.prepare(pairs, "pairs", F.col("doc_id")).select("comment_text", "label")


@query(
    f"select comment_text, label from (select comment_text, label, row_number() over (partition by comment_text order by src) as k from (select *, 0 as src from {_sql_first('toxic')} union all select *, 1 as src from {_sql_first('1 - quality')})) where k = 1"
)
def prep_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    parts = [P.prepare(df.withColumn("label", x), "label", F.col("doc_id"), text_col="text") for x in (F.col("toxic"), 1 - F.col("quality"))]
    return P.union(parts)


_SQL_UNION = ORACLE_SQL["prep_union_dedup"]


@query(_SQL_UNION)
def prep_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources by name, a preset over Parquet and a CSV file, read, labelled, cleaned and united."""
    path = f"{folders.app_dir(spark)}/sources"
    rows = _labelled(spark, sf_dir).orderBy("doc_id")
    write = lambda label: rows.select("text", label.alias("label")).write.mode("overwrite").option("maxRecordsPerFile", 5000)
    write(F.col("toxic")).parquet(f"{path}/first")
    write(1 - F.col("quality")).option("header", True).option("escape", '"').csv(f"{path}/second")
    preset = replace(PRESETS["binary"], path=f"{path}/first")
    return P.prepare_sources(spark, {"binary": preset, "own": Source(f"{path}/second", "csv", "label", "text")})


@query(
    f"with p as {_sql_first('toxic')}, n as (select count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from p),"
    " r as (select *, row_number() over (partition by label order by md5(comment_text || '42'), comment_text) as k from p)"
    " select comment_text, label from r, n where label = 1 or k <= least(cast(floor(pos * (1 - 0.3) / 0.3) as bigint), neg)"
)
def prep_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balance(_prepared(spark, sf_dir, "label"), 0.3)


@query(f"select comment_text, label from {_sql_first('toxic')} order by md5(comment_text || '42'), comment_text limit 20")
def prep_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample(_prepared(spark, sf_dir, "label"), 20)


@query(f"select comment_text, label, case when cast('0x' || substr(md5(comment_text || '42'), 1, 4) as int) % 10 = 0 then 'eval' else 'train' end as part from {_sql_first('toxic')}")
def prep_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split(_prepared(spark, sf_dir, "label"))


@query(f"select count(*) as rows, cast(sum(label) as bigint) as toxic, avg(label) as share from {_sql_first('toxic')}")
def prep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stats(_prepared(spark, sf_dir, "label"))


@query(f"select toxic, found, count(*) as documents from (select toxic, doc_id in (select doc_id from {_found('documents', 'doc_id', _normal)}) as found from {_L}) group by all")
def rule_vs_label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Moderator(lexicon(spark)).detect(_labelled(spark, sf_dir))
    return found.groupBy("toxic", "found").agg(F.count(F.lit(1)).alias("documents"))


@query(f"select count(*) as cases, avg(cast((doc_id in (select doc_id from {_found('documents', 'doc_id', _normal)})) = (toxic = 1) as int)) as accuracy from {_L}")
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accuracy(Moderator(lexicon(spark)).detect(_labelled(spark, sf_dir)), "found", "toxic")


# --- scores and streams ----------------------------------------------------------------------------------------


@query()
def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows scored by the fallback model."""
    df = _labelled(spark, sf_dir).select("doc_id", "text", F.col("toxic").alias("label"))
    model = S.fit_fallback(df.where(F.col("doc_id") % 5 != 0))
    return S.decide(S.score_fallback(model, df.where(F.col("doc_id") % 5 == 0))).select("doc_id", "label", "prob", "toxic")


@query("select doc_id, coalesce(s >= 0.99 or (s >= 0.9 and s < 0.99 and length(text) % 2 = 0), false) as blocked from (select doc_id, text, (doc_id % 20) / 20.0 + 0.04 as s from documents)")
def hybrid_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", "text", ((F.col("doc_id") % 20) / 20.0 + 0.04).alias("s"))
    even = lambda: lambda texts: [float(len(t) % 2 == 0) for t in texts]
    return S.hybrid(df, "s", lambda d: S.score_with(d, even)).select("doc_id", "blocked")


@query(
    f"with k as (select list(canon) as keys from {_keys(_normal)}), d as (select *, row_number() over () as k from conversations)"
    f" select conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '\\S+|\\s+'), lambda p: case when list_contains(keys, {_normal('p')}) then repeat('*', length(p)) else p end), '') as censored,"
    f" case when d.k in (select k from {_found('d', 'k', _normal)}) then 'BLOCKED' else 'OK' end as status from d, k"
)
def stream_moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations moderated as a stream of files, run to its end into Parquet files."""
    schema = _table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations*.parquet")
    out = moderated(stream, Moderator(lexicon(spark))).select("conv_id", "turn", "censored", "status")
    path = f"{folders.app_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
