"""The queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.substring_dedup import substring_repeats

    return substring_repeats(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.decontamination import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.ngram_jaccard import near_duplicate_groups

    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.sentencepiece_codec import encode

    return encode(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs)[0])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm import pii

    return pii.redacted(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm import url_filters

    pages = _table(spark, sf_dir, "pages")
    return url_filters.match(pages, url_filters.mine(url_filters.labelled_pages(pages, _table(spark, sf_dir, "labels"))))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexsieve.llm.cells import neighbours_of

    return neighbours_of(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op8_url_filters": op8_url_filters,
    "op9_ann": op9_ann,
}

#: Windows of 50 words with their first other occurrence, and runs of those that move along with it.
_OP1 = """
with t as (select doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x20]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
p as (select distinct doc_id, x.i as i, x.h as h from (select doc_id, unnest(list_transform(range(0, len(w) - 49), lambda i: {'i': i, 'h': md5(array_to_string(w[i + 1:i + 50], ' '))})) as x from t where len(w) >= 50)),
o as (select *, count(*) over g as n, row_number() over (g order by doc_id, i) as k, first_value(doc_id) over f as d1, first_value(i) over f as i1, nth_value(doc_id, 2) over f as d2, nth_value(i, 2) over f as i2
  from p window g as (partition by h), f as (partition by h order by doc_id, i rows between unbounded preceding and unbounded following)),
r as (select doc_id, i, case when k = 1 then d2 else d1 end as rd, case when k = 1 then i2 else i1 end as ri from o where n > 1),
s as (select *, i - row_number() over (partition by doc_id, rd, ri - i order by i) as run from r)
select doc_id, cast(min(i) as int) as start_word, cast(count(*) + 49 as int) as n_words, rd as ref_doc_id, cast(min(ri) as int) as ref_start_word from s group by doc_id, rd, ri - i, run
"""

#: All pairs of documents by shared word trigrams, and the components of those of a Jaccard similarity of 0.6.
_OP4 = """
with recursive t as (select distinct doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') as w from documents where doc_id is not null and text is not null),
g as (select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as gram from t where len(w) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
b as (select x.doc_id as a, y.doc_id as b, count(*) as shared from g x join g y on x.gram = y.gram and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from b join n x on x.doc_id = a join n y on y.doc_id = b where shared >= 0.6 * (x.n + y.n - shared) - 1e-9),
c as (select a as doc_id, a as seen from (select distinct a from e) union select c.doc_id, e.b from c join e on e.a = c.seen),
l as (select doc_id, min(seen) as group_id from c group by doc_id)
select group_id, list(doc_id order by doc_id) as doc_ids, cast(count(*) as int) as n_docs from l group by group_id
"""

#: The other operators fit models, tokenise or walk graphs; the tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op4_ngram_jaccard_join": _OP4}
