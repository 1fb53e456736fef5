"""URL filters by association rules: FP-growth over URL tokens and labels, rules matched by an inverted index.

A URL's tokens say where they stand: scheme, labels of the host, path words and ending, query pairs, fragment. Labelled URLs become transactions of their tokens and their label; Spark's FP-growth finds the frequent
token sets, and rules "tokens => bad" are kept by support, confidence and lift, without those that a more general rule
of at least their confidence covers. Each rule is indexed under its rarest token, so a URL meets only rules one of
whose tokens it has, and those whose tokens it has all reject it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.llm._spark import cut, maybe_broadcast

#: Labelled URLs a rule holds for: at least this many and this share of them.
MIN_COUNT, MIN_SHARE = 5, 0.0001
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
#: Tokens of more than this share of the labelled URLs are left out; 1 leaves out none.
MAX_SHARE = 0.9
BAD, GOOD = "label=bad", "label=good"


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; null for a null URL. Case is folded, numbers are ``#``.

    They are its scheme, the labels of its host, its path's words other than numbers, its path's ending, its query
    pairs and its fragment: the parts, so that combinations such as the whole host are left to the mining.
    """
    u = F.lower(F.trim(url))
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d+$", "")
    number = lambda x: F.regexp_replace(x, r"\d+", "#")
    path = number(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    name = lambda kind, words: F.transform(F.filter(words, lambda x: (x != "") & (x != "#")), lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                name("scheme", F.array(F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1))),
                name("host", F.split(host, r"\.")),
                name("path", F.split(F.regexp_replace(path, r"\.[a-z]+$", ""), "[/._-]+")),
                name("end", F.array(F.regexp_extract(path, r"(/|\.[a-z]+)$", 1))),
                name("query", F.split(number(F.regexp_extract(rest, r"\?([^#]*)", 1)), "[&;]")),
                name("fragment", F.array(number(F.regexp_extract(rest, r"#(.*)$", 1)))),
            )
        )
    )


def document_number(url: Column) -> Column:
    """The number that ends a URL's path (an extension or slash may follow), as a long; null where there is none."""
    return F.regexp_extract(url, r"/(\d{1,18})(?:\.[A-Za-z]+)?/?(?:[?#].*)?$", 1).try_cast("long")


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_share: float = MAX_SHARE) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support, lift): sets of tokens whose URLs are bad.

    A token that more than ``max_share`` of the URLs have says nothing, would double the number of frequent sets, and
    is left out. Rows with a null URL or a null label are left out; every other row, repeated ones too, is one
    transaction. Empty and long URLs have the tokens they have. Of a rule and a more general one of equal confidence
    the general one stays. Without transactions, or without rules that pass, the result is empty. Other columns are not
    looked at.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = labelled.select(F.col(url_col).alias("url"), F.col(bad_col).cast("boolean").alias("bad")).where("url is not null and bad is not null")
    rows = cut(rows.select(F.concat(url_tokens(F.col("url")), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items")))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double")
    usual = F.broadcast(rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > max_share * total) & ~F.col("token").isin(BAD, GOOD)).agg(F.collect_list("token").alias("usual")))
    rows = cut(rows.crossJoin(usual).select(F.array_except("items", "usual").alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_count / total, min_share)), minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where((F.col("consequent")[0] == BAD) & ~F.array_contains("antecedent", GOOD) & (F.col("lift") >= min_lift))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"))
    # a rule meets the more general ones under their rarest token, one of its own
    token = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    rarest = F.array_min(F.collect_list(F.struct("seen", "token")))
    general = each.join(token, "token").groupBy("tokens", "confidence").agg(rarest.alias("least")).select(F.col("tokens").alias("fewer"), F.col("confidence").alias("more"), F.col("least.token").alias("token"))
    covered = each.join(general, "token").where((F.size("fewer") < F.size("tokens")) & (F.col("more") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0)).select("tokens").distinct()
    kept = rules.join(covered.select(F.col("tokens").alias("gone")), F.col("tokens") == F.col("gone"), "left_anti")
    return kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support", "lift")


def match(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, rejected, n_rules, confidence) of every row: whether any rule holds, how many, the greatest confidence.

    A null URL is rejected by none and has no confidence, nor has an empty one unless a rule holds for it; long ones are
    matched whole. Rows repeated under one id and URL are judged alike, two URLs under one id each, null ids too. An
    empty table gives an empty one, and without rules nothing is rejected. Other columns are not looked at.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    rules = cut(rules)
    # the distinct URLs are matched, so that a hot one is matched once and no row needs an id
    urls = pages.where("url is not null").select("url").distinct().withColumn("have", url_tokens(F.col("url")))
    token = urls.select("url", "have", F.explode("have").alias("token"))
    seen = token.join(maybe_broadcast(rules.select(F.explode("tokens").alias("token")).distinct(), 16 + F.octet_length("token")), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    index = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = cut(index.groupBy("rule_id", "tokens", "confidence").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("least")).select("rule_id", "tokens", "confidence", F.col("least.token").alias("token")))
    hits = token.join(maybe_broadcast(index, 64 + F.octet_length(F.array_join("tokens", " ")) + 16 * F.size("tokens")), "token").where(F.size(F.array_except("tokens", "have")) == 0)
    found = hits.groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence")).withColumnRenamed("url", "found")
    out = pages.join(found, F.col("url") == F.col("found"), "left")
    return out.select("page_id", F.col("n_rules").isNotNull().alias("rejected"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose path ends in the number of a labelled document: bad if of low quality or toxic.

    Pages without a number or with a null URL, and labels with a null id or of two nulls, give no row; of several labels
    of one document the worst counts. A null beside a label that says bad is bad, beside one that doesn't it is left
    out. Repeated pages stay repeated, and other columns are not looked at.
    """
    known = labels.select(F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("number is not null and bad is not null")
    known = known.groupBy("number").agg(F.max("bad").alias("bad"))
    return pages.select("url", document_number(F.col("url")).alias("number")).where("number is not null").join(known, "number").select("url", "bad")
