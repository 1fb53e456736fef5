import itertools
import random

from lexsieve.llm import url_filters as U


def urls(n=800, seed=10):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        host = r.choice(["a.site.com", "b.site.com", "farm.site.org", "shop.site.net"])
        path = r.choice(["en", "fr", "win"])
        url = f"http://{host}/{path}/{k}" + r.choice(["", ".html", "?ref=x", "#top"])
        rows.append((k, url, host.startswith("farm") and path == "win"))
    return rows


def test_finds_the_combination(spark):
    rows = urls()
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = U.mine(pages.where("page_id < 500"))
    assert {"host:farm", "path:win"} in [set(r.tokens) for r in rules.collect()]
    got = {r.page_id: r.rejected for r in U.match(pages.where("page_id >= 500"), rules).collect()}
    assert got == {k: bad for k, _, bad in rows if k >= 500}


def test_rules_against_brute_force(spark):
    rows = urls(300, 11)
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    tokens = {r.page_id: (frozenset(r.t), r.bad) for r in pages.select("page_id", U.url_tokens(pages.url).alias("t"), "bad").collect()}
    total = len(tokens)
    usual = {t for t in set().union(*(x for x, _ in tokens.values())) if sum(t in x for x, _ in tokens.values()) > U.MAX_SHARE * total}
    seen: dict = {}
    for x, bad in tokens.values():
        x = sorted(x - usual)
        for n in range(1, len(x) + 1):
            for c in itertools.combinations(x, n):
                s = seen.setdefault(frozenset(c), [0, 0])
                s[0] += 1
                s[1] += bad
    share = sum(b for _, b in tokens.values()) / total
    good = {c: y / n for c, (n, y) in seen.items() if y >= max(U.MIN_COUNT, U.MIN_SHARE * total) and y / n >= U.MIN_CONFIDENCE and y / n / share >= U.MIN_LIFT}
    want = {c: v for c, v in good.items() if not any(d < c and w >= v for d, w in good.items())}
    got = {frozenset(r.tokens): r.confidence for r in U.mine(pages).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in got)
    other = {frozenset(r.tokens): r for r in U.mine(pages).collect()}
    judged = {r.page_id: (r.rejected, r.n_rules) for r in U.match(pages, U.mine(pages)).collect()}
    assert judged == {k: (any(c <= x for c in other), sum(c <= x for c in other)) for k, (x, _) in tokens.items()}


def test_labelled_pages(spark):
    pages = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://b/x/2.html",), ("http://c/3",), ("http://c/4",), ("http://c/5",), ("http://c/none",), ("",), (None,)], "url string").withColumn("quality", U.F.lit("?"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 1), (4, None, 0), (4, 1, None), (5, 1, 1), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").withColumn("url", U.F.lit("?"))
    got = sorted(map(tuple, U.labelled_pages(pages, labels).collect()))
    assert got == [("http://a/1", True), ("http://a/1", True), ("http://b/x/2.html", False), ("http://c/3", True), ("http://c/5", True)]
    assert U.labelled_pages(pages.where("false"), labels).count() == 0 and U.labelled_pages(pages, labels.where("false")).count() == 0


def test_odd_rows(spark, odd, nothing):
    rows = [(1, "http://farm.site.org/win/1", True), (1, "http://farm.site.org/win/1", True), (None, "x", False), (2, None, None), (3, "", False), (4, "http://a/" + "b/" * 50000, False), (5, "not a url at all", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("tokens", U.F.lit(1)).withColumn("n_rules", U.F.lit(2)).withColumn("confidence", U.F.lit(3))
    rules = U.mine(pages, min_count=1, min_lift=1.0)
    assert U.match(pages, rules).count() == len(rows)
    none = U.mine(pages.where("false"))
    assert none.count() == 0 and U.match(pages, none).where("rejected").count() == 0 and U.match(pages.where("false"), rules).count() == 0
    number = {r.url: r.n for r in spark.createDataFrame([("http://a/en/825?x=1",), ("http://a/en/148.html",), ("http://a/9/",), ("http://a/b9",), ("",)], "url string").select("url", U.document_number(U.F.col("url")).alias("n")).collect()}
    assert list(number.values()) == [825, 148, 9, None, None]
