import random

from lexsieve.llm.substring_dedup import repeats_by_brute_force, substring_repeats

KEY = ["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word"]


def same(spark, rows, **options):
    got = substring_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).toPandas()[KEY].sort_values(KEY).reset_index(drop=True).astype("int64")
    want = repeats_by_brute_force(rows, options.get("min_words", 50))[KEY].sort_values(KEY).reset_index(drop=True).astype("int64")
    assert got.equals(want)
    return got


def test_brute_force(spark, words):
    r = random.Random(1)
    passage = [r.choice(words) for _ in range(70)]
    rows = []
    for k in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 150))]
        if k % 3 == 0:
            at, cut = r.randint(0, len(w)), r.randint(0, 25)
            w[at:at] = passage[cut : cut + r.randint(45, 70)]
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[5][1] + " " + passage[0]) for k in range(5)] + [(7, rows[7][1]), (200, None), (None, rows[3][1])]
    assert len(same(spark, rows))


def test_short_blocks_and_repeats_inside_one_text(spark, words):
    r = random.Random(2)
    few = words[:6]
    rows = [(k, " ".join(r.choice(few) for _ in range(40))) for k in range(30)] + [(50, "a b c d e " * 8), (51, "z " * 40)]
    same(spark, rows, min_words=7, block=4)


def test_odd_rows(odd, nothing):
    got = substring_repeats(odd).toPandas()
    # the repeated row is one occurrence; null ids and texts, and texts without 50 words, take no part
    assert set(got.doc_id) == {1, 2, 11}
    assert set(map(tuple, got[got.doc_id == 1][KEY[1:]].values)) == {(0, 120, 2, 0)}
    assert substring_repeats(nothing).count() == 0
