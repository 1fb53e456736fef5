import random

import pytest
from lexsieve.llm import decontamination as D
from lexsieve.llm import _text as X
import numpy as np
import pyarrow as pa

KEY = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"]


def corpus(words, seed=8):
    r = random.Random(seed)
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 40)))) for k in range(8)]
    rows = []
    for k in range(40):
        w = [r.choice(words) for _ in range(r.randint(0, 80))]
        if k % 2:
            _, text = r.choice(items)
            t = text.split()
            cut = r.randint(0, len(t))
            pieces = [t[:cut], t[cut:]]
            r.shuffle(pieces)  # reordered passages
            at = r.randint(0, len(w))
            w = w[:at] + pieces[0] + w[at : at + 3] + pieces[1] + w[at + 3 :]
        rows.append((k, " ".join(w).title() if k % 5 == 0 else ", ".join(w)))
    return rows, items


def brute(rows, items, k, least):
    out = set()
    for d, x in rows:
        for i, y in items:
            b, a = x.lower().replace(",", " ").split(), y.lower().split()
            tiles = D.brute_force_tiles(a, b, k)
            if tiles and sum(n for *_, n in tiles) / len(a) >= least:
                out.add((d, i, round(sum(n for *_, n in tiles) / len(a), 9), len(tiles), max(n for *_, n in tiles)))
    return out


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, words, limit):
    rows, items = corpus(words)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles, r.longest_tile) for r in D.leaks(docs, bench, min_match=3, min_coverage=0.2, broadcast_bytes=limit).collect()}
    assert got == brute(rows, items, 3, 0.2) and len(got) > 10


def test_tiles_equal_brute_force_on_repetitive_words():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(2, 14))] for _ in range(2))
        h = [X.tokens(pa.array([" ".join(x)]), "word").hash for x in (a, b)]
        pairs = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]]
        assert D.tile_by_length(*h, 2) == D.brute_force_tiles(a, b, 2)
        got = D.tile(h[0], h[1], np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), 2) if pairs else []
        assert got == D.brute_force_tiles(a, b, 2)


def test_repetitive_texts_are_tiled_by_length(spark, monkeypatch, words):
    """A text of one word over and over against an item of that word, and mixed ones, by either way to tile."""
    said = words[0]
    items = [(1, " ".join([said] * 200)), (2, " ".join([said] * 20 + words[:20])), (3, " ".join(words[:30]))]
    rows = [(1, " ".join([said] * 1_000_000)), (2, " ".join([said] * 30 + words[5:25] + [said] * 9 + words[:8]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda d: {(d, i, round(c, 9), n, m) for d, i, c, n, m in D.leaks(d, bench, min_coverage=0.1).collect()}
    got = found(docs)
    assert (1, 1, 1.0, 1, 200) in got
    small = {x for x in got if x[0] == 2}
    assert small == brute(rows[1:], items, D.MIN_MATCH, 0.1) and len(small) == 3
    monkeypatch.setattr(D, "MAX_PAIRS", 0)
    assert found(docs.where("doc_id = 2")) == small


def test_odd_rows(spark, odd, nothing, words):
    text = odd.where("doc_id = 2").first().text
    bench = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "one")], "item_id long, text string")
    for limit in (D.BROADCAST_BYTES, 0):
        got = D.leaks(odd, bench, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.item_id, r.coverage) for r in got} == {(1, 1, 1.0), (2, 1, 1.0), (11, 1, 1.0)} and len(got) == 4
        assert D.leaks(nothing, bench, broadcast_bytes=limit).count() == 0
        assert D.leaks(odd, bench.where("false"), broadcast_bytes=limit).count() == 0
