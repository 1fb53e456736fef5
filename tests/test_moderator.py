import json
import random

import numpy as np
import pyarrow as pa
import pytest
from lexsieve.functions.canonical import Flags
from lexsieve.functions.similarity import jaro_winkler_all, jaro_winkler_of, register
from lexsieve.operators import moderator as M
from lexsieve.operators.moderator import Moderator, effective_threshold, word_spans
from lexsieve.plans.queries import QUERIES
from lexsieve.sources.lexicon import Lexicon, UnsupportedLanguage, read_pack_index


@pytest.fixture(scope="module")
def lex(spark):
    return Lexicon.from_mapping(spark, {"aa": "shit\nbitch\n", "bb": "плохо\nслово\nbad word"})


def frame(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")


def censored(spark, lexicon, text, mask="*", threshold=None):
    r = Moderator(lexicon).censor(frame(spark, text), mask, threshold=threshold).first()
    return r.censored if r.found else r.found


@pytest.mark.parametrize(
    ("custom", "text", "threshold", "mask", "want"),
    [
        ([], "crap ass hell shit bitch dick", 1.0, "*", "crap ass hell **** ***** dick"),
        (["bad"], "a bad! thing,bad", 1.0, "*", "a **** thing,bad"),
        (["bad"], "a (BAD) bаd b4d b.a.d", 1.0, "#", "a ##### ### b4d #####"),
        (["bad"], "x  bad\tbad\n bad ", 1.0, "éz", "x  ééé\tééé\n ééé "),
        (["badword"], "badw0rd", 1.0, "*", False),
        (["badword"], "badw0rd", 0.9, "*", "*******"),
        (["badword"], "badw0rd", 0.95, "*", False),
        (["badword"], "b a d w o r d", 1.0, "*", False),
        (["bad word"], "a bad word here", 1.0, "*", False),
        (["bad word"], "badword", 0.9, "*", "*******"),
        (["badword"], "badwordy", 0.0, "*", False),
        (["badword"], "badwordy", -1, "*", False),
        (["badword"], "badwordy", 1.5, "*", False),
        (["hello"], "hеllo", 1.0, "*", "*****"),
        (["hello"], "h⍺llo", 1.0, "*", False),
        (["privet"], "привет", 1.0, "*", "******"),
        (["привет"], "privet", 1.0, "*", "******"),
        (["dog"], "ԁog", 1.0, "*", False),
        ([], "", 1.0, "*", False),
        ([], "   \n\t  ", 1.0, "*", False),
        (["🅱🅰🅳"], "  ｂａｄ  ok", 1.0, "*", "  ***  ok"),
    ],
)
def test_golden(spark, lex, custom, text, threshold, mask, want):
    assert censored(spark, lex.with_words(custom), text, mask, threshold) == want


def test_verdicts_and_joined_path(spark, lex, monkeypatch):
    texts = frame(spark, "a shit day", "fine", None, "", "ПЛОХО!", "good bitchy")
    inline = [r.found for r in sorted(Moderator(lex).detect(texts).collect())]
    assert inline == [True, False, None, False, True, False]
    assert [r.status for r in sorted(Moderator(lex).status(texts).collect())] == ["BLOCKED", "OK", None, "OK", "BLOCKED", "OK"]
    assert [r.id for r in Moderator(lex).clean(texts).orderBy("id").collect()] == [1, 3, 5]
    before = {r.id: r.censored for r in Moderator(lex).censor(texts).collect()}
    hits = sorted(map(str, Moderator(lex).hits(texts, "id").collect()))
    top = Moderator(lex).top_hits(texts).collect()
    monkeypatch.setattr(M, "INLINE_KEYS", 1)
    for size in (M.BROADCAST_BYTES, 1):  # keys sent to the workers, keys joined by shuffle
        monkeypatch.setattr(M, "BROADCAST_BYTES", size)
        assert [r.found for r in sorted(Moderator(lex).detect(texts).collect())] == inline
        assert {r.id: r.censored for r in Moderator(lex).censor(texts).collect()} == before
        assert sorted(map(str, Moderator(lex).hits(texts, "id").collect())) == hits and Moderator(lex).top_hits(texts).collect() == top
        assert [r.found for r in sorted(Moderator(lex).detect(frame(spark, "shiit", "shit", None, "fine"), threshold=0.9).collect())] == [True, True, None, False]


def test_no_shuffle_for_verdicts(spark, lex):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for t in (None, 0.9):
        for df in (Moderator(lex).censor(frame(spark, "x"), threshold=t), Moderator(lex).detect(frame(spark, "x"), threshold=t)):
            assert "Exchange" not in plan(df) and "Generate" not in plan(df) and "monotonically" not in plan(df)
    for name in ("detect_exact", "censor_text", "clean_documents"):
        assert "Exchange" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_workers_hold_few_words_at_a_time(spark, monkeypatch):
    long = [f"word{k}" for k in range(3000)]
    texts = ["\n".join([*long, "badw0rd", *long, "badword"]), None, "", "badwordy", *long]
    want = [["badw0rd", "badword"], None, [], ["badwordy"], *[[]] * 3000]
    monkeypatch.setattr(M, "PIECE_CHARS", 100)
    monkeypatch.setattr(M, "REMEMBERED", 200)
    asked, pairs = [], M.Matcher.pairs
    monkeypatch.setattr(M.Matcher, "pairs", lambda self, words: asked.append(len(words)) or pairs(self, words))
    (got,) = M._matching(frame(spark, "x"), ["badword"], 0.9).func(iter([pa.array(texts)]))
    assert got.to_pylist() == want and max(asked) < 50


def test_no_python_for_exact_verdicts_and_lexicons(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("detect_exact", "detect_full", "censor_text", "custom_words", "canonical_full", "lexicon_dead_entries", "lexicon_sizes"):
        made = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in made and "ExistingRDD" not in made, name


def test_phrases_and_patterns_where_asked_for(spark):
    lists = {"en": "bad word\nword game over\nf[ou]+l\n(no)+pe\nplain"}
    for flags in (Flags(), Flags(transliterate=False, lookalikes=False)):
        lexicon = Lexicon.from_mapping(spark, lists, flags)
        texts = frame(spark, "a bad, WORD here", "bad  word game over plain!", "bad words", "word bad", "fooul! fol ful foolish", "nonope, nope no", "plain", "", None, "bad")
        m = Moderator(lexicon, phrases=True, patterns=True)
        got = [(r.found, r.censored) for r in m.censor(texts).orderBy("id").collect()]
        want = ["a **** **** here", "***  **** **** **** ******", "bad words", "word bad", "****** *** *** foolish", "******* **** no", "*****", "", None, "bad"]
        assert [c for _, c in got] == want
        assert [f for f, _ in got] == [True, True, False, False, True, True, True, False, None, False]
        assert [r.found for r in m.detect(texts).orderBy("id").collect()] == [f for f, _ in got]
        assert [r.found for r in Moderator(lexicon, phrases=True).detect(texts, threshold=0.93).orderBy("id").collect()] == [True, True, False, False, True, True, True, False, None, False]
        assert [r.found for r in Moderator(lexicon).detect(texts).orderBy("id").collect()] == [False, True, False, False, False, True, True, False, None, False]
    with pytest.raises(ValueError, match="not a regular"):
        Moderator(Lexicon.from_mapping(spark, {"en": "f[oo"}), patterns=True).detect(frame(spark, "x"))


def test_hits_and_languages(spark, lex):
    hits = Moderator(lex.with_words(["shit"])).hits(frame(spark, "oh shit, слово"), "id").collect()
    assert {(r.pos, r.token, r.lang, r.raw) for r in hits} == {(1, "shit,", "aa", "shit"), (1, "shit,", "custom", "shit"), (2, "слово", "bb", "слово")}
    assert lex.languages == ["aa", "bb"] and lex.select([" BB ", "aa"]).languages == ["bb", "aa"]
    assert Moderator(lex.select([])).detect(frame(spark, "shit")).first().found is False
    assert Moderator(lex.with_words(["new"]).select(None)).detect(frame(spark, "new")).first().found is False
    for wrong in (["xx"], ["aa", "xx"]):
        with pytest.raises(UnsupportedLanguage, match="This language is not supported"):
            lex.select(wrong)
    with pytest.raises(UnsupportedLanguage):
        lex.select(["aa"]).select(["aa", "b1"])
    with pytest.raises(ValueError, match="empty"):
        Moderator(lex).censor(frame(spark, "x"), "")


def test_lists_from_a_folder(spark, tmp_path):
    (tmp_path / "fr.txt").write_text("﻿con\r\n chier\n\n###\n", encoding="utf-8")
    (tmp_path / "en.txt").write_text("Bad\nbad\nf[o]+l", encoding="utf-8")
    lex = Lexicon.from_dir(spark, str(tmp_path), flags=Flags(transliterate=False, lookalikes=False))
    assert lex.languages == ["en", "fr"]
    assert {r.canon for r in lex.keys().collect()} == {"con", "chier", "bad", "fol"}
    assert {(r.lang, r.entries, r["keys"]) for r in lex.sizes().collect()} == {("en", 3, 2), ("fr", 2, 2)}
    packs = {r.lang: r.words for r in lex.packs().collect()}
    assert packs == {"en": '["Bad","bad","f[o]+l"]', "fr": '["con","chier","###"]'}
    out = tmp_path / "out"
    lex.write_packs(str(out))
    assert {k: (out / "packs" / f"{k}.json").read_text() for k in packs} == packs
    assert [tuple(r) for r in read_pack_index(spark, str(out)).collect()] == [("en", 3, "packs/en.json"), ("fr", 3, "packs/fr.json")]
    assert json.loads((out / "package.json").read_text())["languages"] == ["en", "fr"] and "| fr | 3 |" in (out / "README.md").read_text()
    back = Lexicon.from_packs(spark, str(out), flags=lex.flags)
    assert back.languages == ["en", "fr"] and {r.canon for r in back.keys().collect()} == {r.canon for r in lex.keys().collect()}
    assert Lexicon.from_packs(spark, str(out), ["fr"]).languages == ["fr"]
    assert Lexicon.from_dir(spark, str(tmp_path), ["fr"]).languages == ["fr"]


def test_thresholds():
    assert [effective_threshold(t) for t in (None, 0, 0.0, -1, 1, 1.0, 1.5, 0.9)] == [None] * 7 + [0.9]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("hello", "hello", 1), ("hello", "hellp", 0.92), ("hello", "world", 0.466667), ("abc", "xyz", 0), ("badw0rd", "badword", 0.942857), ("martha", "marhta", 0.961111), ("cheeseburger", "cheese fries", 0.866667), ("badword", "badwordy", 0.975), ("exactt", "exact", 0.966667), ("", "", 1), ("", "a", 0)],
)
def test_similarity(a, b, want):
    assert jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6) and jaro_winkler_of(b, a) == pytest.approx(want, abs=1e-6)


def test_similarity_of_many_pairs_at_once():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé🙂") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 40])))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    b[::3] = [x[:2] + x[3:4] + x[2:3] + x[4:] for x in a[::3]]
    assert np.allclose(jaro_winkler_all(a, b, cells=256), [jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], atol=1e-12)
    assert len(jaro_winkler_all([], [])) == 0


def test_similarity_in_sql(spark):
    register(spark)
    assert spark.sql("select round(jaro_winkler('martha', 'marhta'), 6) as s").first().s == 0.961111


def test_similar_words_equal_all_pairs(spark, monkeypatch):
    keys = ["badword", "shitty", "slowly", "ab", "abcd"]
    keys += ["éclair", "ñandúx"]
    said = ["éclaïr", "ñandux", "eclair", "badw0rd", "badwordy", "shity", "slowely", "abdc", "ba", "xyz", "b", "badwordbadword"]
    m = Moderator(Lexicon.from_mapping(spark, {"aa": "\n".join(keys)}, Flags(transliterate=False, lookalikes=False)))
    for t in (0.95, 0.9, 0.8, 0.5, 0.3):
        got = {(r.canon, r.key) for r in m.similar_words(spark.createDataFrame([(w,) for w in said], "canon string"), t).collect()}
        assert got == {(w, k) for w in said for k in keys if jaro_winkler_of(w, k) > t}
        with monkeypatch.context() as p:
            p.setattr(M, "INLINE_KEYS", 1)
            p.setattr(M, "BROADCAST_BYTES", 1)
            far = Moderator(Lexicon.from_mapping(spark, {"aa": "\n".join(keys)}, Flags(transliterate=False, lookalikes=False)))
            assert got == {(r.canon, r.key) for r in far.similar_words(spark.createDataFrame([(w,) for w in [*said, None]], "canon string"), t).collect()}


def test_spans(spark):
    text = "  one\ttwo 🙂x　three\n"
    got = [(r.pos, r.token, r.start, r.len) for r in word_spans(frame(spark, text), "id").orderBy("pos").collect()]
    assert got == [(0, "one", 2, 3), (1, "two", 6, 3), (2, "🙂x", 10, 2), (3, "three", 13, 5)]
    assert all(text[s : s + n] == w for _, w, s, n in got)
