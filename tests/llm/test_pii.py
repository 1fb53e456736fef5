import itertools
import math
import random

import pytest
from lexsieve.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.train()


def spans(model, text):
    return [(text[a:b], t) for a, b, t in pii.find(model, text)]


def test_held_out_spans(model):
    right = said = true = 0
    for text, truth in pii.examples(400, seed=77):
        found = pii.find(model, text)
        right, said, true = right + len({*found} & {*truth}), said + len(found), true + len(truth)
    assert right / true > 0.97 and right / said > 0.98


def test_dynamic_programming_is_exact(model):
    """The best segmentation against the scores of all segmentations of short regions."""
    for text in ("ip 1.2.3.4, 55", "a@b.cd +1 (201) 555-0123", "12-34 4111111111111111"):
        atoms, segments = model.segments(text, "", "")
        options = {}
        for i, j, _, s in segments:
            options.setdefault(i, []).append((j, s))
        best = (-math.inf, None)

        def walk(i, before, score, out):
            nonlocal best
            if i == len(atoms):
                best = max(best, (score, tuple(out)))
                return
            walk(i + 1, pii.OUTSIDE, score + model.jump[before, pii.OUTSIDE], out)
            for j, s in options.get(i, []):
                for t in range(pii.OUTSIDE):
                    if s[t] > -30:  # no score of a segment makes up for less
                        walk(j, t, score + model.jump[before, t] + s[t], [*out, (atoms[i][0], atoms[j - 1][1], pii.TYPES[t])])

        walk(0, pii.OUTSIDE, 0.0, [])
        assert model.best(text) == list(best[1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail me.55@mail4.example.com now", [("me.55@mail4.example.com", "EMAIL")]),
        ("call +1 (136) 555-7479%%% que", [("+1 (136) 555-7479", "PHONE")]),
        ("from 108.51.216.133 to 108.51.216.133", [("108.51.216.133", "IP")] * 2),
        ('token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of', [("9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "SECRET")]),
        ("heat 4736962573099581 inha 97.51.17.173", [("4736962573099581", "CARD"), ("97.51.17.173", "IP")]),
        ("Licensed under CC BY-NC 4.0. and version 3.", []),
        ("in 1999 we sold 1,250 at 12:30 on 2024-01-31 for $15.99", []),
        ("order 4736962573099582 of 9807915762804490", []),  # no card's check digit
        ("1999 1999 1999 1999", []),
        ("the years 1990 1995 2001 2004 2010 and 1987-1990-1995", []),
        ("", []),
    ],
)
def test_cases(model, text, want):
    assert spans(model, text) == want


def test_odd_rows(odd, nothing, model):
    got = pii.redacted(odd, model).collect()
    before = odd.collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((r.doc_id, pii.redact(r.text, pii.find(model, r.text)) if r.text else r.text)) for r in before)
    assert pii.replace_in(odd, model).columns == odd.columns and pii.redacted(nothing, model).count() == 0
    digits = "1-" * 3000
    assert pii.redact(digits, pii.find(model, digits)) is not None
    assert all(t is None or isinstance(t, str) for t in itertools.chain(r.text for r in got))


def test_long_lists_are_not_cut(model):
    """Entities of several words in lists of over 2000 characters, against the segmentation of the whole list."""
    r = random.Random(4)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {"CARD": lambda: " ".join(digits(4) for _ in range(4)), "PHONE": lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"}
    for kind, one in make.items():
        for between in (";\n", "\n#{}: "):
            text, want = "", []
            for k in range(300):
                text += between.format(k) if k else ""
                entity = one()
                want.append((len(text), len(text) + len(entity), kind))
                text += entity
            assert len(text) > 5000 and list(pii.regions(text)) == [(0, len(text))]
            found = pii.find(model, text)
            assert found == model.best(text) and {*want} <= {*found}
