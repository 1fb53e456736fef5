import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that operators use inside, so that a clash would show.
EXTRA = ["part", "hits", "node", "size", "sketch", "gram", "n", "a", "b", "label", "label_id", "toxic", "score", "keep", "spans", "gone", "group_id", "item_id", "url", "row", "found", "v", "id", "hit_id", "wanted_doc", "x"]


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return [f"{a}{b}" for a in ("ka", "lo", "mi", "ret", "sun", "vor", "ple", "gri") for b in ("da", "no", "ste", "lin", "ous", "em", "att", "iv")] + [f"w{r.randint(100, 999)}x" for _ in range(200)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    r = random.Random(5)
    long = " ".join(r.choice(words) for _ in range(60_000))
    text = " ".join(r.choice(words) for _ in range(120))
    rows = [(1, text), (1, text), (2, text), (3, None), (None, text), (None, None), (4, ""), (5, "   \n\t "), (6, long), (7, "one"), (8, "x" * 300_000), (9, "naïve Ünïcode \u0000 ☃ 🙂 مرحبا"), (10, "| * # !! ..."), (11, text + " and a tail")]
    return spark.createDataFrame([(*x, *(["?"] * len(EXTRA))) for x in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
