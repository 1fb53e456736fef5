"""Character tables: our own, built from ranges and paired strings, or read from a folder or strings of JSON.

``decorated`` folds signs that survive NFKC and lowercasing; ``to_latin`` has the letters of a Cyrillic alphabet;
``lookalikes`` maps letters that look like a Latin one to it.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass, field
from pathlib import Path

LETTERS = string.ascii_lowercase

#: Negative circled and squared letters, from these code points on in alphabetical order.
_NEGATIVE = (0x1F150, 0x1F170)
#: Syllabics by the letter they stand for.
_SYLLABICS = {
    "a": (0x15E3, 0x140A, 0x140B), "c": (0x141C,), "d": (0x1650, 0x15EA), "e": (0x1401, 0x140D), "h": (0x1426,), "i": (0x1403, 0x1404), "k": (0x141A,), "m": (0x141E,), "n": (0x144E, 0x1420),
    "o": (0x1405, 0x1406), "p": (0x1417,), "s": (0x1422, 0x1428, 0x1429, 0x142A), "t": (0x1418,), "u": (0x144C,), "w": (0x140F, 0x1411, 0x1413, 0x1415, 0x1427), "y": (0x1424,),
}
#: Brackets and repetition marks become punctuation, which the next step drops.
_MARKS = [*range(0x3010, 0x3012), *range(0x3016, 0x301C), *range(0x301D, 0x3020), *range(0x3030, 0x3036), 0x3037, *range(0x303B, 0x3040)]

DECORATED: dict[str, str] = {chr(base + k): c for base in _NEGATIVE for k, c in enumerate(LETTERS)}
DECORATED |= {chr(code): c for c, codes in _SYLLABICS.items() for code in codes}
DECORATED |= {chr(code): "-" for code in _MARKS}

_SINGLE = ("абвгдеёзийклмнопрстуфхыэ", "abvgdeeziyklmnoprstufhye")
_MULTI = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
#: Hard and soft sign have no image.
_SILENT = "ъь"
TO_LATIN: dict[str, str] = dict(zip(*_SINGLE, strict=True)) | _MULTI | dict.fromkeys(_SILENT, "")

#: Latin sequences in an order whose successive replacement equals a greedy scan for the longest.
SEQUENCES = tuple((latin, next(c for c, v in _MULTI.items() if v == latin)) for latin in ("ts", "sch", "zh", "ch", "sh", "yu", "ya"))
#: Of several Cyrillic letters with one image the first of the alphabet stands for it.
TO_CYRILLIC: dict[str, str] = {}
for _c, _l in zip(*_SINGLE, strict=True):
    TO_CYRILLIC.setdefault(_l, _c)

_ALIKE = {
    "a": "аα⍺", "b": "вь", "c": "сϲ", "d": "ԁⅾ", "e": "еёє", "f": "ƒ", "g": "ɡ", "h": "һ", "i": "і", "j": "ј", "k": "кκ",
    "l": "ⅼ", "m": "м", "n": "п", "o": "оο", "p": "рρ", "r": "г", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "w": "ω", "x": "хχ", "y": "у",
}
LOOKALIKES: dict[str, str] = {v: c for c, variants in _ALIKE.items() for v in variants}

#: Digits and signs written for letters; an extension that is off by default.
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}

#: Ranges of characters that NFKC leaves alone, whatever stands beside them: letters of common scripts, and signs.
INERT = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03C9\u0400-\u0482\u048A-\u052F"
    r"\u2010\u2012-\u2016\u2018-\u2023\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF"
)


def _to_cyrillic(to_latin: dict[str, str]) -> dict[str, str]:
    """Latin letters and sequences to Cyrillic ones; of several with one image the first stands for it."""
    out: dict[str, str] = {}
    for c, latin in to_latin.items():
        if latin:
            out.setdefault(latin, c)
    return out


@dataclass(frozen=True)
class Tables:
    """The three tables. ``proven`` says that replacing SEQUENCES in their order equals a greedy scan for the longest."""

    decorated: dict[str, str] = field(default_factory=lambda: DECORATED)
    to_latin: dict[str, str] = field(default_factory=lambda: TO_LATIN)
    lookalikes: dict[str, str] = field(default_factory=lambda: LOOKALIKES)
    proven: bool = True

    @property
    def to_cyrillic(self) -> dict[str, str]:
        return TO_CYRILLIC | {latin: c for latin, c in SEQUENCES} if self.proven else _to_cyrillic(self.to_latin)

    @classmethod
    def from_strings(cls, decorated: str, lookalikes: str, translit: str | None = None) -> Tables:
        """From JSON: groups of character to character; letter to list of variants; ``cyrillic_to_latin`` with character
        to string. Only the first character of a folded form and of its image counts. Without the third no letter is
        transliterated. Raises ValueError where a table is malformed."""
        try:
            fold = {k[0]: v[0] for group in json.loads(decorated).values() for k, v in group.items() if k and v}
            alike = {v[0]: letter[0] for letter, variants in json.loads(lookalikes).items() for v in variants if v and letter}
            latin = {k[0]: v for k, v in json.loads(translit)["cyrillic_to_latin"].items() if k} if translit is not None else {}
        except (AttributeError, KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"malformed character table: {e}") from e
        return cls(fold, latin, alike, proven=False)

    @classmethod
    def from_dir(cls, path: str | Path) -> Tables:
        """From unicode_mappings.json, homoglyphs.json and transliteration.json of a folder on the driver."""
        read = lambda name: (Path(path) / name).read_text(encoding="utf-8-sig")
        return cls.from_strings(read("unicode_mappings.json"), read("homoglyphs.json"), read("transliteration.json"))


BUILT_IN = Tables()
