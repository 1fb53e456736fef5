"""Personal data by a semi-Markov conditional random field.

A text is looked at in regions: the words that hold a digit or "@", and what stands between them if it is one
character. No other word can lie in an entity, so the rest is outside whatever the weights. A region falls into atoms
(runs of letters and digits, single other characters). A segmentation tiles its atoms with entities of up to
MAX_ATOMS atoms and single outside atoms; each entity is scored as a whole (its shape, lengths, checksums, the word
before it), neighbouring segments by a transition weight, and dynamic programming over (end, type) picks the
boundaries and types together. Weights maximise the conditional likelihood, by the forward-backward algorithm, of
SENTENCES sentences that ``examples`` generates with known spans, entities and look-alikes mixed.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import _text as X

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
OUTSIDE = len(TYPES)
MAX_ATOMS = 16
SENTENCES = 1500
EPOCHS = 6
SPAN = "array<struct<start:int,end:int,type:string>>"

_ATOM = re.compile(r"\w+|[^\w\s]|\s+")
_CHUNK, _MARK = re.compile(r"\S+"), re.compile("[0-9@]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord(c) for c in "0123456789@"]] = True
_CUE = re.compile(r"(token|key|secret|password|passwd|pwd|api|auth|card|visa|tel|phone|call|fax|mobile|ip|host|mail|ssn|iban|account)\W{0,4}$", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}")
_EMAIL = re.compile(r"[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_RUN = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)


def _shape(span: str) -> str:
    out = []
    for m in _RUN.findall(span):
        c = m[0]
        out.append(f"{len(m)}" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c)
        out.append("," if c.isdigit() else "")
    return "".join(out)


def features(span: str, left: str, right: str) -> list[str]:
    """Features of a candidate entity as a whole; ``left``: up to 16 characters before it; ``right``: the next one."""
    digits = re.sub(r"\D", "", span)
    n = len(digits)
    others = len(span) - n
    shape = _shape(span)
    out = ["one", f"digits{min(n, 20)}", "shape " + (shape if len(shape) < 24 else "long")]
    out.append(f"others{min(others, 6)}")
    if "@" in span:
        out.append("email" if _EMAIL.fullmatch(span) else "at")
        out.append(f"dots{min(3, span.partition('@')[2].count('.'))}")
        # an address that could be longer on either side isn't whole
    ip = _IP.fullmatch(span)
    if ip:
        out.append("octets" if all(int(x) < 256 for x in ip.groups()) else "no octets")
    if span.isdigit():
        out.append(f"plain{min(n, 20)}")
        if n in (13, 14, 15, 16, 19):
            out.append("luhn" if _luhn(digits) else "no luhn")
    elif n == len(span) - span.count(" ") - span.count("-"):
        out.append(f"grouped{min(n, 20)} {span[0].isdigit()}")
        if 13 <= n <= 19:
            out.append("groups luhn" if _luhn(digits) else "groups no luhn")
    if _HEX.fullmatch(span) and n < len(span):
        out.append(f"hex{min(len(span) // 8, 5)}")
    elif span.isalnum() and 0 < n < len(span):
        out.append(f"mixed{min(len(span) // 8, 5)}")
    if _KEY.fullmatch(span):
        out.append("known key")
    if n >= 7 and re.fullmatch(r"[+(\d][\d\s().\-/]*\d", span):
        out.append(f"dial {span[0] if not span[0].isdigit() else 'd'} {min(n, 14)} {'(' in span} {span.count('(') == span.count(')')}")
    if re.fullmatch(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", span):
        out.append("iban")
    if re.fullmatch(r"(?:(?:19|20)\d\d[ -])+(?:19|20)\d\d", span):
        out.append("years")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", span):
        out.append("ssn")
    if re.fullmatch(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d", span):
        out.append("date")
    cue = _CUE.search(left)
    if cue:
        out.append("cue " + cue.group(1).lower())
    before, after = left[-1:], right[:1]
    out.append("after " + ("w" if before.isalnum() else "s" if before.isspace() or not before else before))
    out.append("before " + ("w" if after.isalnum() else "s" if after.isspace() or not after else after))
    return out


_BOUNDED = re.compile(r"[^\s@]+@[^\s@]+|(?=\D*\d)[\w-]{16,}|[A-Z]{2}\d{2}[A-Z0-9 ]{8,40}|(?=(?:\D*\d){7})[+(]*\d[\d\s().+/\-]*|\d+\.\d+\.\d+\.\d+")


def _atoms(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text)]


def _candidates(text: str, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first atom, atom after the last, span): what may be an entity. It starts with a word, "+" or "(", ends with a
    word, and is bounded: an address with "@", a run of 16 letters and digits or more, an IBAN's beginning, or digits
    with signs and spaces, at least seven of them or four groups with dots."""
    for i, (a, _) in enumerate(atoms):
        c = text[a]
        if not (c.isalnum() or c in "+(_"):
            continue
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            b = atoms[j - 1][1]
            d = text[b - 1]
            if not (d.isalnum() or d == "_"):
                continue
            span = text[a:b]
            if _BOUNDED.fullmatch(span):
                yield i, j, span


class Model:
    """``weights``: a row for each feature, a column for each type. ``jump``: [type before, type after]."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.jump = np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def scored(self, text: str, atoms: list[tuple[int, int]], left: str, right: str) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
        """(first atom, atom after the last, features, score of each type) of all candidates, by first atom."""
        for i, j, span in _candidates(text, atoms):
            a, b = atoms[i][0], atoms[j - 1][1]
            f = features(span, (left[max(0, len(left) + a - 16) :] if a < 16 else "") + text[max(0, a - 16) : a], text[b : b + 1] or right)
            s = np.zeros(OUTSIDE)
            for name in f:
                w = self.weights.get(name)
                if w is not None:
                    s += w
            yield i, j, f, s

    def segments(self, text: str, left: str, right: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str], np.ndarray]]]:
        atoms = _atoms(text)
        return atoms, list(self.scored(text, atoms, left, right))

    def best(self, text: str, left: str = "", right: str = "") -> list[tuple[int, int, str]]:
        """(start, end, type) of the entities of the best segmentation of a region.

        Linear in the region's atoms: scores are kept for MAX_ATOMS atoms ahead, and of each atom and type only the
        length of its segment and the type before it (two bytes).
        """
        atoms = _atoms(text)
        n, ring = len(atoms), MAX_ATOMS + 1
        score = np.full((ring, OUTSIDE + 1), -math.inf)
        size, kind = np.zeros((n + 1, OUTSIDE + 1), np.int8), np.zeros((n + 1, OUTSIDE + 1), np.int8)
        score[0, OUTSIDE] = 0.0
        segments = self.scored(text, atoms, left, right)
        ahead = next(segments, None)
        for i in range(n):
            here = score[i % ring].copy()
            score[i % ring] = -math.inf  # the row of atom i + ring from now on
            from_ = here + self.jump[:, OUTSIDE]
            k = int(from_.argmax())
            score[(i + 1) % ring, OUTSIDE] = from_[k]
            size[i + 1, OUTSIDE], kind[i + 1, OUTSIDE] = 1, k
            into = None
            while ahead is not None and ahead[0] == i:
                _, j, _, s = ahead
                if into is None:
                    into = here[:, None] + self.jump[:, :OUTSIDE]
                    k_all = into.argmax(axis=0)
                    into = into[k_all, np.arange(OUTSIDE)]
                value, row = into + s, score[j % ring]
                for t in np.flatnonzero(value > row[:OUTSIDE]):
                    row[t] = value[t]
                    size[j, t], kind[j, t] = j - i, k_all[t]
                ahead = next(segments, None)
        out = []
        j, t = n, int(score[n % ring].argmax())
        while j > 0:
            i, before = j - int(size[j, t]), int(kind[j, t])
            if t != OUTSIDE:
                out.append((atoms[i][0], atoms[j - 1][1], TYPES[t]))
            j, t = i, before
        return out[::-1]

    def learn(self, text: str, spans: list[tuple[int, int, str]], rate: float) -> None:
        """One ascent step on the log-likelihood of a segmentation."""
        atoms, segments = self.segments(text, "", "")
        n, m = len(atoms), OUTSIDE + 1
        alpha = np.full((n + 1, m), -math.inf)
        beta = np.full((n + 1, m), -math.inf)
        alpha[0, OUTSIDE] = 0.0
        beta[n] = 0.0
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(segments):
            ending[j].append(k)
            starting[i].append(k)
        for j in range(1, n + 1):
            alpha[j, OUTSIDE] = np.logaddexp.reduce(alpha[j - 1] + self.jump[:, OUTSIDE])
            for k in ending[j]:
                i, _, _, s = segments[k]
                alpha[j, :OUTSIDE] = np.logaddexp(alpha[j, :OUTSIDE], np.logaddexp.reduce(alpha[i][:, None] + self.jump[:, :OUTSIDE], axis=0) + s)
        for i in range(n - 1, -1, -1):
            beta[i] = self.jump[:, OUTSIDE] + beta[i + 1, OUTSIDE]
            for k in starting[i]:
                _, j, _, s = segments[k]
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.jump[:, :OUTSIDE] + s + beta[j, :OUTSIDE], axis=1))
        z = np.logaddexp.reduce(alpha[n])
        truth = {(a, b): TYPES.index(t) for a, b, t in spans}
        step = np.zeros_like(self.jump)
        for i, j, f, s in segments:
            p = np.exp(np.minimum(0, alpha[i][:, None] + self.jump[:, :OUTSIDE] + s + beta[j, :OUTSIDE] - z))
            step[:, :OUTSIDE] -= p
            g = -p.sum(axis=0)
            t = truth.get((atoms[i][0], atoms[j - 1][1]))
            if t is not None:
                g[t] += 1
            if np.abs(g).max() > 1e-4:
                for name in f:
                    w = self.weights.get(name)
                    if w is None:
                        w = self.weights[name] = np.zeros(OUTSIDE)
                    w += rate * g
        for i in range(n):
            step[:, OUTSIDE] -= np.exp(np.minimum(0, alpha[i] + self.jump[:, OUTSIDE] + beta[i + 1, OUTSIDE] - z))
        # transitions of the true segmentation
        ends = {a: (b, TYPES.index(t)) for a, b, t in spans}
        at, before = 0, OUTSIDE
        by_start = {a: k for k, (a, _) in enumerate(atoms)}
        by_end = {b: k + 1 for k, (_, b) in enumerate(atoms)}
        while at < n:
            a = atoms[at][0]
            now = OUTSIDE
            if a in ends and ends[a][0] in by_end:
                now, nxt = ends[a][1], by_end[ends[a][0]]
            else:
                nxt = by_start[a] + 1
            step[before, now] += 1
            at, before = nxt, now
        self.jump += rate * step


def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated regions with their entities."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeionrstlédhmcu") for _ in range(r.randint(2, 9)))

    def email() -> str:
        local = r.choice([word(), f"{word()}.{digits(r.randint(1, 3))}", f"{word()}.{word()}", f"{word()}_{digits(2)}", f"{word()}{digits(2)}", f"{word()}+{word()}", f"{word()}-{word()}"])
        return f"{local}@{r.choice([word(), f'{word()}{digits(1)}', f'{word()}-{word()}'])}.{r.choice(['', word() + '.', 'example.'])}{r.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk', 'io'])}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{digits(r.randint(1, 2))} ({a}) {b}-{c}"] * 3 + [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {c}", f"+{digits(1)}-{a}-{b}-{c}", f"+{digits(11)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"0{digits(2)} {digits(4)} {c}"])

    def secret() -> str:
        hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
        return r.choice([hexes(40)] * 4 + [hexes(32), hexes(64), hexes(40).upper(), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "sk-" + "".join(r.choice("abcdefghijkABCDEFGH0123456789") for _ in range(24)), "ghp_" + "".join(r.choice("abcdefghijkABCDEFGH0123456789") for _ in range(36))])

    def checked(start: str, k: int, right: bool) -> str:
        """A number of k digits whose check digit is right, or isn't."""
        body = start + digits(k - 1 - len(start))
        return body + r.choice([c for c in "0123456789" if _luhn(body + c) == right])

    def card() -> str:
        # a number in groups is taken for a card even if a digit is wrong
        grouped = r.choice([checked("", 16, True), checked("", 16, True), digits(16)])
        return r.choice([checked("", 16, True)] * 4 + [r.choice(" -").join(grouped[k : k + 4] for k in range(0, 16, 4))] * 3 + [checked("3", 15, True)])

    make = {
        "EMAIL": email,
        "PHONE": phone,
        "IP": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "CARD": card,
        "SECRET": secret,
        "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "IBAN": lambda: r.choice(["DE", "FR", "ES", "GB", "NL"]) + digits(2) + r.choice(["", " "]).join(["", *(digits(4) for _ in range(r.randint(3, 5)))]),
    }
    decoy = [
        lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.", lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 9)}.", lambda: digits(r.randint(1, 8)),
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2099)}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}",
        lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: f"@{word()}", lambda: f"{word()}{digits(r.randint(1, 3))}", lambda: f"{r.randint(1900, 2030)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}",
        lambda: f"{digits(3)}x{digits(3)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{r.randint(300, 999)}.{r.randint(300, 999)}.{digits(3)}.{digits(3)}", lambda: f"{word()}@", lambda: f"{digits(9)}", lambda: f"{digits(10)}", lambda: f"{digits(2)}-{digits(2)}", lambda: f"#{digits(5)}", lambda: checked("", 16, False), lambda: checked("", r.choice([13, 14, 15, 16, 19]), False), lambda: f"{digits(22)}",
        lambda: r.choice(" -").join(str(r.randint(1900, 2030)) for _ in range(r.randint(2, 6))), lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            if text:
                text += r.choice([" ", " ", ", ", "\n", f" {word()} ", ". "])
            text += r.choice(["", "", "", f"{word()} ", f"{word()}.", "("])
            if r.random() < 0.7:
                kind = r.choice(TYPES)
                span = make[kind]()
                if r.random() < 0.1 and kind in ("EMAIL", "SECRET"):
                    span = span.upper()
                if kind == "EMAIL" and text.endswith("."):
                    text += " "
                cue = {"SECRET": ['token = "', "api_key=", "secret: ", "", "password: "], "PHONE": ["tel ", "", "", "phone: "], "CARD": ["card ", "", "", ""], "IP": ["ip ", "", "", "host "], "SSN": ["ssn ", ""], "IBAN": ["iban ", ""], "EMAIL": ["mail ", "", "", "<"]}[kind]
                c = r.choice(cue)
                if c and text and text[-1].isalnum():
                    text += " "
                text += c if r.random() < 0.9 else c.upper()
                spans.append((len(text), len(text) + len(span), kind))
                text += span + r.choice(['"', "", "", "", ".", ",", "!!", "###", "***", ")", "%%%", ">"])
            else:
                text += r.choice(decoy)() + r.choice(["", "", ".", ",", "!!", "***"])
        out.append((text, spans))
    return out


@cache
def train(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model fitted to ``examples``; the same for the same arguments."""
    model, data = Model(), examples(n, seed)
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        for text, spans in data:
            model.learn(text, spans, 0.1 / (1 + epoch))
    return model


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring words with a digit or "@", one character at most between them, however long."""
    begin = end = None
    for m in _CHUNK.finditer(text):
        if not _MARK.search(text, m.start(), m.end()):
            continue
        if begin is None:
            begin, end = m.span()
        elif m.start() - end <= 1:
            end = m.end()
        else:
            yield begin, end
            begin, end = m.span()
    if begin is not None:
        yield begin, end


def find(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all entities of a text, in characters."""
    out = []
    for a, b in regions(text):
        for s, e, t in model.best(text[a:b], text[max(0, a - 16) : a], text[b : b + 1]):
            out.append((a + s, a + e, t))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its type in brackets."""
    out, at = [], 0
    for a, b, t in spans:
        out += [text[at:a], f"[{t}]"]
        at = b
    return "".join([*out, text[at:]])


def _triggered(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a digit or "@"."""
    data, off = X.raw(texts)
    run = np.concatenate(([0], np.cumsum(_TRIGGER[data])))
    return run[off[1:]] > run[off[:-1]]


def _redacted(texts: pa.Array, model: Model) -> tuple[list, list]:
    """(redacted text, spans) of each text."""
    out, spans = texts.to_pylist(), [[] for _ in range(len(texts))]
    for k in np.flatnonzero(_triggered(texts)):
        spans[k] = find(model, out[k])
        out[k] = redact(out[k], spans[k])
    return out, spans


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, "text", 1 << 20):
                texts, spans = _redacted(piece.column("text"), shared.value)
                shown = [None if t is None else [{"start": a, "end": b, "type": y} for a, b, y in s] for t, s in zip(texts, spans, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string()), pa.array(shown, kind)], names=["doc_id", "text", "spans"])

    return run


def redacted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row: the text with personal data replaced, and where it stood, in characters.

    A null text has nulls, an empty or clean one is as it was with no spans. A long text is looked at whole: time is
    linear in it. Of segmentations of one score the one found first, with the shorter entity first, stands. Null ids
    stay null, repeated rows and texts under one id are each treated, an empty table gives an empty one, and other
    columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_apply(shared), f"doc_id long, text string, spans {SPAN}")


def replace_in(docs: DataFrame, model: Model | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with redacted texts and their lengths, every other column and row as it was; see ``redacted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in X.slices(batch, text_col, 1 << 20):
                texts, _ = _redacted(piece.column(text_col), shared.value)
                cols = [pa.array(texts, piece.schema.field(text_col).type) if n == text_col else piece.column(n) for n in piece.schema.names]
                yield pa.RecordBatch.from_arrays(cols, names=piece.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
