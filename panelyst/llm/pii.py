"""Personal data: exact patterns, and a linear-chain conditional random field for the forms they miss.

The patterns find emails, ip numbers, cards and phones in their plain forms. The field reads word shapes around
digits, @ signs and their spelled-out forms, is trained on a small labelled table, and adds spans (written-out mail
addresses, national phone numbers, cards with other separators). Its spans must hold what their kind needs, so that a
year or a version is not taken for a phone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyst.llm import crf
from panelyst.llm.batches import temporary, with_text_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Digit runs are taken whole: a match can only begin where its run does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


_DOT = r"(?:\s*[\[(]dot[\])]\s*|\s+dot\s+)"
#: A mail address with its @ or dots spelled out; the bare word "at" needs a spelled-out dot after it.
_SPELLED = re.compile(
    rf"(?i)[\w+-]+(?:(?:\.|{_DOT})[\w+-]+)*"
    rf"(?:(?:@|\s*[\[(]at[\])]\s*)[\w-]+(?:(?:\.|{_DOT})[\w-]+)+|\s+at\s+[\w-]+(?:{_DOT}[\w-]+)+)"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterable[Span]:
    """At each @: the run of name characters before it, no further back than the last match, and a dotted host."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _HOST.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start: leftmost, not overlapping within a kind, failing matches dropped."""
    out = list(_emails(text))
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def written_spans(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# --- the field -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]|_")
#: What a span must contain; text further from one than ``NEAR`` characters is not read by the field.
_TRIGGER = re.compile(r"[0-9@]|[\[(](?i:at)[\])]|\b(?i:dot)\b")
NEAR = 40
#: Longer stretches of digits and signs (tables, dumps) are decoded whole too, apart from the short ones.
LONG_TOKENS = 400
#: Bounds of a decoded batch: stretches, and tokens of long stretches with their padding.
MOST_STRETCHES, MOST_PADDED = 2000, 200_000
# Words that stand before or inside personal data.
WORDS = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial", "ring", "number", "cell"),
    "mail": ("mail", "email", "write", "contact", "reach"),
    "card": ("card", "visa", "charge", "mastercard"),
    "host": ("ip", "host", "server", "ping", "from"),
    "at": ("at",),
    "dot": ("dot",),
    "end": ("com", "org", "net"),
}
SIGNS = "@.,-+()[]/:_#%*$!=|\"'"
SHAPES = (
    "edge", "lower", "upper", "title", "mixed", "d1", "d2", "d3", "d4", "d5", "d7", "d10", "d16", "other",
    *(f"word {w}" for w in WORDS), *(f"sign {s}" for s in SIGNS),
)
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
_WORD = {w: _SHAPE[f"word {k}"] for k, words in WORDS.items() for w in words}
_AROUND = (-2, -1, 0, 1, 2)
#: Shape at each place around the token, crossed with whether white space comes before it, and the bias.
N_FEATURES = len(_AROUND) * len(SHAPES) * 2 + 1
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def _shape(token: str) -> int:
    if "0" <= token[0] <= "9":
        n = len(token)
        return _SHAPE[f"d{max(k for k in (1, 2, 3, 4, 5, 7, 10, 16) if k <= n)}"]
    if token[0].isalpha():
        if (w := _WORD.get(token.lower())) is not None:
            return w
        if token.islower():
            return _SHAPE["lower"]
        if token.isupper():
            return _SHAPE["upper"]
        return _SHAPE["title" if token.istitle() else "mixed"]
    return _SHAPE.get(f"sign {token}", _SHAPE["other"])


def _features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    shapes = np.array([_shape(text[a:b]) for a, b in tokens])
    spaced = np.array([a == 0 or text[a - 1].isspace() for a, _ in tokens])
    both = np.full(len(tokens) + 4, 2 * _SHAPE["edge"], np.int32)
    both[2:-2] = 2 * shapes + spaced
    columns = [both[2 + k : 2 + k + len(tokens)] + (k + 2) * 2 * len(SHAPES) for k in _AROUND]
    return np.stack([*columns, np.full(len(tokens), N_FEATURES - 1, np.int32)], axis=1)


def _forbidden() -> np.ndarray:
    """An inner label follows only its own kind."""
    n = len(LABELS)
    out = np.zeros((n, n), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            out[:, j] = [fro[2:] != to[2:] for fro in LABELS]
    return out


def parse_example(line: str) -> tuple[str, list[Span]]:
    """Text and spans of a line with marked personal data.

    >>> parse_example("to {phone:12 3} now")
    ('to 12 3 now', [('phone', 3, 7)])
    """
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def train(examples: Iterable[tuple[str, list[Span]]]) -> crf.Model:
    """The field, from a small table of texts and their spans; runs on the driver."""
    x, y = [], []
    for text, spans in examples:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        if not tokens:
            continue
        labels = np.zeros(len(tokens), np.int64)
        for kind, a, b in spans:
            inside = [i for i, (s, e) in enumerate(tokens) if a <= s and e <= b]
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[:1]] = LABELS.index(f"B-{kind}")
        x.append(_features(text, tokens))
        y.append(labels)
    return crf.train(x, y, N_FEATURES, len(LABELS), _forbidden())


def _segments(text: str) -> Iterable[list[tuple[int, int]]]:
    """Tokens of the stretches around triggers, each stretch whole."""
    start = end = -1
    stretches = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - NEAR), m.end() + NEAR
        if a > end:
            if end >= 0:
                stretches.append((start, end))
            start = a
        end = b
    if end >= 0:
        stretches.append((start, end))
    for a, b in stretches:
        while a > 0 and not text[a - 1].isspace() and a > 0 and b - a < 4 * NEAR:
            a -= 1
        yield [m.span() for m in _TOKEN.finditer(text, a, min(b, len(text)))]


def _holds(kind: str, found: str) -> bool:
    """What a span of the field needs to be taken for its kind."""
    digits = _digits(found)
    if kind == "email":
        return len(found) <= 100 and bool(_SPELLED.fullmatch(found))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", found)
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and "." in found
    separators = len(re.findall(r"[ ().-]+", found.strip()))
    return 7 <= len(digits) <= 15 and 1 <= separators <= 6 and not re.search(r"[^\W\d_]", found)


def field_spans(texts: list[str], model: crf.Model) -> list[list[Span]]:
    """The field's spans in each text, decoded in batches."""
    found: list[list[Span]] = [[] for _ in texts]
    short: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []
    long: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []

    def flush(waiting: list[tuple[int, list[tuple[int, int]], np.ndarray]]) -> None:
        for (row, tokens, _), labels in zip(waiting, crf.decode(model, [w[2] for w in waiting]), strict=True):
            if not labels.any():
                continue
            i = 0
            while i < len(tokens):
                if LABELS[labels[i]][0] != "B":
                    i += 1
                    continue
                kind, j = LABELS[labels[i]][2:], i + 1
                while j < len(tokens) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                a, b = tokens[i][0], tokens[j - 1][1]
                if _holds(kind, texts[row][a:b]):
                    found[row].append((kind, a, b))
                i = j
        waiting.clear()

    most = 0
    for row, text in enumerate(texts):
        for tokens in _segments(text) if text else ():
            if len(tokens) > LONG_TOKENS:
                most = max(len(tokens), most)
                if (len(long) + 1) * most > MOST_PADDED:
                    flush(long)
                    most = len(tokens)
                long.append((row, tokens, _features(text, tokens)))
            elif tokens:
                short.append((row, tokens, _features(text, tokens)))
            if len(short) >= MOST_STRETCHES:
                flush(short)
    flush(short)
    flush(long)
    # Long stretches come later than short ones of the same text.
    return [sorted(spans, key=lambda s: s[1]) for spans in found]


def all_spans(texts: list[str | None], model: crf.Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text its pattern spans, and all spans: the field adds those that touch none found before."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, field_spans(texts, model), strict=True):
        base = base_spans(text)
        spans = list(base)
        for kind, a, b in more:
            if all(b <= s or e <= a for _, s, e in base):
                spans.append((kind, a, b))
        out.append((base, spans))
    return out


def masked(text: str, spans: Iterable[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, model: crf.Model) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs``.

    Counts and hash are those of the patterns; ``spans`` holds all spans and ``n_added`` counts what the field added.
    Offsets are code points of the whole text. Null texts are empty. Repeated rows and null ids give a row each;
    other columns are not read; no rows give no rows.
    """

    def run(texts):
        found = all_spans(texts, model)
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS]
        hashes = [hashlib.sha256(written_spans(base).encode()).hexdigest() for base, _ in found]
        return [
            *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()),
            pa.array([written_spans(s) for _, s in found], pa.string()),
            pa.array([len(s) - len(b) for b, s in found], pa.int64()),
        ]

    fields = [*[(f"n_{k}", "long") for k in KINDS], ("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]
    return with_text_columns(docs, lambda: run, fields, keep=["doc_id"])


def mask(docs: DataFrame, model: crf.Model) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null, and ``n_chars``, if there, follows."""
    new = temporary("masked")

    def run(texts):
        found = all_spans(texts, model)
        return [pa.array([t if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())]

    out = with_text_columns(docs, lambda: run, [(new, "string")])
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(new).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).drop(new)
