"""Language of words, spans and documents.

A word's script leaves the languages that are written in it; hashed letter trigrams score the word in each of those;
and a Viterbi pass over the document's words, with a penalty for every switch, labels spans of mixed-language text.
The language with most letters is the document's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelyst.llm.batches import by_bytes, with_text_columns

UND = "und"
GRAM_BITS = 16
#: Natural-log units that a switch of language costs; a single odd word does not pay for two switches.
SWITCH = 12.0
#: Documents that each language is learned from, about: ids whose hash falls into a share of the language's rows.
SAMPLE_DOCS = 2000
#: A language is written in a script if it makes up this share of its letters.
SCRIPT_SHARE = 0.005
MOST_LANGUAGES = 200
BATCH_BYTES = 4 << 20

# First code points of ranges of scripts (Unicode blocks); a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "han"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    grams: np.ndarray  # (languages, 2**GRAM_BITS), log probabilities
    written: np.ndarray  # (scripts, languages), whether a word in the script can be of the language


class Reader:
    """Words and hashed trigrams of a batch of texts."""

    def __init__(self):
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        self.letter = np.zeros(0x110000, bool)
        at = np.array(points, np.int32)
        for m in re.finditer(r"[^\W\d_]+", "".join(map(chr, points))):
            self.letter[at[m.start() : m.end()]] = True
        self.first = np.array([a for a, _ in SCRIPTS], np.uint32)
        self.script = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

    def read(self, texts: list[str | None]):
        """Word starts, ends, scripts; the trigram at each place; each text's first word and first code point.

        A word's trigrams stand at its letters and at the place after it. Letters are lower-cased one by one.
        """
        low = [self._lower(t) for t in texts]
        bounds = np.zeros(len(low) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in low], out=bounds[1:])
        points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        x = np.where(letter, points, np.uint32(32))
        before = np.concatenate([np.full(1, 32, np.uint32), x])[: len(x)]
        before2 = np.concatenate([np.full(2, 32, np.uint32), x])[: len(x)]
        before2 = np.where(before == 32, np.uint32(32), before2)
        gram = (x * np.uint32(0x9E3779B1)) ^ (before * np.uint32(0x85EBCA6B)) ^ (before2 * np.uint32(0xC2B2AE35))
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - GRAM_BITS)
        scripts = self.script[np.searchsorted(self.first, points[starts], side="right") - 1]
        return starts, ends, scripts, gram, np.searchsorted(starts, bounds), bounds

    @staticmethod
    def _lower(text: str | None) -> str:
        low = (text or "").lower()
        if text and len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        return low


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all words (letters and the place after), and where each word's places begin."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum()), first


def learn(docs: DataFrame, trains: Column, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from text and non-null lang of the rows that meet ``trains`` (a condition on doc_id).

    About ``sample_docs`` documents a language are read, whole. Only sums reach the driver: at most 2**GRAM_BITS a
    language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & trains)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel((), np.zeros((0, 0)), np.zeros((0, 0), bool))
    step = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // sample_docs))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), step[F.col("lang")]) == 0)

    def tally(batches):
        reader = Reader()
        sums: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                texts = [t for t, k in zip(batch.column(1).to_pylist(), langs, strict=True) if k == lang]
                starts, ends, scripts, gram, *_ = reader.read(texts)
                own = sums.setdefault(lang, np.zeros((1 << GRAM_BITS) + len(SCRIPT_NAMES), np.int64))
                if len(starts):
                    own[: 1 << GRAM_BITS] += np.bincount(gram[_places(starts, ends)[0]], minlength=1 << GRAM_BITS)
                    own[1 << GRAM_BITS :] += np.bincount(scripts, ends - starts, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "place", "n"]
            )

    sums = chosen.select("lang", "text").mapInArrow(tally, "lang string, place long, n long")
    got = sums.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(counts))
    table = np.zeros((len(languages), (1 << GRAM_BITS) + len(SCRIPT_NAMES)))
    row = {lang: i for i, lang in enumerate(languages)}
    table[[row[x] for x in got.column("lang").to_pylist()], got.column("place").to_numpy()] = got.column("n").to_numpy()
    grams = table[:, : 1 << GRAM_BITS] + 0.5
    scripts = table[:, 1 << GRAM_BITS :]
    usual = scripts.T >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1), 1)
    usual[~usual.any(axis=1)] = True  # a script that no language uses narrows nothing
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, logs, usual)


def best_path(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of all words: in each text (words ``bounds[i]`` to ``bounds[i + 1]``) the best path over ``scores``.

    Every label change costs ``switch``. All texts advance together, longest first. Ties stay, or take the lower label.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], bounds[:-1][order]
    out = np.zeros(len(scores), np.int16)
    if not len(sizes) or not sizes[0]:
        return out
    n = int((sizes > 0).sum())
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    stay = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    value = scores[first[:n]].astype(np.float64)
    for t in range(1, int(sizes[0])):
        k = live[t]
        now = value[:k]
        top = now.argmax(axis=1)
        most = now[np.arange(k), top][:, None] - switch
        at = first[:k] + t
        stay[at] = now >= most
        best[at] = top
        value[:k] = np.maximum(now, most) + scores[at]
    label = value.argmax(axis=1).astype(np.int16)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        out[at] = label[:k]
        label[:k] = np.where(stay[at, label[:k]], label[:k], best[at])
    return out


def word_scores(model: LanguageModel, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language that is written in its script; minus infinity elsewhere.

    Words of scripts with the same languages are scored together, and in those languages alone.
    """
    scores = np.full((len(starts), len(model.languages)), -np.inf, np.float32)
    candidates, alike = np.unique(model.written, axis=0, return_inverse=True)
    kind = alike.reshape(-1)[scripts]
    for group in np.unique(kind):
        rows = np.flatnonzero(kind == group)
        places, first = _places(starts[rows], ends[rows])
        found = gram[places]
        for k in np.flatnonzero(candidates[group]):
            scores[rows, k] = np.add.reduceat(model.grams[k][found], first)
    return scores


def _labelled(reader: Reader, model: LanguageModel, texts: list[str | None]):
    starts, ends, scripts, gram, words, bounds = reader.read(texts)
    return starts, ends, words, bounds, best_path(word_scores(model, starts, ends, scripts, gram), words)


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, n_switches`` for every row of ``docs``; only the text is read.

    ``score`` is the predicted language's share of the text's letters. Null texts and texts without a letter are
    ``und`` with score 0, as is everything under a model without languages. Ties take the first language by name.
    Repeated rows and null ids give a row each; no rows give no rows.
    """
    # Plain values: at most MOST_LANGUAGES * 2**GRAM_BITS numbers.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.written))

    def make():
        reader, own = Reader(), LanguageModel(*shared.value)

        def run(texts):
            n, kinds = len(texts), len(own.languages)
            if not kinds:
                return [pa.array([UND] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))]
            starts, ends, words, _, labels = _labelled(reader, own, texts)
            doc = np.repeat(np.arange(n), np.diff(words))
            letters = np.bincount(doc * kinds + labels, ends - starts, n * kinds).reshape(n, kinds)
            top, total = letters.argmax(axis=1), letters.sum(axis=1)
            change = (labels[1:] != labels[:-1]) & (doc[1:] == doc[:-1])
            score = letters[np.arange(n), top] / np.maximum(total, 1)
            names = [own.languages[k] if t else UND for k, t in zip(top, total, strict=True)]
            return [pa.array(names), pa.array(score), pa.array(np.bincount(doc[1:][change], minlength=n).astype(np.int64))]

        return run

    fields = [("lang_pred", "string"), ("score", "double"), ("n_switches", "long")]
    return with_text_columns(docs, make, fields, keep=["doc_id"], most=BATCH_BYTES)


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang, start, end``: the spans of each text in one language, in code points, from its first to its last letter.

    Null texts, texts without a letter and a model without languages give no rows; repeated rows give their spans each;
    an empty table gives no rows; other columns are not read.
    """
    # Plain values: at most MOST_LANGUAGES * 2**GRAM_BITS numbers.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.written))

    def make():
        reader, own = Reader(), LanguageModel(*shared.value)

        def run(texts):
            spans: list[list[dict]] = [[] for _ in texts]
            if own.languages:
                starts, ends, words, bounds, labels = _labelled(reader, own, texts)
                for row in range(len(texts)):
                    a, b = words[row], words[row + 1]
                    cuts = [a, *(a + 1 + np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1])).tolist(), b]
                    spans[row] = [
                        {"lang": own.languages[labels[i]], "start": int(starts[i] - bounds[row]), "end": int(ends[j - 1] - bounds[row])}
                        for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i
                    ]
            kind = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            return [pa.array(spans, pa.list_(kind))]

        return run

    out = with_text_columns(docs, make, [("spans", "array<struct<lang:string,start:long,end:long>>")], keep=["doc_id"], most=BATCH_BYTES)
    return out.select("doc_id", F.inline("spans"))
