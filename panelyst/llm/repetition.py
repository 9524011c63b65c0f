"""Quality rules: repetition inside a text by a suffix array over its words, and a few counts.

The suffixes of all texts of a batch are sorted together by prefix doubling, where a word is told apart from the same
word of another text; only suffixes that are not yet unique are sorted again. The ranks of each doubling then give the
longest common prefix of neighbours. A suffix's longest repeat is the larger of its two neighbours' prefixes: the
intervals of common prefixes of at least ``min_words`` are the maximal repeated substrings, and the union of their
spans is what a text repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelyst.llm.batches import with_text_columns
from panelyst.llm.shingles import MIX_A, Shingler, _mixed

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, PERCENT_REPEATED = 50, 3, 50
#: Repeats of at least so many words count as repeated substrings; their union may cover three tenths of the words.
REPEAT_WORDS, MOST_COVERED, MOST_REPEAT = 16, 0.3, 100
BATCH_BYTES = 4 << 20


def longest_repeats(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word the length of the longest sequence from it on that occurs elsewhere in the same text.

    ``words``: hashes of all words; ``bounds``: each text's first word, and the end.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    key = _mixed(words + _mixed(doc.astype(np.uint64) + np.uint64(1)) * MIX_A)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # the first place of the class
    levels, width = [rank.astype(np.int32)], 1
    active = order
    while True:
        sizes = np.bincount(rank, minlength=n)
        active = active[sizes[rank[active]] > 1]
        if not len(active):
            break
        ahead = active + width
        # A suffix that ends before goes first, and each text's end is a place of its own.
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        active, pair = active[order], pair[order]
        old = rank[active]
        place = np.arange(len(active))
        first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        first_new = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), place, 0))
        rank = rank.copy()
        rank[active] = old + first_new - first_old
        width *= 2
        levels.append(rank.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (np.maximum(x, y) + (1 << j)) <= end[a]
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += np.where(fits & (levels[j][x] == levels[j][y]), 1 << j, 0)
    shared = np.zeros(n + 1, np.int64)
    shared[same + 1] = common  # with the suffix one place before
    out = np.empty(n, np.int64)
    out[suffixes] = np.maximum(shared[:-1], shared[1:])
    return out


def _covered(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text in the union of the spans that begin at each word with ``lengths``."""
    n = len(lengths)
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + lengths[at], -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(steps)[:n] > 0)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def repetition(
    docs: DataFrame, *, repeat_words: int = REPEAT_WORDS, most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT
) -> DataFrame:
    """A row for every row of ``docs``: ``doc_id``, counts, what the text repeats, and whether it stays.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (words in windows of three found twice),
    ``base_failed``, ``covered`` (fraction of words in repeats of ``repeat_words`` or more), ``longest_repeat`` (in
    words), ``kept``. Null and empty texts have no words, which fails the base rules. Repeated rows and null ids give
    a row each; other columns are not read; no rows give no rows.
    """

    def make():
        shingler = Shingler(lower=False)

        def run(texts):
            texts = [t or "" for t in texts]
            hashes, bounds = shingler.word_hashes(texts)
            n = np.diff(bounds)
            lengths = longest_repeats(hashes, bounds)
            windows = _covered(np.where(lengths >= WINDOW, WINDOW, 0), bounds)
            covered = _covered(np.where(lengths >= repeat_words, lengths, 0), bounds) / np.maximum(n, 1)
            longest = np.zeros(len(texts), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                longest[some] = np.maximum.reduceat(lengths, bounds[:-1][some])
            failed = (n < MIN_WORDS) | (100 * windows > PERCENT_REPEATED * n)
            kept = ~failed & (covered <= most_covered) & (longest <= most_repeat)
            chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
            symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
            return [
                pa.array(n), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()),
                pa.array([_repeated_lines(t) for t in texts], pa.int64()), pa.array(windows), pa.array(failed),
                pa.array(covered), pa.array(longest), pa.array(kept),
            ]

        return run

    fields = [
        ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
        ("base_failed", "boolean"), ("covered", "double"), ("longest_repeat", "long"), ("kept", "boolean"),
    ]
    return with_text_columns(docs, make, fields, keep=["doc_id"], most=BATCH_BYTES)
