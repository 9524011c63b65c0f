"""Alignment of two tokenizers over the same texts.

The ends of a text's tokens, in bytes, are two ascending lists. Their intersection tells where both tokenizers cut; it
is found by galloping: each end of the shorter list is looked up in the longer one by doubling steps and a binary
search between the last two, starting at the place of an earlier end. All ends of a batch of texts gallop at once.
The common ends slice both token lists into groups; the ranks of a token's start and end in the other list give the
range of tokens that it overlaps.

How often two ids end together is counted over all texts: each batch counts its own pairs, Spark adds them up, and the
totals go back to the batches that hold them, as one small table for each batch and never as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelyst.llm.batches import by_bytes
from panelyst.llm.packing import byte_encoder
from panelyst.llm.tokens import SPACE
from panelyst.session import written

#: A space with something else on both sides.
_SINGLE = re.compile(rf"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
#: Ends that gallop from one common place.
STRIDE = 16
#: Text bytes whose pairs are counted together, and of which the ends gallop together.
CHUNK_BYTES, GALLOP_BYTES = 8 << 20, 1 << 18


@dataclass(frozen=True)
class Tokenizer:
    """``encode``: the ids of a text; ``pieces``: the bytes of every id; ``lossless``: they always give the text's bytes."""

    encode: Callable[[str], np.ndarray]
    pieces: list[bytes]
    lossless: bool


def byte_level(json_path: str, ranks_path: str | None = None) -> Tokenizer:
    """A byte-level vocabulary, of the texts with a space before them."""
    import tokenizers

    vocabulary = tokenizers.Tokenizer.from_file(json_path).get_vocab(with_added_tokens=True)
    # The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for text, at in vocabulary.items():
        pieces[at] = bytes(of[c] for c in text) if all(c in of for c in text) else text.encode()
    one = byte_encoder(json_path, ranks_path, None, special=False)
    with open(json_path) as file:
        rewritten = json.load(file)["normalizer"]
    return Tokenizer(lambda text: one(f" {text}"), pieces, rewritten is None and all(bytes([b]) in pieces for b in of.values()))


class _Words(dict):
    """Ids of words, as bytes, each encoded once; a bounded number of them is held."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return found


def piece_level(path: str, most_words: int = 1 << 18) -> Tokenizer:
    """A sentencepiece vocabulary that puts a space before each text itself.

    Where white space only begins pieces and characters are not rewritten, no merge crosses a single space: the words
    between such spaces are encoded one by one, each getting back its space, and words that repeat only once.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    pieces = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(count)
    ]
    plain = (model.id_to_piece(i) for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    cut = all(SPACE not in p.lstrip(SPACE) for p in plain) and model.encode("a", out_type=str)[:1] == model.encode("b a", out_type=str)[-1:]
    every = "".join(map(chr, [*range(0x21, 0xD800), *range(0xE000, 0x110000)]))
    cut = cut and model.normalize(every) == SPACE + every
    words = _Words(model.encode, most_words)

    def encode(text: str) -> np.ndarray:
        if not cut:
            return np.array(model.encode(text), "<u4")
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            found = _SINGLE.split(text)
        else:
            found = text.split(" ")
        return np.frombuffer(b"".join(map(words.__getitem__, found)), "<u4")

    return Tokenizer(encode, pieces, False)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` (ascending) its rank in ``long`` (ascending): how many of ``long`` are less.

    Every STRIDE-th target gallops from the rank of the one before it at the next coarser stride, the others from the
    rank of their stride's first, so steps are few wherever the lists advance together.
    """
    if not len(short) or not len(long):
        return np.zeros(len(short), np.int64)
    if len(short) <= STRIDE:
        start = np.zeros(len(short), np.int64)
    else:
        start = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)]
    low, step = start, np.ones(len(short), np.int64)
    # Double the step while the entry there is still less: low is always a lower bound of the rank.
    active = np.arange(len(short))
    low = low.copy()
    high = np.full(len(short), len(long), np.int64)
    while len(active):
        probe = low[active] + step[active] - 1
        inside = probe < len(long)
        less = inside.copy()
        less[inside] = long[probe[inside]] < short[active[inside]]
        done = active[~less]
        high[done] = np.minimum(low[done] + step[done] - 1, len(long))
        active = active[less]
        low[active] += step[active]
        step[active] *= 2
    # Binary search between the last two steps.
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = long[middle] < short[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


@dataclass(frozen=True)
class Alignment:
    """Of two lists of token ends over the same bytes: ``cut``, for each list the indices of the ends that both have;
    ``first, last``: for each token of the shorter list the range of the longer one's tokens that it overlaps."""

    cut: tuple[np.ndarray, np.ndarray]
    first: np.ndarray
    last: np.ndarray


def align(a: np.ndarray, b: np.ndarray) -> Alignment:
    """Aligns two strictly ascending lists of ends whose last one is the same."""
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    last = gallop(short, long)
    both = long[last] == short
    # A token starts where the one before it ends: one further in the other list if that one ends there too.
    first = np.concatenate([[0], (last + both)[:-1]]).astype(np.int64)
    cut = np.flatnonzero(both), last[both]
    return Alignment(cut[::-1] if swapped else cut, first, last)


class Aligner:
    """Aligns batches of texts by two tokenizers."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.both = a, b
        self.sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in self.both]
        self.codes = len(b.pieces)
        # An id as it is written before another one of its list, and at the end of its side of a group.
        self.shown = [f"{i}{mark}" for t, end in ((a, "|"), (b, ";")) for mark in (",", end) for i in range(len(t.pieces))]

    def tokens(self, text: str | None) -> list[np.ndarray] | None:
        """Both id lists of a text; None if it is empty or either list does not give its bytes."""
        if not text:
            return None
        whole = f" {text}".encode()
        ids = [t.encode(text) for t in self.both]
        same = lambda t, own: t.lossless or b"".join(map(t.pieces.__getitem__, own.tolist())) == whole
        return ids if all(map(same, self.both, ids)) else None

    def groups(self, ids: list[np.ndarray], cut: list[np.ndarray]) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``, from the indices of their last tokens."""
        before = [np.concatenate([[0], last + 1]) for last in cut]  # tokens before each group, and all
        # A token goes as far back as the other list has tokens before it in the written order.
        skipped = before[1][:-1], before[0][1:]
        line = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        base = 0
        for side, own in enumerate(ids):
            code = own.astype(np.int64) + base
            code[cut[side]] += len(self.both[side].pieces)
            line[np.arange(len(own)) + np.repeat(skipped[side], np.diff(before[side]))] = code
            base += 2 * len(self.both[side].pieces)
        return "".join(map(self.shown.__getitem__, line.tolist()))[:-1]

    def batch(self, texts: list[str | None]) -> list[tuple]:
        """``n_a, n_b, n_groups, n_overlaps, groups_sha256`` and the codes of the linked pairs, for each text.

        Texts are aligned together, end to end: first all in which the first list is the shorter one, then the others.
        """
        none = np.zeros(0, np.int64)
        out: list[tuple] = [(0, 0, 0, 0, "", none)] * len(texts)
        found = [(row, ids) for row, ids in enumerate(map(self.tokens, texts)) if ids]
        for swapped in (False, True):
            mine = [x for x in found if (len(x[1][0]) > len(x[1][1])) == swapped]
            if not mine:
                continue
            ids = [np.concatenate([x[side] for _, x in mine]).astype(np.int64) for side in (0, 1)]
            stops = [np.cumsum([len(x[side]) for _, x in mine]) for side in (0, 1)]
            made = align(*(np.cumsum(size[own]) for size, own in zip(self.sizes, ids, strict=True)))
            pairs = ids[0][made.cut[0]] * self.codes + ids[1][made.cut[1]]
            spread = np.concatenate([[0], np.cumsum(made.last - made.first + 1)])
            start, done, lapped = [0, 0], 0, 0
            # Where a text ends both lists end, so a text's groups are a stretch of all groups.
            bounds = np.searchsorted(made.cut[0], stops[0] - 1) + 1
            for at, (row, own) in enumerate(mine):
                stop = [int(s[at]) for s in stops]
                upto, over = int(bounds[at]), int(spread[stop[1 if swapped else 0]])
                cut = [c[done:upto] - s for c, s in zip(made.cut, start, strict=True)]
                digest = hashlib.sha256(self.groups(own, cut).encode()).hexdigest()
                out[row] = (len(own[0]), len(own[1]), upto - done, over - lapped, digest, pairs[done:upto])
                start, done, lapped = stop, upto, over
        return out


_ROWS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, links binary, "
    "codes array<long>, counts array<long>"
)
_SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "n_overlaps long"
)


def _align_partition(batches: Iterator[pa.RecordBatch], make: Callable[[], Aligner], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each text; its links as places in the pairs of its chunk, which the chunk's first row holds."""
    aligner = None
    for number, batch in enumerate(by_bytes(batches, "text", chunk_bytes)):
        aligner = aligner or make()
        made = [m for part in by_bytes(iter([batch]), "text", GALLOP_BYTES) for m in aligner.batch(part.column(1).to_pylist())]
        codes, places, counts = np.unique(np.concatenate([m[5] for m in made]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(m[5]) for m in made])
        links = [p.astype("<i4").tobytes() for p in np.split(places, ends[:-1])]
        chunk = (TaskContext.get().partitionId() << 32) + number
        first = [True] + [False] * (len(made) - 1)
        columns = [pa.array([chunk] * len(made), pa.int64()), batch.column(0)]
        columns += [pa.array([m[at] for m in made], pa.int64()) for at in range(4)]
        columns += [pa.array([m[4] for m in made], pa.string()), pa.array(links, pa.binary())]
        columns += [pa.array([x if f else None for f in first], pa.list_(pa.int64())) for x in (codes, counts)]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ROWS.split(", ")])


def _score(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The texts of one chunk, by the totals of the chunk's pairs."""
    total, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
    at = found.column("place").to_numpy()
    total[at] = found.column("total").to_numpy()
    best[at] = found.column("best").to_numpy(zero_copy_only=False)
    links = [np.frombuffer(x, "<i4") for x in rows.column("links").to_pylist()]
    new = {
        "n_links": [len(x) for x in links], "n_best": [int(best[x].sum()) for x in links],
        "count_sum": [int(total[x].sum()) for x in links],
    }
    names = [f.split()[0] for f in _SCORED.split(", ")]
    return pa.table({n: pa.array(new[n], pa.int64()) if n in new else rows.column(n) for n in names})


def alignments(docs: DataFrame, make: Callable[[], Aligner], n_b: int, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps`` for every row of ``docs``.

    ``make()`` builds the aligner on the executors, ``n_b`` is the size of its second vocabulary. A link is a pair of
    tokens that end together; its count is how many links of all texts hold the same ids, and it is a best one if no
    other id has more links with its second id. ``n_overlaps``: pairs of tokens that share a byte. Null and empty
    texts, and texts that a vocabulary does not give back byte for byte, have no tokens: zeros and an empty digest.
    Repeated rows and null ids count each for itself; other columns are not read; no rows give no rows.

    Texts are encoded once; what they leave is written to the shared folder: four bytes a link, and the pairs of a chunk.
    """
    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_align_partition, make=make, chunk_bytes=chunk_bytes), _ROWS))
    pairs = rows.where("codes IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("codes", "counts")).alias("place", "pair"))
    pairs = pairs.select("chunk", "place", F.col("pair.codes").alias("code"), F.col("pair.counts").alias("n"))
    totals = written(pairs.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.pmod("code", F.lit(n_b))))
    # One row for each id of the second vocabulary.
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    judged = totals.join(F.broadcast(most), "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    found = pairs.join(judged, "code").select(F.col("chunk").alias("of"), "place", "total", "best")
    return rows.drop("codes", "counts").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_score, _SCORED)
