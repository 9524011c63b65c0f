"""Packing documents into fixed-length sequences: bounded-space best fit, then a merge of what stays open.

Each partition keeps a fixed number of open windows. A document's full-length pieces become sequences of their own;
the rest goes to the open window where it leaves the least space. If it fits nowhere, the fullest window is filled up
with the head of it (unless that would be a sliver) and emitted. What is open when a partition ends travels on with
its ids, a bounded number of windows a partition, and is merged over groups of partitions.

The rows that leave the partitions are short piece records, never texts.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelyst.llm.batches import by_bytes

LENGTH = 1024
OPEN_WINDOWS = 32
#: A gap shorter than this is padded rather than filled with a sliver of a document.
MIN_CUT = 4
#: Partitions whose open windows are merged in one task: at most this many times OPEN_WINDOWS windows of ids.
MERGED_PARTITIONS = 64

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, partition long, window long, "
    "offset long, ids binary"
)
_TWO_SPACES = re.compile(r"\s\s")
_LONG_WORD = re.compile(r"\S{2000}")


def byte_encoder(
    json_path: str, ranks_path: str | None = None, end_id: int | None = 0, special: bool = True
) -> Callable[[str | None], np.ndarray]:
    """Ids of a text as the tokenizers library gives them for ``json_path``, followed by ``end_id`` unless that is None.

    With ``special`` false, the strings of special tokens in a text are ordinary text.

    ``ranks_path`` names the same vocabulary as merge ranks: a several times faster encoder with equal ids then takes
    every text but those with very long words, where its time would grow with the square of the word.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.no_truncation()
    slow.no_padding()
    slow.encode_special_tokens = not special
    exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = {t.content: i for i, t in slow.get_added_tokens_decoder().items()} if special else {}
        # Without two spaces in a row the look-ahead never matters, and without it the pattern runs much faster.
        ahead = r"|\s+(?!\S)"
        assert ahead in public_tokenizers.PATTERN
        plain, full = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
            for name, pattern in (
                ("plain", public_tokenizers.PATTERN.replace(ahead, "")), ("full", public_tokenizers.PATTERN),
            )
        )

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.array([] if end_id is None else [end_id], "<u4")
        if not ranks_path or _LONG_WORD.search(text):
            ids = exact(text)
        else:
            ids = (full if _TWO_SPACES.search(text) else plain).encode_to_numpy(text, allowed_special="all")
        return (ids if end_id is None else np.append(ids, np.uint32(end_id))).astype("<u4", copy=False)

    return encode


def _piece(doc_id, start: int, ids: np.ndarray, total: int) -> list:
    return [doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, ids]


class Windows:
    """A fixed number of open windows; ``emit`` gets each window's pieces when it closes."""

    def __init__(self, emit: Callable[[list, bool], None], length: int, most: int, min_cut: int):
        self.emit, self.length, self.most, self.min_cut = emit, length, most, min_cut
        self.free: list[int] = []  # of the open windows, ascending
        self.held: list[list] = []  # their pieces, in the same order

    def _put(self, at: int, piece: list) -> None:
        free = self.free.pop(at) - piece[2]
        window = self.held.pop(at)
        window.append(piece)
        self._open(free, window)

    def _open(self, free: int, window: list) -> None:
        if free == 0:
            self.emit(window, True)
            return
        at = bisect.bisect_left(self.free, free)
        self.free.insert(at, free)
        self.held.insert(at, window)

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        """``ids``: a whole document or one piece of it, beginning ``start`` ids into it."""
        while len(ids) >= self.length:
            self.emit([_piece(doc_id, start, ids[: self.length], total)], True)
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect.bisect_left(self.free, len(ids))
            if at < len(self.free):
                return self._put(at, _piece(doc_id, start, ids, total))
            if len(self.free) < self.most:
                return self._open(self.length - len(ids), [_piece(doc_id, start, ids, total)])
            # None fits: the fullest goes, filled up unless that takes or leaves a sliver.
            gap = self.free[0]
            if gap >= self.min_cut and len(ids) - gap >= self.min_cut:
                self._put(0, _piece(doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            else:
                self.free.pop(0)
                self.emit(self.held.pop(0), True)

    def close(self, done: bool) -> None:
        for window in reversed(self.held):
            self.emit(window, done)
        self.free, self.held = [], []


def _rows(batch: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"ids": pa.binary()}
    columns = list(zip(*batch, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)


def _pack_partition(batches: Iterator[pa.RecordBatch], make, length: int, most: int, min_cut: int):
    names = [f.split()[0] for f in PIECES.split(", ")]
    out: list[tuple] = []
    encode = None
    number = 0
    here = TaskContext.get().partitionId()

    def emit(window: list, done: bool) -> None:
        nonlocal number
        offset = 0
        for doc_id, start, n, crc, total, ids in window:
            out.append((doc_id, start, n, crc, total, here, number if done else -1 - number, offset, None if done else ids.tobytes()))
            offset += n
        number += 1

    windows = Windows(emit, length, most, min_cut)
    for batch in by_bytes(batches, "text"):
        encode = encode or make()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text)
            windows.add(doc_id, 0, ids, len(ids))
            if len(out) >= 20_000:
                yield _rows(out, names)
                out.clear()
    windows.close(False)
    if out:
        yield _rows(out, names)


def pack(
    docs: DataFrame,
    make: Callable[[], Callable[[str | None], np.ndarray]],
    *,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``make()`` returns the encoder of a text, ids with their end mark. Every id of every row lies in exactly one piece
    and every sequence holds at most ``length`` ids, gapless from 0. Null texts are empty ones: just the end mark.
    Repeated rows and null ids are packed each for itself; other columns are not read; no rows give no pieces.

    The piece records are checkpointed once, so that closed and open windows come from the same run of each task even
    if executors are lost in between.
    """
    from panelyst.session import cut_lineage

    pieces = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: _pack_partition(batches, make, length, open_windows, min_cut), PIECES
        )
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # 23 bits for the partition (or merge group), 40 below for the window: ids are unique and never reused.
    closed = pieces.where("window >= 0").withColumn(
        "sequence_id", F.shiftleft(F.col("partition"), 40) + F.col("window")
    )

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("partition", "ascending"), ("window", "descending"), ("offset", "ascending")])
        group = table.column("group")[0].as_py()
        out: list[tuple] = []
        number = 0

        def emit(window: list, done: bool) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, n, crc, total, _ in window:
                out.append((doc_id, start, n, crc, total, (1 << 62) + (group << 40) + number, offset))
                offset += n
            number += 1

        rows = table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist()
        rows.sort(key=lambda r: -len(r["ids"]))
        windows = Windows(emit, length, open_windows, min_cut)
        for row in rows:
            windows.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
        windows.close(True)
        return pa.Table.from_batches([_rows(out, columns)])

    merged = (
        pieces.where("window < 0")
        .withColumn("group", F.floor(F.col("partition") / merged_partitions))
        .groupBy("group")
        .applyInArrow(merge, ", ".join(f"{c} long" for c in columns))
    )
    return closed.select(*columns).unionByName(merged)
