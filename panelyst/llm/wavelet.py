"""Token ids on disk: documents in order, cut into shards, each a wavelet matrix in one compressed file.

A wavelet matrix stores a sequence bit by bit. The first plane holds the highest bit of every id; the ids are then
dealt stably, those with 0 before those with 1, the next plane holds the next bit in that order, and so on. With the
number of ones before each block of bits (rank), an id, the number of times an id occurs before a place, and the place
of its k-th occurrence all follow in one step a plane, without unpacking the rest.

A file is, in this order: ``MAGIC``; the length of the header in four bytes; the header as JSON; then the parts that
the header names, each compressed: the documents' ids, which of them are null, the documents' lengths, and for each
plane its bits in blocks, so that a lookup opens only the blocks it needs, and the ranks of the blocks' first bits.

Spark orders the documents, cuts them into tasks and shards, and reads the files back with its own file reader.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from panelyst.llm.batches import by_bytes, temporary

MAGIC, SUFFIX = b"WVM1", ".wvm"
#: A shard ends with the document that reaches this many ids. A longer document is a shard of its own.
SHARD_TOKENS = 1 << 22
#: Text bytes that one task orders and encodes.
TASK_BYTES = 64 << 20
#: Bits in a block: 8 KB, compressed alone.
BLOCK_BITS = 1 << 16
WORD_BITS = 64


def _kind(bits: int) -> type:
    """The smallest type that holds ids of so many bits."""
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Ids with access, rank and select. ``planes``: for each bit, highest first, its packed words."""

    def __init__(self, n: int, planes: list["Plane"]):
        self.n, self.planes = n, planes

    @staticmethod
    def build(ids: np.ndarray) -> "WaveletMatrix":
        top, planes = max(1, int(ids.max(initial=0)).bit_length()), []
        row = ids.astype(_kind(top))
        for bit in range(top - 1, -1, -1):
            ones = row & row.dtype.type(1 << bit) != 0
            planes.append(Plane.pack(ones))
            zeros, dealt = planes[-1].zeros, np.empty_like(row)
            np.compress(~ones, row, out=dealt[:zeros])
            np.compress(ones, row, out=dealt[zeros:])
            row = dealt
        return WaveletMatrix(len(row), planes)

    def _steps(self):
        return zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places ``at``."""
        place, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for bit, plane in self._steps():
            ones, before = plane.bit(place), plane.rank(place)
            out |= ones.astype(np.uint32) << np.uint32(bit)
            place = np.where(ones, plane.zeros + before, place - before)
        return out

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often ``token`` occurs before each place of ``at``."""
        if token >> len(self.planes):
            return np.zeros(len(at), np.int64)
        low, high = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for bit, plane in self._steps():
            low, high = plane.follow(low, token >> bit & 1), plane.follow(high, token >> bit & 1)
        return high - low

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of the occurrences ``k`` (from 0, each less than the count) of ``token``."""
        first = np.zeros(1, np.int64)
        for bit, plane in self._steps():
            first = plane.follow(first, token >> bit & 1)
        place = first[0] + np.asarray(k, np.int64)
        for bit, plane in reversed(list(self._steps())):
            place = plane.select(place - plane.zeros, True) if token >> bit & 1 else plane.select(place, False)
        return place

    def tokens(self) -> np.ndarray:
        """All ids: the planes' dealing undone, last plane first."""
        row = np.zeros(self.n, _kind(len(self.planes)))
        for bit, plane in reversed(list(self._steps())):
            ones, back = plane.bits(), np.empty_like(row)
            back[~ones], back[ones] = row[: plane.zeros], row[plane.zeros :] | row.dtype.type(1 << bit)
            row = back
        return row.astype(np.uint32)


class Plane:
    """One bit of every id. ``blocks(i)`` gives the words of block ``i``; ``ranks`` the ones before each block."""

    def __init__(self, n: int, zeros: int, ranks: np.ndarray, blocks: Callable[[int], np.ndarray]):
        self.n, self.zeros, self.ranks, self._blocks = n, zeros, ranks, blocks
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def pack(ones: np.ndarray) -> "Plane":
        words = np.zeros(-(-len(ones) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
        packed = np.packbits(ones, bitorder="little")
        words[: len(packed)] = packed
        rows = words.view("<u8").reshape(-1, BLOCK_BITS // WORD_BITS)
        counts = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return Plane(len(ones), len(ones) - int(ranks[-1]), ranks, rows.__getitem__)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a block, opened once, and the ones before each of them in the whole plane."""
        if i not in self.held:
            words = self._blocks(i)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.held[i] = words, self.ranks[i] + np.concatenate([[0], before[:-1]])
        return self.held[i]

    def _at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word that holds each place, and the ones before that word."""
        block, word = place // BLOCK_BITS, place % BLOCK_BITS // WORD_BITS
        words, before = np.zeros(len(place), np.uint64), np.zeros(len(place), np.int64)
        for i in np.unique(block):
            mine = block == i
            if i * BLOCK_BITS < self.n:
                held = self.block(int(i))
                words[mine], before[mine] = held[0][word[mine]], held[1][word[mine]]
            else:  # the place after the last bit, where that fills its block
                before[mine] = self.ranks[-1]
        return words, before

    def bit(self, place: np.ndarray) -> np.ndarray:
        return self._at(place)[0] >> (place % WORD_BITS).astype(np.uint64) & np.uint64(1) != 0

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        words, before = self._at(place)
        below = (np.uint64(1) << (place % WORD_BITS).astype(np.uint64)) - np.uint64(1)
        return before + np.bitwise_count(words & below)

    def follow(self, place: np.ndarray, one: int) -> np.ndarray:
        """Where the prefix up to each place goes in the next plane, for ids with this bit."""
        before = self.rank(place)
        return self.zeros + before if one else place - before

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The places of the ones (or zeros) number ``k``."""
        ranks = self.ranks if one else np.minimum(np.arange(len(self.ranks)) * BLOCK_BITS, self.n) - self.ranks
        block, out = np.searchsorted(ranks, k, "right") - 1, np.zeros(len(k), np.int64)
        for i in np.unique(block):
            mine = np.flatnonzero(block == i)
            words, _ = self.block(int(i))
            bits = np.unpackbits(words.view(np.uint8), bitorder="little") == one
            out[mine] = i * BLOCK_BITS + np.flatnonzero(bits)[k[mine] - ranks[i]]
        return out

    def bits(self) -> np.ndarray:
        """The whole plane."""
        parts = [self._blocks(i).view(np.uint8) for i in range(len(self.ranks) - 1)]
        return np.unpackbits(np.concatenate(parts) if parts else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, **more: int) -> bytes:
    """A shard's file."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    parts = [
        press(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        press(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        press(np.array(lengths, "<i8").tobytes()),
    ]
    for plane in matrix.planes:
        parts.append(press(plane.ranks.astype("<i8").tobytes()))
        parts += [press(plane._blocks(i).tobytes()) for i in range(len(plane.ranks) - 1)]
    header = {
        "n": matrix.n, "documents": len(doc_ids), "zeros": [p.zeros for p in matrix.planes], "sizes": [len(p) for p in parts], **more,
    }
    told = json.dumps(header).encode()
    return b"".join([MAGIC, len(told).to_bytes(4, "little"), told, *parts])


class Shard:
    """A shard read from its file: ``header, doc_ids, lengths`` and the ``matrix``, whose blocks are opened when needed."""

    def __init__(self, content: bytes):
        import zstandard

        if content[:4] != MAGIC:
            raise ValueError("not a shard")
        stop = 8 + int.from_bytes(content[4:8], "little")
        self.header = json.loads(content[8:stop])
        ends = np.cumsum([stop, *self.header["sizes"]])
        opened = zstandard.ZstdDecompressor().decompress
        part = lambda i, kind: np.frombuffer(opened(content[ends[i] : ends[i + 1]]), kind)
        null = part(1, np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(part(0, "<i8"), null, strict=True)]
        self.lengths = part(2, "<i8")
        n = self.header["n"]
        each = -(-n // BLOCK_BITS)
        planes = []
        for at, zeros in enumerate(self.header["zeros"]):
            first = 3 + at * (each + 1)
            planes.append(Plane(n, zeros, part(first, "<i8"), lambda i, first=first: part(first + 1 + i, "<u8")))
        self.matrix = WaveletMatrix(n, planes)


def _filesystem(folder: str):
    """The file system of a folder that Spark knows by a URI, and the path on it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, content: bytes) -> None:
    """One file, whole or not at all: a task that runs twice replaces it by the same bytes."""
    from pyarrow import fs

    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(content)
    try:
        files.move(draft, f"{path}/{name}")
    except OSError:  # some stores do not replace a file
        if files.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise
        files.delete_file(draft)


_WRITTEN = "part long, shard long, file string, documents long, tokens long"


def _write_partition(batches: Iterator[pa.RecordBatch], make, folder: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    part, number, first = TaskContext.get().partitionId(), 0, 0
    doc_ids: list[int | None] = []
    held: list[np.ndarray] = []
    made: list[tuple] = []

    def close() -> None:
        nonlocal number, first
        name = f"{part:06d}-{number:06d}{SUFFIX}"
        ids = np.concatenate(held)
        _put(folder, name, shard_bytes(doc_ids, [len(x) for x in held], ids, part=part, first=first))
        made.append((part, number, name, len(doc_ids), len(ids)))
        number, first = number + 1, first + len(ids)
        doc_ids.clear()
        held.clear()

    encode, size = None, 0
    for batch in by_bytes(batches, "text"):
        encode = encode or make()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            held.append(encode(text))
            size += len(held[-1])
            if size >= shard_tokens:
                close()
                size = 0
    if held:
        close()
    if made:
        names = [f.split()[0] for f in _WRITTEN.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made])


def write_shards(
    docs: DataFrame, make: Callable[[], Callable[[str | None], np.ndarray]], folder: str, *,
    shard_tokens: int = SHARD_TOKENS, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Writes the ids of every row of ``docs`` into shard files in ``folder``; ``part, shard, file, documents, tokens``.

    ``make()`` returns the encoder of a text, ids with their end mark. Rows ascend by ``doc_id``, null ids first, rows
    of one id by their text's hash and then as they are stored; file names ascend with them. Null texts are empty ones;
    repeated rows are written each for itself; other columns are not read; no rows give no files. ``folder`` is one that
    every executor reaches. The returned table lies beside it, in ``folder`` + ``.written``.

    One shuffle deals the texts out by ranges; a task holds one shard and the batch of texts it encodes.
    """
    h, tie = temporary("h"), temporary("tie")
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    keys = ["doc_id", h, tie]
    # Rows alike in id and text get a number, so that no number of copies is more than a range.
    placed = rows.withColumns({h: F.xxhash64("text"), tie: F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select(F.col("doc_id").cast("long"), "text")
    made = placed.mapInArrow(partial(_write_partition, make=make, folder=folder, shard_tokens=shard_tokens), _WRITTEN)
    made.write.parquet(f"{folder}.written")
    return docs.sparkSession.read.schema(_WRITTEN).parquet(f"{folder}.written")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}")
    try:
        return files.load(folder).select("content")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "content binary")


def _over_shards(spark: SparkSession, folder: str, rows_of: Callable[[Shard], pa.Table], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from rows_of(Shard(content.as_py())).to_batches()

    return _files(spark, folder).mapInArrow(run, schema)


_DOCUMENTS = "part long, first long, doc_id long, at long, n_tokens long, ids_crc32 long, n_end long"


def _documents(shard: Shard, end_id: int) -> pa.Table:
    ids, stops = shard.matrix.tokens().astype("<u4"), np.cumsum(shard.lengths)
    starts = stops - shard.lengths
    ends = shard.matrix.rank(end_id, stops) - shard.matrix.rank(end_id, starts)
    n = len(stops)
    return pa.table({
        "part": pa.array([shard.header["part"]] * n, pa.int64()), "first": pa.array([shard.header["first"]] * n, pa.int64()),
        "doc_id": pa.array(shard.doc_ids, pa.int64()), "at": starts, "n_tokens": stops - starts,
        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)], pa.int64()),
        "n_end": ends,
    })


def read_documents(spark: SparkSession, folder: str, end_id: int = 0) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_end`` of every document in a folder of shards.

    ``start`` counts the ids of all documents before; ``n_end``, how often the end mark occurs, is asked of the planes.
    Only the totals of the tasks that wrote the files are added up in one place. No files give no rows.
    """
    found = _over_shards(spark, folder, partial(_documents, end_id=end_id), _DOCUMENTS)
    return found.join(_part_starts(spark, folder), "part").select(
        "doc_id", (F.col("before") + F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end"
    )


def _part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The ids before each writing task: a row for each of them."""
    sizes = spark.read.schema(_WRITTEN).parquet(f"{folder}.written").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))


def _found(shard: Shard, tokens: list[int]) -> pa.Table:
    stops = np.cumsum(shard.lengths)
    out = []
    for token in tokens:
        places = shard.matrix.select(token, np.arange(shard.matrix.count(token)))
        doc = np.searchsorted(stops, places, "right")
        ids = pa.array(shard.doc_ids, pa.int64()).take(pa.array(doc))
        out.append(pa.table({"token": pa.array([token] * len(places), pa.int64()), "doc_id": ids, "at": places - (stops - shard.lengths)[doc]}))
    return pa.concat_tables(out)


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token, doc_id, at``: every place in every document at which one of ``tokens`` stands, by rank and select."""
    return _over_shards(spark, folder, partial(_found, tokens=tokens), "token long, doc_id long, at long")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of ``tokens`` occurs in all shards, by rank alone."""
    def count(shard: Shard) -> pa.Table:
        return pa.table({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.matrix.count(t) for t in tokens], pa.int64())})

    return _over_shards(spark, folder, count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
