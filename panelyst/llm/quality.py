"""Quality scores by compression: a text resembles the class whose dictionary makes it smaller.

Two zstandard dictionaries are built from good and bad labelled text. A text is compressed in short chunks, each by
itself, so that every part of it is measured against the dictionaries and not against the part before. The
difference of the two sizes, normalised by their sum, is turned into a probability by a logistic curve, together with
how far the whole text compresses without a dictionary (a text that repeats itself is small under either one).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelyst.llm.batches import by_bytes, temporary, with_text_columns
from panelyst.session import written

CHUNK = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 1
#: Labelled rows that the model is fitted on, for each class; their texts are whole.
SAMPLE_ROWS = 4000
#: Chunks that a class's dictionary is built from, drawn from the whole texts of half of those rows, and how many of a
#: long text count like those of a short one.
SAMPLE_PIECES = 12000
SAMPLE_CHUNKS = 6
#: A line that so many sample rows share marks copies, not quality; it stays out of the dictionaries.
SHARED_LINES = 3
#: Added to the sizes' sum: a few bytes of difference say little on a very short text.
SHRINK = 40
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _compressors(good: bytes, bad: bytes):
    import zstandard

    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    out = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=words, **options))
    return out[0], out[1], zstandard.ZstdCompressor(**options)


def _features(texts: list[str | None], good, bad, alone) -> np.ndarray:
    """A row for each text: 1, normalised difference, own compressibility, compressibility with the dictionaries."""
    rows = np.zeros((len(texts), 4))
    rows[:, 0] = 1
    for row, text in enumerate(texts):
        data = (text or "").encode()
        if not data.strip():
            continue
        a = b = 0
        for chunk in _chunks(data):
            a += len(good.compress(chunk))
            b += len(bad.compress(chunk))
        own = len(alone.compress(data)) / len(data)
        rows[row, 1:] = 10 * (b - a) / (a + b + SHRINK), 5 * min(own, 0.6), 5 * min((a + b) / 2 / len(data), 1)
    return rows


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, rounds: int = 40) -> np.ndarray:
    """Newton's method; the penalty also keeps separable classes finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * len(y) * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def _dictionary(parts: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\n" * 8


def sample_labelled(docs: DataFrame, labels: DataFrame, trains: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, label, text`` of at most ``rows`` documents a class: those whose ids hash lowest, whatever the table's size.

    ``trains`` is a condition on ``doc_id``. A document with both labels counts as bad, and the least text of a
    repeated id counts. Texts are whole; null and blank ones say nothing and are left out, as are null ids and labels.
    Written once to the shared folder.
    """
    once = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & trains)
    once = once.groupBy("doc_id").agg(F.min("quality").alias("label"))
    ids = [
        once.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)
    ]
    chosen = ids[0].unionByName(ids[1]).withColumnRenamed("doc_id", "chosen_id")  # at most 2 * rows: bounded
    found = docs.where(F.col("text").rlike(r"\S")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    return written(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def _own_text(sample: DataFrame, builds: Column) -> DataFrame:
    """The dictionary half without the lines that SHARED_LINES documents of the sample have; one row a document."""
    lines = F.split("text", "\n")
    common = sample.select(F.explode(F.array_distinct(lines)).alias("line")).groupBy(F.xxhash64("line").alias("shared"))
    common = common.agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_LINES).select("shared")
    rows = sample.where(builds).select("doc_id", "label", F.posexplode(lines).alias("at", "line"))
    rows = rows.join(common, F.xxhash64("line") == F.col("shared"), "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return rows.groupBy("doc_id", "label").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def _lowest_chunks(batches):
    """Of each class the SAMPLE_PIECES chunks with the lowest keys in the partition.

    A chunk's key is a hash, times how often its document has more than SAMPLE_CHUNKS chunks: every place of a text
    can be drawn, and a long text counts about as much as SAMPLE_CHUNKS chunks.
    """
    import heapq

    import xxhash

    kept: dict[int, list[tuple[float, bytes]]] = {}
    for batch in by_bytes(batches, "text"):
        for doc_id, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            parts = _chunks(text.encode())
            heap = kept.setdefault(label, [])
            for i, part in enumerate(parts):
                key = xxhash.xxh64_intdigest(f"{doc_id}:{i}") / 2**64 * max(1, len(parts) / SAMPLE_CHUNKS)
                (heapq.heappush if len(heap) < SAMPLE_PIECES else heapq.heappushpop)(heap, (-key, part))
    for label, heap in kept.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(heap), pa.int32()), pa.array([-k for k, _ in heap]), pa.array([c for _, c in heap], pa.binary())],
            names=["label", "key", "chunk"],
        )


def _parts(sample: DataFrame, builds: Column, label: int) -> list[bytes]:
    """What a class's dictionary is built from: at most SAMPLE_PIECES chunks reach the driver."""
    own = _own_text(sample, builds & (F.col("label") == label)).select("doc_id", F.col("label").cast("int"), "text")
    chunks = own.mapInArrow(_lowest_chunks, "label int, key double, chunk binary")
    return [bytes(r["chunk"]) for r in chunks.orderBy("key", "chunk").limit(SAMPLE_PIECES).collect()]


def fit(sample: DataFrame) -> QualityModel:
    """Dictionaries from one half of the sample, the curve from the other half, which they have not seen.

    The second half is scored by the executors, whole texts like any other; a few numbers a row come back. With a
    class missing, every score is the share of good labels (0.5 without labels).
    """
    builds = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    counted = {(r["label"], r["half"]): r["n"] for r in sample.groupBy("label", builds.alias("half")).agg(F.count("*").alias("n")).collect()}
    if any(counted.get((k, half), 0) == 0 for k in (0, 1) for half in (True, False)):
        bad, good = (sum(n for (label, _), n in counted.items() if label == k) for k in (0, 1))
        share = (good + 1) / (good + bad + 2)
        return QualityModel(b"\n" * 8, b"\n" * 8, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    good, bad = (_dictionary(_parts(sample, builds, k)) for k in (1, 0))

    def make():
        tools = _compressors(good, bad)
        return lambda texts: [pa.array(list(_features(texts, *tools)), pa.list_(pa.float64()))]

    rest = with_text_columns(sample.where(~builds), make, [("x", "array<double>")], keep=["doc_id", "label"])
    rows = sorted(rest.collect(), key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    return QualityModel(good, bad, tuple(map(float, _logistic(x, y))))


def _scorer(model: QualityModel):
    tools = _compressors(model.good, model.bad)
    weights = np.array(model.weights)
    return lambda texts: 1 / (1 + np.exp(-np.clip(_features(texts, *tools) @ weights, -30, 30)))


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row: 0 to 1, higher where a good label is likelier.

    Null, empty and blank texts have nothing to compress and get the curve's value at no difference. Repeated rows
    and null ids give a row each. Other columns are not read.
    """

    def make():
        score = _scorer(model)

        def run(texts):
            found = score(texts)
            return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

        return run

    return with_text_columns(docs, make, [("score", "double"), ("predicted", "int")], keep=["doc_id"])


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text reaches ``threshold``.

    Null, empty and blank texts are judged like in ``quality_scores``; repeated rows stay or go together.
    """
    score = temporary("score")

    def make():
        found = _scorer(model)
        return lambda texts: [pa.array(found(texts))]

    return with_text_columns(docs, make, [(score, "double")]).where(F.col(score) >= threshold).drop(score)
