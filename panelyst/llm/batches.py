"""Arrow batches of texts: balanced by bytes, with the other columns carried along."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Text bytes that one call of a text function gets at least, unless the partition ends; one more text may exceed it.
BATCH_BYTES = 8 << 20

TextFunction = Callable[[list[str]], list[pa.Array]]


def temporary(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about ``most`` bytes of ``text``.

    A long text alone fills a batch; many short ones share it. Batches of many long texts are cut, so memory
    follows ``most`` and the longest text, not the number of rows.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        start = 0
        for row, n in enumerate(lengths):
            size += n
            if size >= most:
                held.append(batch.slice(start, row + 1 - start))
                yield joined()
                held, size, start = [], 0, row + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield joined()


def with_text_columns(
    df: DataFrame,
    make: Callable[[], TextFunction],
    fields: list[tuple[str, str]],
    *,
    text: str = "text",
    keep: list[str] | None = None,
    most: int = BATCH_BYTES,
) -> DataFrame:
    """``keep`` (default: every column) and the columns that ``make()(texts)`` returns, row by row.

    ``make`` runs once a partition, so models load once. Null texts arrive as None. Kept columns may not have the
    names in ``fields``; callers that keep everything pass names from ``temporary``.
    """
    keep = df.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, text]))
    chosen = df.select(*[df[c] for c in carried])
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([chosen.schema[c] for c in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        function = make()
        for batch in by_bytes(chain([first], batches), text, most):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = function(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keep, *[n for n, _ in fields]])

    return chosen.mapInArrow(run, schema)
