"""Token counts: encode batches of texts, return lengths only.

Texts travel in Arrow batches balanced by bytes. A long text is cut at safe boundaries, so the library never holds the
ids of more than ``PART_CHARS`` characters of it, and the parts' counts add up to the count of the whole text.

A boundary is safe for a piece vocabulary in which white space only begins a piece: at one space between two other
characters no merge can cross, and the next part, without that space, gets it back as the library's own dummy prefix.
``piece_counter`` reads the vocabulary and cuts nothing if a piece breaks that rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelyst.llm.batches import with_text_columns

PART_CHARS = 1 << 16
#: One ASCII space between ASCII letters or digits, where no normalisation rule applies either.
SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
SPACE = "▁"


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe spaces, which are left out; a stretch without one stays whole.

    >>> parts("ab cd ef", 4)
    ['ab cd', 'ef']
    """
    out, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def piece_counter(path: str, most: int = PART_CHARS) -> Callable[[list[str | None]], np.ndarray]:
    """Counts of whole texts by a sentencepiece model, nulls as empty texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    cut = all(SPACE not in p.lstrip(SPACE) for i, p in enumerate(vocabulary) if plain(i))
    # The dummy prefix has to stand for the space that a cut leaves out.
    cut = cut and model.encode("a", out_type=str)[:1] == model.encode("b a", out_type=str)[-1:]

    def count(texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        todo: list[str] = []
        rows: list[int] = []
        held = 0

        def flush() -> None:
            np.add.at(out, rows, [len(ids) for ids in model.encode(todo, num_threads=1)])

        for row, text in enumerate(texts):
            if not text:
                continue
            for part in parts(text, most) if cut else [text]:
                todo.append(part)
                rows.append(row)
                held += len(part)
                if held >= 1 << 20:  # ids of a megabyte of text at a time
                    flush()
                    todo, rows, held = [], [], 0
        if todo:
            flush()
        return out

    return count


def json_counter(path: str) -> Callable[[list[str | None]], np.ndarray]:
    """Counts by a tokenizers file: whole texts, no special tokens added, no truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def count(texts: list[str | None]) -> np.ndarray:
        found = model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return np.array([len(x) for x in found], np.int64)

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096, *, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, by the tokenizer file at ``path``.

    ``path`` is opened on the executors, where the vocabulary is installed. Null and empty texts have 0 bytes and 0
    tokens. Repeated rows and null ids give a row each; other columns are not read. An empty table gives no rows.
    """

    def make():
        counter = piece_counter(path, part_chars) if path.endswith(".model") else json_counter(path)

        def run(texts):
            tokens = counter(texts)
            sizes = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            return [pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]

        return run

    fields = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    return with_text_columns(docs, make, fields, keep=["doc_id"])
