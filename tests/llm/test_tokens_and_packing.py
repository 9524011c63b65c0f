import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelyst.llm import packing, tokens
from panelyst.llm.catalogue import byte_encoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTES)
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_parts_join_to_the_text():
    text = "ab cd! ef gh  ij kl mn"
    for most in range(1, len(text)):
        assert " ".join(tokens.parts(text, most)) == text


def test_counts_do_not_depend_on_cuts(spark, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for part in (7, 1000, tokens.PART_CHARS):
        got = tokens.token_counts(odd_docs, PIECES, 100, part_chars=part).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd_docs.collect()]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_json_counts(odd_docs):
    got = sorted(r.n_tokens for r in tokens.token_counts(odd_docs, BYTES).collect())
    assert got == sorted(len(i) for i in library_ids([r.text for r in odd_docs.collect()]))


def test_no_rows(no_docs):
    assert tokens.token_counts(no_docs, PIECES).collect() == []
    assert packing.pack(no_docs, byte_encoder).collect() == []


def test_both_encoders_agree_on_odd_text():
    encode = byte_encoder()
    rng = np.random.default_rng(3)
    pool = list("ab1 \n\t.'!é漢\U0001f600 　\u0085") + ["'s", "'ll", "<|endoftext|>", "  ", " \n "]
    texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(2000)]
    assert [encode(t).tolist()[:-1] for t in texts] == library_ids(texts)


@pytest.mark.parametrize("length,windows", [(64, 1), (64, 4), (1024, 32)])
def test_packing_round_trip(odd_docs, length, windows):
    rows = packing.pack(odd_docs, byte_encoder, length=length, open_windows=windows, merged_partitions=2).collect()
    docs = odd_docs.collect()
    ids = [[*i, 0] for i in library_ids([r.text for r in docs])]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    # Rows with one id are told apart by what they hold: every piece is one of its document's, and all are covered.
    of = defaultdict(list)
    for d, i in zip(docs, ids, strict=True):
        of[d.doc_id].append(i)
    for p in rows:
        assert any(
            len(i) == p.doc_tokens and zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            for i in of[p.doc_id]
        )
    assert sum(p.length for p in rows) == sum(map(len, ids))
    padding = sum(length - sum(p.length for p in s) for s in sequences.values())
    assert padding <= 0.02 * sum(map(len, ids)) + 4 * length


def test_a_window_is_best_fit():
    closed = []
    windows = packing.Windows(lambda w, done: closed.append([p[0] for p in w]), 10, 2, 1)
    ids = np.arange(10, dtype="<u4")
    windows.add("a", 0, ids[:6], 6)
    windows.add("b", 0, ids[:8], 8)
    windows.add("c", 0, ids[:2], 2)  # fits both, best beside b
    assert closed == [["b", "c"]]
    windows.add("d", 0, ids[:9], 9)
    windows.add("e", 0, ids[:5], 5)  # fits nowhere: d is filled up with its head
    assert closed == [["b", "c"], ["d", "e"], ["a", "e"]]


def test_order_and_null_ids_are_kept(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, byte_encoder).orderBy(F.col("length").desc()).collect()
    assert [(r.doc_id, r.length) for r in rows] == [(None, 4), (None, 1)]
