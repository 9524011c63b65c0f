import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelyst.llm import wavelet
from panelyst.llm.catalogue import byte_encoder, op13_token_files


def library_ids(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, wavelet.BLOCK_BITS, wavelet.BLOCK_BITS * 2 + 7])
@pytest.mark.parametrize("top", [1, 2, 300, 50257])
def test_matrix_against_the_plain_list(n, top):
    rng = np.random.default_rng(n + top)
    ids = np.minimum(rng.zipf(1.3, n) - 1, rng.integers(0, top, n)).astype(np.uint32)
    lengths = [n // 2, n - n // 2]
    shard = wavelet.Shard(wavelet.shard_bytes([None, 7], lengths, ids, part=3, first=9))
    matrix = shard.matrix
    assert shard.doc_ids == [None, 7] and shard.lengths.tolist() == lengths and shard.header["part"] == 3
    assert matrix.tokens().tolist() == ids.tolist()
    places = rng.integers(0, n, 300)
    assert matrix.access(places).tolist() == ids[places].tolist()
    for token in {0, 1, top - 1, top, 70_000, *rng.choice(ids, 5).tolist()}:
        at = np.flatnonzero(ids == token)
        upto = np.concatenate([[0, n], places])
        assert matrix.rank(token, upto).tolist() == np.searchsorted(at, upto).tolist()
        assert matrix.count(token) == len(at)
        if len(at):
            assert matrix.select(token, np.arange(len(at))).tolist() == at.tolist()


@pytest.mark.parametrize("shard_tokens", [50, 1 << 22])
def test_documents_and_lookups(spark, odd_docs, tmp_path, shard_tokens):
    """Nulls, repeated rows, long texts, clashing columns; shards within tasks and across them."""
    folder = f"file:{tmp_path}/shards"
    wrote = wavelet.write_shards(odd_docs, byte_encoder, folder, shard_tokens=shard_tokens, task_bytes=100_000)
    rows = odd_docs.collect()
    ids = [np.array([*library_ids(r.text), 0], "<u4") for r in rows]
    got = wavelet.read_documents(spark, folder).orderBy("start").collect()
    want = Counter((r.doc_id, len(i), zlib.crc32(i.tobytes()), int((i == 0).sum())) for r, i in zip(rows, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.n_end) for r in got) == want
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    files = {r.file: r.tokens for r in wrote.collect()}
    assert {f for f in os.listdir(f"{tmp_path}/shards") if f.endswith(wavelet.SUFFIX)} == set(files)
    assert sum(files.values()) == sum(map(len, ids))
    tokens = [0, 1169, 50256, 99_999]
    places = Counter((t, r.doc_id, int(at)) for r, i in zip(rows, ids, strict=True) for t in tokens for at in np.flatnonzero(i == t))
    assert Counter(map(tuple, wavelet.occurrences(spark, folder, tokens).collect())) == places
    counts = Counter(t for t, _, _ in places.elements())
    assert {r.token: r.n for r in wavelet.token_counts(spark, folder, tokens).collect()} == {t: counts[t] for t in tokens}


def test_no_rows(spark, no_docs, tmp_path):
    folder = f"{tmp_path}/shards"
    assert wavelet.write_shards(no_docs, byte_encoder, folder).collect() == []
    assert wavelet.read_documents(spark, folder).collect() == []
    assert wavelet.occurrences(spark, folder, [0]).collect() == []


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    for _ in range(2):
        wavelet._put(f"{tmp_path}/shards", "a.wvm", b"x")
    assert os.listdir(f"{tmp_path}/shards") == ["a.wvm"]


def test_the_query(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words! "), (F.col("id") % 7).cast("int")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    ids = [np.array([*library_ids("some words! " * (i % 7)), 0], "<u4") for i in range(300)]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(300)]
