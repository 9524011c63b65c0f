import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyst.llm import merkle
from panelyst.llm.catalogue import LEAF, op11_merkle

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


def test_layout_is_recursive_and_complete():
    for levels in range(1, 6):
        places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
    # Four levels: a top of two, then 64 trees of two, each in one stretch.
    assert [merkle.address(4, 2, i) for i in (0, 1, 63)] == [9, 18, 9 + 63 * 9]
    assert merkle.address(4, 3, np.arange(16)).tolist() == [*range(10, 18), *range(19, 27)]


def plain_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([SHA("".join(row[i : i + 8])) for i in range(0, len(row), 8)])
    return out


def plain_path(levels, i):
    path = []
    for row in levels[:-1]:
        first = i // 8 * 8
        path.append(("".join(row[first:i]), "".join(row[i + 1 : first + 8])))
        i //= 8
    return path


def plain(rows):
    """Every row's leaf, subroot, root, proof, folded root, from sorted lists."""
    def leaf(r, text):
        values = [r.doc_id, r.source, r.lang, r.n_chars, text]
        return SHA("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((-1 if r.doc_id is None else r.doc_id, leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            path = plain_path(trees[s], i) + plain_path(top, at)
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = SHA(left + folded + right)
            proof = SHA("".join(left + right for left, right in path))
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_plain_lists(spark, odd_docs, tmp_path, monkeypatch, height):
    """Nulls, repeated rows, clashing columns; with low blocks the levels of blocks recurse several times."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", height)
    more = spark.range(1000, 1700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"),
        F.when(F.col("id") % 3 > 0, F.lit("en")).otherwise(F.concat(F.lit("l"), F.col("id") % 100)).alias("lang"),
        F.lit("S").alias("source"), F.lit(3).cast("long").alias("n_chars"),
    )
    odd_docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_merkle(spark, str(tmp_path)).collect()]
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark, no_docs):
    leaf = F.sha2(merkle.record(*LEAF), 256)
    empty = merkle.manifest(no_docs, leaf, "lang", "doc_id")
    assert empty.root is None and merkle.proofs(empty).collect() == []
    one = merkle.manifest(no_docs.sparkSession.createDataFrame([(None,) * 9], no_docs.schema), leaf, "lang", "doc_id")
    row = merkle.proofs(one).first()
    assert one.root == row.leaf == row.subroot == SHA("-----") and row.path == []


def test_equal_ids_do_not_depend_on_the_stored_order(spark):
    rows = [(1, str(i)) for i in range(30)] + [(None, "x")] * 3
    roots = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(a, b, "g") for a, b in order], "doc_id long, text string, lang string")
        roots.add(merkle.manifest(docs, F.sha2(merkle.record("doc_id", "text"), 256), "lang", "doc_id").root)
    assert len(roots) == 1
