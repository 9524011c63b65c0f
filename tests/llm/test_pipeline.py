import zlib
from collections import Counter

import corpus_pipeline
from panelyst.llm import mixing, pii
from panelyst.llm.catalogue import TARGET, byte_encoder, pii_model, quality_model
from panelyst.llm.quality import _scorer

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    from tests.llm.test_mixing_and_quality import deviations
    from tests.llm.test_neardup import plain_components
    from panelyst.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(path := f"{tmp_path}/{k}")
        results.append((docs, docs := spark.read.parquet(path)))
    (raw, good), (_, single), (_, masked), (_, mixed), (_, packed) = results
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    score = _scorer(quality_model(spark, SF))
    assert set(rows(good)) == {r.doc_id for r in raw.collect() if score([r.text])[0] >= 0.7}
    components = plain_components([(r.doc_id, r.text) for r in good.collect()])
    assert set(rows(single)) == {d for d, (_, c) in components.items() if c == d}
    model = pii_model()
    for d, r in rows(masked).items():
        assert r.text == pii.masked(rows(single)[d].text, pii.all_spans([rows(single)[d].text], model)[0][1])
        assert r.n_chars == len(r.text)
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, masked.collect()))
    assert deviations(mixing.mix(masked, TARGET).collect(), TARGET, mixing.BLOCK_ROWS) < 1
    encode = byte_encoder()
    want = {r.doc_id: len(encode(r.text)) for r in mixed.collect()}
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.length
        ids = encode(rows(mixed)[r.doc_id].text)[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    assert dict(got) == want


def test_packing_follows_the_written_order(spark, tmp_path):
    """Later files are larger, so that Spark reads them first."""
    rows = [(i, "word " * (20 + 20 * i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.option("compression", "none").parquet(path := f"{tmp_path}/t")
    back = spark.read.parquet(path)
    assert [r.doc_id for r in back.collect()] != [i for i, _ in rows]
    assert [r.doc_id for r in mixing.in_written_order(back).collect()] == [i for i, _ in rows]
    ends = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for r in corpus_pipeline.packing_stage(spark, back, SF).where("sequence_id < 1L << 62").collect():
        ends.setdefault(r.sequence_id >> 40, []).append(r.doc_id)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [ends[p] for p in sorted(ends)]
    assert len(parts) > 1 and all(max(a) < min(b) for a, b in zip(parts, parts[1:], strict=False))


def test_odd_rows(spark, odd_docs, no_docs):
    for rows in (odd_docs, no_docs):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
