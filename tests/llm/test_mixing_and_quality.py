import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelyst.llm import mixing, quality
from panelyst.llm.catalogue import fold


def deviations(rows, weights, block_rows):
    """The largest lag of any source still running, after any slot; blocks of each slot must be one source's."""
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    left, got, worst = Counter(s for s, _ in slots.values()), Counter(), 0.0
    base, start, active = Counter(), 0, set(left)
    for t in range(len(slots)):
        got[slots[t][0]] += 1
        total = sum(weights.get(s, 1) for s in active)
        worst = max([worst, *(abs(got[s] - base[s] - (t + 1 - start) * weights.get(s, 1) / total) for s in active)])
        if done := {s for s in active if got[s] == left[s]}:
            active, start, base = active - done, t + 1, Counter(got)
    return worst


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 2}, {"a": 1, "b": 1}, {"x": 7, "y": 5, "z": 11, "w": 1}, {"a": 9}])
def test_a_period_is_pfair(weights):
    slots = mixing.period(weights)
    total = sum(weights.values())
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, own in slots.items():
        for j, slot in enumerate(own, 1):
            assert (j - 1) * total // weights[s] <= slot < -(-j * total // weights[s])


@pytest.mark.parametrize("seed", range(60))
def test_a_pool_shares_a_period(seed):
    """The pool takes what is left, in runs, and every stream keeps its windows."""
    rng = random.Random(seed)
    named = {f"s{i}": rng.randrange(1, 12) for i in range(rng.randrange(1, 5))}
    pool = rng.choice([1, 2, 7, 40, 1000])
    slots = mixing.shared_period(named, pool)
    total = sum(named.values()) + pool
    taken = sorted(x for own in slots.values() for x in own)
    slots["pool"] = sorted(set(range(total)) - set(taken))
    assert len(taken) == len(set(taken)) and len(slots["pool"]) == pool
    for s, w in (named | {"pool": pool}).items():
        for j, slot in enumerate(slots[s], 1):
            assert (j - 1) * total // w <= slot < -(-j * total // w)


def test_thousands_of_sources(spark):
    """More sources than a driver should schedule: all share the pool, beside two named ones."""
    rng = random.Random(3)
    rows = [(i, f"d{rng.randrange(5000)}" if rng.random() < 0.8 else rng.choice("xy"), f"t{i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.mix(docs, {"x": 300, "y": 100}, block_rows=4).collect()
    assert len(got) == len({r.position for r in got}) == len(rows)
    slots = {r.slot: (r.source, r.block) for r in got}
    assert sorted(slots) == list(range(len(slots))) and len({v for v in slots.values()}) == len(slots)
    # In the first round of the pool each source stays within one block of its share.
    sources = {r.source for r in got}
    weights = {s: {"x": 300, "y": 100}.get(s, 1) for s in sources}
    total, first = sum(weights.values()), Counter()
    for t in range(1 + max(r.slot for r in got if r.source not in "xy" and r.block == 0)):
        first[slots[t][0]] += 1
        for s in ("x", "y", slots[t][0]):
            assert abs(first[s] - (t + 1) * weights[s] / total) < 1


def test_whole_tables_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    rng = random.Random(13)
    rows = [(i, rng.choices(["a", "b", "c", None], [60, 20, 19, 1])[0], f"t{i}") for i in range(400)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    for weights in ({"a": 1, "b": 5, "c": 2}, {None: 3}):
        got = mixing.mix(docs, weights, block_rows=4).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter(r[:2] for r in rows)
        assert len({r.position for r in got}) == len(rows)
        assert deviations(got, weights, 4) < 1
        assert max(Counter((r.source, r.block) for r in got).values()) == 4


def test_mixed_rows_come_in_order(spark, odd_docs):
    out = mixing.mixed(odd_docs, {"a": 2}, block_rows=2)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    numbered = out.select("source", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    first = [r.source for r in numbered[:8]]
    assert first.count("a") >= 2 and len(set(first)) > 1


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs, {}).count() == odd_docs.count()
    assert mixing.mix(no_docs, {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, {"a": 0})


def labelled(rng, n):
    good = lambda: " ".join(rng.choice("the a house tree walks slowly under green old with of".split()) for _ in range(80))
    bad = lambda: " | ".join(rng.choice("BUY NOW $$$ click HERE!! free ### win >>> cash".split()) for _ in range(80))
    return [((good, bad)[k](), 1 - k) for k in (rng.randrange(2) for _ in range(n))]


def test_quality_of_held_out_texts(spark, odd_docs, no_docs):
    rng = random.Random(14)
    rows = [(i, t, k) for i, (t, k) in enumerate(labelled(rng, 400))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k, 0) for i, _, k in rows] + [(1, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    sample = quality.sample_labelled(docs, labels, fold("doc_id", 4) != 2, rows=80)
    assert Counter(r.label for r in sample.collect()) == {0: 80, 1: 80}
    model = quality.fit(sample)
    scored = quality.quality_scores(docs, model).join(labels, "doc_id").where(fold("doc_id", 4) == 2)
    assert scored.where("quality IS NOT NULL AND predicted != quality").count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - sum(k for *_, k in rows)) <= 2
    odd = quality.quality_scores(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert quality.quality_scores(no_docs, model).collect() == []
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns


SAMPLE = "doc_id long, label int, text string"


def test_one_class_or_none(spark, odd_docs):
    for sample, share in (([], 0.5), ([(1, 1, "good text")], 2 / 3)):
        rows = quality.quality_scores(odd_docs, quality.fit(spark.createDataFrame(sample, SAMPLE))).collect()
        assert {round(r.score, 9) for r in rows} == {round(share, 9)}


def test_labelled_texts_are_whole(spark):
    long = "".join(chr(97 + i % 26) for i in range(1_000_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, " \n"), (4, None), (2, "shorter")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(2, 1)], "doc_id long, quality int")
    sample = {r.doc_id: (r.label, r.text) for r in quality.sample_labelled(docs, labels, F.lit(True)).collect()}
    assert sample == {1: (1, long), 2: (0, "short")}


def test_chunks_come_from_all_of_a_text(spark, monkeypatch):
    """Every chunk may be drawn, the fewest keys win whatever the partitions, and a long text counts like a short one."""
    monkeypatch.setattr(quality, "SAMPLE_PIECES", 40)
    short = [(i, 1, f"{i:04d} " * 600) for i in range(2, 30)]  # six chunks each
    long = "".join(f"{i:07d} " for i in range(64 * 2000))
    sample = spark.createDataFrame([(1, 1, long), *short, (99, 0, "other")], SAMPLE)
    got = [quality._parts(sample.repartition(n), F.lit(True), 1) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 40
    drawn = [c for c in got[0] if c in long.encode()]
    assert 0 < len(drawn) < 10
    whole = quality._parts(sample.where("doc_id = 1"), F.lit(True), 1)
    places = [int(c.split()[0]) for c in whole]
    assert min(places) < 32000 and max(places) > 96000


def test_lines_of_many_documents_stay_out_of_the_dictionaries(spark):
    rows = [(i, i % 2, f"every page\nown {i}\n\ntail {i}") for i in range(8)]
    own = quality._own_text(spark.createDataFrame(rows, SAMPLE).repartition(3), F.lit(True))
    assert {r.doc_id: r.text for r in own.collect()} == {i: f"own {i}\ntail {i}" for i in range(8)}


def test_scores_against_plain_compression(spark):
    """Each text compressed in chunks with either dictionary, the difference normalised, the curve by hand."""
    import zstandard

    rng = random.Random(15)
    rows = [(i, k, t) for i, (t, k) in enumerate(labelled(rng, 60))]
    model = quality.fit(spark.createDataFrame(rows, SAMPLE))
    texts = [(1, rows[0][2]), (2, rows[1][2] * 9), (3, "\u00fcber " * 300), (4, "x"), (5, ""), (6, None)]
    scored = {r.doc_id: r for r in quality.quality_scores(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}

    def size(data, words=None):
        extra = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        tool = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)
        return len(tool.compress(data))

    for doc_id, text in texts:
        x, data = [1.0, 0.0, 0.0, 0.0], (text or "").encode()
        if data:
            parts = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)]
            a, b = (sum(size(p, words) for p in parts) for words in (model.good, model.bad))
            x[1:] = 10 * (b - a) / (a + b + quality.SHRINK), 5 * min(size(data) / len(data), 0.6), 5 * min((a + b) / 2 / len(data), 1)
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(model.weights, x, strict=True))))))
        assert abs(scored[doc_id].score - want) < 1e-9 and scored[doc_id].predicted == (want >= 0.7)
