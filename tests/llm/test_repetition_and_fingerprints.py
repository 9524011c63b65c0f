import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from panelyst.llm import fingerprints, repetition
from panelyst.llm.shingles import Shingler

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def test_longest_repeats_against_all_pairs():
    rng = random.Random(15)
    for _ in range(150):
        texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        words, bounds = Shingler(lower=False).word_hashes(texts)
        assert repetition.longest_repeats(words, bounds).tolist() == [x for t in texts for x in plain_repeats(t.split())]


def test_counts_against_plain_ones(odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in repetition.repetition(docs).collect():
        text = texts[r.doc_id]
        w = WORD.findall(text)
        seen, marked = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            marked |= {i + k for i in at if len(at) > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and failed)
    assert repetition.repetition(odd_docs).count() == odd_docs.count()
    assert repetition.repetition(no_docs).collect() == []


def test_verdicts(spark):
    rng = random.Random(16)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    part, long = fresh(30), fresh(120)
    rows = [
        (1, fresh(300)), (2, part + " " + fresh(60) + " " + part), (3, fresh(1000) + long + fresh(1000) + " " + long),
        (4, fresh(200) + " " + part + " " + fresh(200) + " " + part),
    ]
    got = {r.doc_id: r for r in repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert abs(got[2].covered - 60 / got[2].n_words) < 0.02 and got[2].longest_repeat == 30


def test_fingerprint_is_a_homomorphism(spark):
    units = ["One sentence.\n", "Another one!", "A third line\n"]
    rows = [(1, "".join(units)), (2, "".join(reversed(units))), (3, units[0]), (4, "".join(units[1:])), (5, ""), (6, None), (7, units[0] * 2)]
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    mod = 1 << fingerprints.LANE_BITS
    total = lambda *ids: [sum(x) % mod for x in zip(*(got[i].lanes for i in ids), strict=True)]
    assert got[1].fingerprint == got[2].fingerprint and got[5].fingerprint == got[6].fingerprint
    assert total(3, 4) == got[1].lanes and total(3, 3) == got[7].lanes and got[7].n_units == 2
    frame = spark.createDataFrame([(got[1].n_units, got[1].lanes, got[3].n_units, got[3].lanes)], "n long, a array<int>, m long, b array<int>")
    n, lanes = fingerprints.combined(F.col("n"), F.col("a"), F.col("m"), F.col("b"), -1)
    assert frame.select(fingerprints.written(n, lanes).alias("x")).first().x == got[4].fingerprint
    assert len({r.fingerprint for r in got.values()}) == 5


def test_units_cover_the_text(spark, odd_docs):
    joined = odd_docs.where("text IS NOT NULL").select("text", F.array_join(fingerprints.units(F.col("text")), "").alias("again"))
    assert joined.where("text != again").count() == 0


def test_likeness_follows_shared_units(spark):
    rng = random.Random(17)
    unit = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) + ".\n"
    errors = []
    for k in range(40):
        own = [unit() for _ in range(60)]
        shared = rng.randrange(61)
        other = own[:shared] + [unit() for _ in range(60 - shared)]
        errors.append((k, "".join(own), "".join(other), shared / (120 - shared)))
    frame = spark.createDataFrame(errors, "k long, a string, b string, want double")
    one = fingerprints.vector_sums(frame, ["k", "want"], "a")
    two = fingerprints.vector_sums(frame, ["k"], "b").select("k", F.col("n").alias("m"), F.col("lanes").alias("b"))
    near = fingerprints.likeness(F.col("n"), F.col("lanes"), F.col("m"), F.col("b"))
    off = np.array([r.near - r.want for r in one.join(two, "k").select(near.alias("near"), "want").collect()])
    assert abs(off.mean()) < 0.05 and off.std() < 0.12


def edited(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(ordered):
        n = len(t) // 4
        out[d] = (len(t), hashlib.sha256((t[: len(t) - n] + ordered[(i + 1) % len(ordered)][1][:n]).encode()).hexdigest())
    return out


def test_edited_texts(spark, odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL OR text IS NOT NULL").dropDuplicates(["doc_id"])
    want = edited([(r.doc_id, r.text or "") for r in docs.collect()])
    for group_rows in (3, 1000):
        rows = fingerprints.edited_fingerprints(docs, group_rows=group_rows).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want and len(rows) == len(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_repeated_ids_single_rows_and_none(spark, odd_docs, no_docs):
    assert fingerprints.edited_fingerprints(odd_docs, group_rows=4).count() == odd_docs.count()
    assert fingerprints.edited_fingerprints(no_docs).collect() == []
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    nulls = spark.createDataFrame([(None, "abcd"), (None, "abcd")], "doc_id long, text string")
    assert [r.near_next for r in fingerprints.edited_fingerprints(nulls).collect()] == [1.0, 1.0]


def test_native_plan(odd_docs):
    plan = fingerprints.edited_fingerprints(odd_docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
