"""The universe over many runs: stretches of runs, and what changed between any two."""

import random

from panelyst.operators import coverage as V


def history(spark, seed=5, runs=9, entities=60):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(1, 100), runs))
    held = {f"E{i:02d}": {r for r in ids if rng.random() < 0.6} for i in range(entities)}
    held["E00"], held["E01"], held["E02"] = set(ids), {ids[0], ids[-1]}, set(ids[:3])
    rows = [(r, e, False) for e, own in held.items() for r in own] + [(r, "WORLD", True) for r in ids] + [(ids[0], "E00", False)]
    return ids, held, spark.createDataFrame(rows, "run_id long, entity string, is_aggregate boolean").repartition(5)


def test_stretches_of_consecutive_runs(spark):
    ids, held, snapshots = history(spark)
    got = {}
    for r in V.universe_intervals(snapshots).collect():
        got.setdefault(r.entity, []).append((r.first_run, r.last_run))
    assert set(got) == {e for e, own in held.items() if own and own != set(ids)}
    for e, stretches in got.items():
        covered = [r for a, b in sorted(stretches) for r in ids if a <= r <= b]
        assert covered == sorted(held[e])
        firsts = {a for a, _ in stretches}
        assert all(ids[ids.index(a) - 1] not in held[e] for a in firsts if a != ids[0])


def test_changes_between_any_two_runs(spark):
    ids, held, snapshots = history(spark)
    asked = [(a, b) for a in ids for b in ids] + [(ids[0], ids[1]), (ids[0], 1000), (1000, ids[0])]
    pairs = spark.createDataFrame(asked, "from_run long, to_run long")
    rows = {(r.from_run, r.to_run, r.entity): r.change for r in V.universe_changes(snapshots, pairs).collect()}
    want = {
        (a, b, e): "added" if b in own else "removed"
        for a in ids for b in ids for e, own in held.items() if (a in own) != (b in own)
    }
    assert rows == want
    counts = {(r.from_run, r.to_run): (r.added, r.removed) for r in V.universe_change_counts(snapshots, pairs).collect()}
    assert set(counts) == set(asked) and counts[ids[0], 1000] == (0, 0)
    for (a, b), (added, removed) in counts.items():
        mine = [c for (x, y, _), c in want.items() if (x, y) == (a, b)]
        assert (added, removed) == (mine.count("added"), mine.count("removed"))


def test_one_run_or_none(spark):
    _, _, snapshots = history(spark)
    pairs = spark.createDataFrame([(1, 2)], "from_run long, to_run long")
    for few in (snapshots.limit(0), snapshots.where("run_id = (SELECT 1)")):
        assert V.universe_intervals(few).count() == 0 and V.universe_changes(few, pairs).count() == 0
        assert [tuple(r) for r in V.universe_change_counts(few, pairs).collect()] == [(1, 2, 0, 0)]
