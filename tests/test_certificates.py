import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators import ordered, verify
from panelyst.operators.certificates import certify

SCHEMA = "g string, entity string, key double, rank long"


def _ranked(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for g in ("x", "y"):
        order = sorted(((float(rng.randrange(6)), f"E{i:03d}") for i in range(n)), key=lambda r: (-r[0], r[1]))
        rows += [[g, e, k, i + 1] for i, (k, e) in enumerate(order)]
        rows += [[g, f"N{i}", 1.0, None] for i in range(5)]
    return rows


def _bad(spark, rows, slice_rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(4)
    out = certify(df, ["g"], "rank", F.col("key"), "ok", {"odd": F.col("entity").endswith("1")}, rows_bound=1000, slice_rows=slice_rows)
    got = out.collect()
    assert len(got) == len(rows)
    return {r.g for r in got if not r.ok}, got


@pytest.mark.parametrize("slice_rows", [None, 1, 7, 60, 100])
def test_right_ranks_hold_and_counts_run_along(spark, slice_rows):
    bad, got = _bad(spark, _ranked(1), slice_rows)
    assert bad == set()
    for g in ("x", "y"):
        line = sorted((r for r in got if r.g == g and r["rank"]), key=lambda r: r["rank"])
        assert [r.odd for r in line] == [sum(x.entity.endswith("1") for x in line[: i + 1]) for i in range(len(line))]
    assert all(r.odd is None for r in got if r["rank"] is None)


@pytest.mark.parametrize("slice_rows", [None, 1, 7, 20, 60])
@pytest.mark.parametrize("at", [1, 7, 8, 20, 21, 59])
def test_wrong_ranks_do_not_hold(spark, slice_rows, at):
    """Swapped neighbours, a gap, a doubled rank, a changed key: wherever they lie, also at the edges of slices."""
    def swapped(rows):
        a, b = (next(r for r in rows if r[0] == "x" and r[3] == k) for k in (at, at + 1))
        a[3], b[3] = b[3], a[3]

    def gap(rows):
        for r in rows:
            r[3] = r[3] + 1 if r[0] == "x" and r[3] and r[3] > at else r[3]

    def doubled(rows):
        next(r for r in rows if r[0] == "x" and r[3] == at + 1)[3] = at

    def key(rows):
        next(r for r in rows if r[0] == "x" and r[3] == at + 1)[2] = 99.0

    for change in (swapped, gap, doubled, key):
        rows = _ranked(2)
        change(rows)
        assert _bad(spark, rows, slice_rows)[0] == {"x"}, change


def test_verification_ranks_nothing_again():
    assert not hasattr(verify, "rank_rows") and ordered.WINDOW_ROWS > 0
