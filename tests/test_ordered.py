"""The sliced plans must equal the plain window and a brute-force count."""

import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators import ordered


def _rows(groups, size, distinct):
    rng = random.Random(7)
    return [(g, f"E{i:05d}", float(rng.randrange(distinct))) for g in range(groups) for i in range(size)]


def _brute(rows, direction):
    sign = -1 if direction == "DESC" else 1
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((sign * v, e) for gg, e, v in rows if gg == g)
        values = [v for v, _ in mine]
        for at, (v, e) in enumerate(mine, 1):
            out[(g, e)] = (at, values.index(v) + 1, len(mine))
    return out


@pytest.mark.parametrize("direction", ["DESC", "ASC"])
@pytest.mark.parametrize("distinct", [1, 3, 500])
def test_sliced_rank_equals_brute_force(spark, monkeypatch, direction, distinct):
    rows = _rows(3, 400, distinct)
    df = spark.createDataFrame(rows, "g int, entity string, value double").repartition(3)
    expected = _brute(rows, direction)
    for bound in (None, 1):
        # The tiny window limit sends every group down the sliced plan.
        monkeypatch.setattr(ordered, "WINDOW_ROWS", 50 if bound is None else 10**6)
        out = ordered.rank_rows(
            df, ["g"], "value", direction=direction, competition="tied", rows_bound=bound, slices=7
        ).collect()
        assert {(r.g, r.entity): (r["rank"], r.tied, r.n) for r in out} == expected


@pytest.mark.parametrize("slice_rows", [None, 13, 64])
def test_prefix_counts(spark, slice_rows):
    rows = [(g, f"E{i:04d}", i + 1 if i < 200 else None, i % 3 == 0) for g in range(2) for i in range(230)]
    df = spark.createDataFrame(rows, "g int, entity string, r long, flag boolean").repartition(5)
    out = ordered.prefix_counts(
        df, ["g"], "r", {"above": F.col("flag")}, rows_bound=100, slice_rows=slice_rows
    ).collect()
    assert len(out) == len(rows)
    for row in out:
        expected = None if row.r is None else sum(1 for i in range(row.r) if i % 3 == 0)
        assert row.above == expected


def test_a_given_bound_is_trusted(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0)], "g int, entity string, value double")
    assert ordered.group_bound(df, ["g"], ordered.WINDOW_ROWS + 1) == ordered.WINDOW_ROWS + 1
    assert ordered.group_bound(df, ["g"], None) == 2


@pytest.mark.parametrize("slices", [1, 6, 11])
def test_both_plans_agree_on_nulls_ties_and_zeros(spark, slices):
    """Null values share a rank, runs of ties cross several slices, and -0.0 ties with 0.0."""
    values = [None] * 50 + [1.0] * 40 + [0.0, -0.0] * 15 + [3.0, 2.0]
    rows = [(g, f"E{i:05d}", v) for g in range(2) for i, v in enumerate(values)] + [(2, "only", None)]
    df = spark.createDataFrame(rows, "g int, entity string, value double").repartition(4)
    order = [F.col("value").desc(), F.col("entity").asc()]
    plain = ordered.rank_rows(df, ["g"], "value", competition="tied", rows_bound=1)
    sliced = ordered._rank_by_range(df, ["g"], "value", order, "tied", "rank", "n", 10**9, slices)
    key = lambda out: sorted((r.g, r.entity, r["rank"], r.tied, r.n) for r in out.collect())
    assert key(sliced) == key(plain)
    assert len({r.tied for r in plain.where("g = 0 AND value IS NULL").collect()}) == 1
