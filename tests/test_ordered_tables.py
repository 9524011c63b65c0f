"""Large groups are ranked and summed up over packed tables; their rows are never checkpointed."""

import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators import ordered, rank


def _frame(spark):
    rng = random.Random(4)
    rows = [(g, f"E{i:04d}", rng.choice([None, -1.0, 0.0, -0.0, 2.5, float(i)])) for g in ("x", "y", None) for i in range(150)]
    return spark.createDataFrame(rows, "g string, entity string, value double").repartition(3)


def _no_checkpoint(monkeypatch):
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", lambda *_, **__: pytest.fail("rows are checkpointed"))


@pytest.mark.parametrize("competition", [None, "tied"])
@pytest.mark.parametrize("slices", [1, 2, 9, 200])
def test_ranks_of_large_groups_need_no_checkpoint(spark, monkeypatch, competition, slices):
    """Nulls in keys and values, ties across slices; the plain window is the measure."""
    df = _frame(spark)
    key = lambda out: sorted(map(repr, out.collect()))
    plain = key(ordered.rank_rows(df, ["g"], "value", competition=competition, rows_bound=1))
    _no_checkpoint(monkeypatch)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 20)
    out = ordered.rank_rows(df, ["g"], "value", competition=competition, rows_bound=150, slices=slices)
    assert key(out) == plain and len(plain) == 450
    made = ordered.rank_rows(df, ["g"], F.col("value") * 2, competition=competition, rows_bound=150, slices=slices)
    assert key(made) == plain
    if not competition:
        assert "Window [row_number" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_value_that_is_made_is_not_kept(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 20)
    rows = [(f"E{i:02d}", m, 2000, float(i % 7)) for m in ("total_current", "inflation_cpi") for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, metric string, year int, value double")
    out = rank.level_rank(df, 40)
    assert out.columns == ["entity", "metric", "year", "value", "rank", "n"]
    for m, sign in (("total_current", -1), ("inflation_cpi", 1)):
        want = [e for _, e in sorted((sign * v, e) for e, k, _, v in rows if k == m)]
        assert [r.entity for r in out.where(F.col("metric") == m).orderBy("rank").collect()] == want


def test_facts_of_large_groups_need_no_checkpoint(spark, monkeypatch):
    df = _frame(spark).where("g IS NOT NULL")
    _no_checkpoint(monkeypatch)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 20)
    out = ordered.group_facts(df, ["g"], {"n": F.count("value")}, rows_bound=150, groups_bound=2).collect()
    held = {g: sum(r.value is not None for r in out if r.g == g) for g in ("x", "y")}
    assert len(out) == 300 and all(r.n == held[r.g] for r in out)
