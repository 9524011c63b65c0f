import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators import ordered, placing, rank
from panelyst.operators.ordered import rank_rows


def _rows(spark, seed):
    rng = random.Random(seed)
    rows = [(g, f"E{i:03d}", float(rng.choice([-2, -1, 0, 0.0, -0.0, 1, 2, 3]))) for g in ("x", "y", "z") for i in range(rng.randrange(1, 120))]
    return spark.createDataFrame(rows, "g string, entity string, value double").repartition(5), rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("broadcast", [True, False])
def test_counting_agrees_with_ordering(spark, monkeypatch, seed, broadcast):
    """Ties on both sides of a threshold, several thresholds in a group and groups without any."""
    if not broadcast:
        monkeypatch.setattr(placing, "BROADCAST_ROWS", 0)
    df, _ = _rows(spark, seed)
    few = df.where(F.col("entity").isin("E000", "E001", "E007", "E020", "E021") & (F.col("g") != "z"))
    got = placing.place(df, few, ["g"], "value", competition="shared")
    whole = rank_rows(df, ["g"], "value", competition="shared").join(few.select("g", "entity"), ["g", "entity"])
    columns = ["g", "entity", "value", "rank", "shared", "n"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_only_few_rows_are_ordered(spark):
    """No sort and no window over the many: they end in a partial count."""
    df, _ = _rows(spark, 9)
    plan = placing.place(df, df.where("entity = 'E000'"), ["g"], "value", few_bound=3)._jdf.queryExecution().optimizedPlan().toString()
    many = plan[plan.rindex("Union") :]
    assert "Window" not in many and "Sort" not in many
    assert "Window" in plan


def test_locate_refuses_neutral_metrics(spark):
    obs = spark.createDataFrame(
        [("a", "fx_official", 2000, 1.0), ("a", "total_current", 2000, 1.0), ("b", "total_current", 2000, 2.0), ("b", "inflation_cpi", 2000, 2.0),
         ("a", "inflation_cpi", 2000, 1.0), (None, "total_current", 2000, 9.0), ("c", "total_current", 2000, float("nan"))],
        "entity string, metric string, year int, value double",
    )
    got = {(r.metric, r["rank"], r.n) for r in rank.locate(obs, ["a"]).collect()}
    assert got == {(r.metric, r["rank"], r.n) for r in rank.level_rank(obs).where("entity = 'a'").collect()}
    assert rank.locate(obs, ["nobody"]).collect() == [] and ordered.BROADCAST_ROWS > 0
