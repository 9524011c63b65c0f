"""Scans of a published table read only the folders and columns they need."""

import pytest

from panelyst.sources import scans
from panelyst.sources.tables import published

COLUMNS = "entity string, metric string, year int, value double, value_raw string, vintage string"


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(f"E{i % 7}", m, 2000 + i % 5, float(i), str(i), "v") for m in ("m", "n") for i in range(35)]
    return published(spark.createDataFrame(rows, COLUMNS).dropDuplicates(["entity", "metric", "year"]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_reader(obs):
    for df in (scans.point(obs, "m", "E1", 2001), scans.entity_series(obs, "m", "E1", 2000, 2002), scans.comparison_columns(obs, "m", 2000, 2002)):
        text = plan(df)
        partition = text[text.index("PartitionFilters") :].split("]")[0]
        pushed = text[text.index("PushedFilters") :].split("]")[0]
        assert "metric" in partition and "(year," in pushed
        assert df.count() > 0
    assert "(entity,E1)" in plan(scans.point(obs, "m", "E1", 2001))


def test_columns_reach_the_reader(obs):
    text = plan(scans.comparison_columns(obs, "m", 2000, 2002).select("entity", "year"))
    schema = text[text.index("ReadSchema") :].split(">")[0]
    assert "value_raw" not in schema and "vintage" not in schema


def test_nothing_is_lost(obs):
    assert obs.count() == 70 and obs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
