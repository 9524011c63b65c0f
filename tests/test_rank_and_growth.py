"""The hand-made edge panel: ties, zeros, missing years, aggregates and unknown codes."""

import pytest
from pyspark.sql import functions as F

from panelyst.operators import rank, yoy
from panelyst.sources import scans

VALUES = {
    "USA": {2002: 38000.111111, 2003: 40000.111111, 2004: 42000.222222, 2005: 43000.333333},
    "IND": {2003: 600.5, 2004: 700.75, 2005: 800.125},
    "BRA": {2003: 600.5, 2004: 800.25, 2005: 800.125},
    "CIV": {2004: 0.0, 2005: 0.0},
    "TUV": {2004: 2200.5},
    "PSE": {2004: 3373.5, 2005: 3500.25},
    "XKX": {2004: 5943.2, 2005: 6100.75},
    "WLD": {2004: 13313.8575826001, 2005: 13500.5},
    "HIC": {2004: 64354.5, 2005: 65100.25},
    "ZZZ": {2004: 999.5, 2005: 1000.5},
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(e, "nominal_current", y, v) for e, series in VALUES.items() for y, v in series.items()]
    rows.append(("  ", "nominal_current", 2004, 45545.9))
    obs = spark.createDataFrame(rows, "entity string, metric string, year int, value double")
    dim = spark.createDataFrame(
        [(e, f"Name {e}", e in ("WLD", "HIC")) for e in VALUES if e != "ZZZ"], "entity string, name string, is_aggregate boolean"
    )
    return obs, dim


def test_level_order(panel):
    obs, dim = panel
    ranked = rank.level_rank(scans.eligible(obs, dim, "nominal_current"))
    got = {y: [r.entity for r in ranked.where(F.col("year") == y).orderBy("rank").collect()] for y in (2003, 2004, 2005)}
    assert got == {
        2003: ["USA", "BRA", "IND"],
        2004: ["USA", "XKX", "PSE", "TUV", "BRA", "IND", "CIV"],
        2005: ["USA", "XKX", "PSE", "BRA", "IND", "CIV"],
    }
    assert {r.year: r.n for r in rank.denominators(scans.eligible(obs, dim, "nominal_current")).collect()} == {
        2002: 1, 2003: 3, 2004: 7, 2005: 6,
    }


def test_yoy_pairs_and_reasons(panel):
    obs, dim = panel
    rows = scans.eligible(obs, dim, "nominal_current")
    ranked = yoy.yoy_rank(rows)
    assert {r.year: r.n for r in ranked.select("year", "n").distinct().collect()} == {2003: 1, 2004: 3, 2005: 5}
    india = {r.year: r for r in yoy.yoy_series(rows.where("entity = 'IND'"), 2003, 2006).collect()}
    assert india[2003].reason == "previous_year_value_missing"
    assert india[2004].yoy == pytest.approx(16.694421315570352, rel=1e-12)
    assert india[2005].yoy == pytest.approx(14.181234391723162, rel=1e-12)
    assert india[2006].reason == "current_year_value_missing"
    civ = yoy.yoy_rows(rows.where("entity = 'CIV'")).where("year = 2005").first()
    assert civ.reason == "both_years_zero" and civ.yoy is None


def test_a_gap_is_never_bridged(spark):
    obs = spark.createDataFrame([("A", "m", 2000, 1.0), ("A", "m", 2002, 2.0)], "entity string, metric string, year int, value double")
    assert [r.reason for r in yoy.yoy_rows(obs).orderBy("year").collect()] == ["previous_year_value_missing"] * 2


def test_search_page_and_neighbours(spark):
    rows = [(f"E{i:02d}", "total_current", 2000, float(100 - i)) for i in range(30)]
    obs = spark.createDataFrame(rows, "entity string, metric string, year int, value double")
    ranked = rank.level_rank(obs).withColumn("name", F.concat(F.lit("Name "), "entity"))
    assert [r["rank"] for r in rank.search(ranked, F.lit("#7")).collect()] == [7]
    assert {r.entity for r in rank.search(ranked, F.lit("e1")).collect()} == {f"E1{i}" for i in range(10)}
    assert rank.search(ranked, F.lit(" ")).count() == 30
    last = rank.page(ranked, 99, 7).collect()
    assert sorted(r["rank"] for r in last) == [29, 30] and last[0].pages == 5
    near = rank.neighbours(ranked, "E00", 2).collect()
    assert sorted(r["rank"] for r in near) == [1, 2, 3]
    alone = rank.position_facts(rank.level_rank(obs.where("entity = 'E00'"))).first()
    assert alone.position is None and alone.rows_above == 0


def test_competition_and_neutral(spark):
    rows = [(e, "exports_current", 2000, v) for e, v in (("A", 100.0), ("B", 90.0), ("C", 90.0), ("D", 70.0))]
    rows += [("A", "fx_official", 2000, 1.0)]
    obs = spark.createDataFrame(rows, "entity string, metric string, year int, value double")
    ranked = rank.level_rank(obs, competition="tied")
    assert {r.entity: r.tied for r in ranked.collect()} == {"A": 1, "B": 2, "C": 2, "D": 4}
    assert [(r.metric, r.reason) for r in rank.refused_metrics(obs).collect()] == [("fx_official", "RANK_UNSUPPORTED")]
