"""Family statistics against brute force."""

import statistics

import pytest
from pyspark.sql import functions as F

from panelyst.operators import bases as B, ordered
from panelyst.registry import BASES


def frame(spark, series):
    rows = [(e, m, y, float(v)) for (e, m), values in series.items() for y, v in values.items()]
    return spark.createDataFrame(rows, "entity string, metric string, year int, value double")


def movement(spark, series, key, a, b, m=None, **options):
    options.setdefault("rows_bound", 10)
    out = B.basis_movement(frame(spark, series), [BASES[key]], a, b, m, **options)
    return {(r.period, r.universe, r.entity): r for r in out.collect()}


@pytest.mark.parametrize("rates, expected", [((10, 0, 10), 21.0), ((5, 0, 10), 15.5)])
def test_compounding(spark, rates, expected):
    got = movement(spark, {("A", "inflation_cpi"): dict(zip((2001, 2002, 2003), rates))}, "cpi_inflation_cumulative", 2000, 2003)
    row = got[("AB", "observed", "A")]
    assert row.value == pytest.approx(expected) and row.benchmark_reason == "insufficient_comparison_universe"


def test_share_is_a_ratio_of_sums(spark):
    series = {("A", "fdi_inflows"): {2001: 10, 2002: 5}, ("A", "total_current"): {2001: 100, 2002: 200}}
    row = movement(spark, series, "fdigdp_period_cumulative_share", 2000, 2002)[("AB", "observed", "A")]
    assert row.value == pytest.approx(5.0)


def test_mean_of_yearly_ratios(spark):
    series = {
        ("A", "current_account"): dict(zip(range(2001, 2006), (-1, -2, -1, 1, 2))),
        ("A", "total_current"): {y: 100 for y in range(2001, 2006)},
    }
    row = movement(spark, series, "ca_average_gdp", 2000, 2005)[("AB", "observed", "A")]
    assert row.value == pytest.approx(-0.2)


def test_missing_year_is_incomplete_not_zero(spark):
    got = movement(spark, {("A", "exports_current"): {2000: 1, 2002: 3}, ("B", "exports_current"): {2000: 1, 2001: 1, 2002: 1}},
                   "exp_period_total", 2000, 2002)
    assert got[("AB", "observed", "A")].reason == "incomplete_period" and got[("AB", "observed", "A")]["rank"] is None
    assert got[("AB", "observed", "B")].value == 3.0 and got[("AB", "observed", "B")].incomplete == 1
    assert ("AB", "like_for_like", "A") not in got


@pytest.mark.parametrize("values", [[-10, 5, 8, 12, 1500], [1, 1, 2, 9], [3, 3, 3], [4, 4], [7]])
def test_leave_one_out_median(spark, monkeypatch, values):
    series = {(f"E{i}", "reserves_ex_gold"): {2000: v, 2001: v} for i, v in enumerate(values)}
    for limit in (ordered.WINDOW_ROWS, 1):
        monkeypatch.setattr(ordered, "WINDOW_ROWS", limit)
        got = movement(spark, series, "res_annual_stock", 2000, 2001, rows_bound=100 if limit == 1 else 10)
        for i, v in enumerate(values):
            others = values[:i] + values[i + 1:]
            row = got[("2000", "observed", f"E{i}")]
            want = statistics.median(others) if others else None
            assert row.benchmark == want and row.gap == (None if want is None else v - want)


def test_prices_rank_low_first_and_gap_from_peer(spark):
    series = {(e, "inflation_cpi"): {2000: v, 2001: v} for e, v in (("A", 1), ("B", 2), ("C", 2), ("D", 9))}
    got = movement(spark, series, "cpi_inflation_annual", 2000, 2001)
    assert [got[("2000", "observed", e)]["rank"] for e in "ABCD"] == [1, 2, 2, 4]
    assert got[("2000", "observed", "A")].gap == pytest.approx((2 + 2 + 9) / 3 - 1)


def test_cagr_common_set_needs_positive_starts(spark):
    series = {("A", "exports_current"): {2000: 1, 2001: 2, 2002: 3}, ("B", "exports_current"): {2000: 0, 2001: 2, 2002: 3}}
    got = movement(spark, series, "exp_period_cagr", 2000, 2002, 2001)
    assert ("AM", "like_for_like", "A") in got and ("AM", "like_for_like", "B") not in got
    assert got[("AM", "observed", "B")].reason == "zero_base_for_cagr" and got[("MB", "observed", "B")].reason is None


def test_common_and_outside(spark):
    series = {("A", "population_total"): {2000: 1, 2001: 2}, ("B", "population_total"): {2000: 5}}
    out = B.basis_movement(frame(spark, series), [BASES["pop_annual_value"]], 2000, 2001, rows_bound=10)
    assert [r.entity for r in B.common_rows(out, 2).collect()] == ["A"]
    assert [(r.period, r.entity) for r in B.outside_rows(out, 2).collect()] == [("2000", "B")]


def test_group_restriction(spark):
    obs = frame(spark, {("A", "population_total"): {2000: 1}, ("B", "population_total"): {2000: 2}})
    dim = spark.createDataFrame([("A", "HIC", False), ("B", "LIC", False)], "entity string, income_level string, is_aggregate boolean")
    assert [r.entity for r in B.restrict_to_group(obs, dim, "income_level", "HIC").collect()] == ["A"]
    for column, value in (("income_level", "nowhere"), ("name", "A")):
        with pytest.raises(ValueError):
            B.restrict_to_group(obs, dim, column, value)


def test_companions(spark):
    series = {("A", "fx_official"): {2000: 80, 2010: 100}, ("A", "inflation_cpi_index"): {2000: 105, 2010: 110}}
    got = {r.kind: r for r in B.companions(frame(spark, series), 2000, 2010).collect()}
    assert got["display_cagr"].value == pytest.approx((1.25 ** 0.1 - 1) * 100)
    assert got["display_cagr"].polarity.startswith("Nominal depreciation")
    assert got["index_point_change"].value == 5.0
