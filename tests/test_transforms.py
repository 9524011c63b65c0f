"""Formula answers and reason codes on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from panelyst.functions import text, transforms as T, years
from panelyst.registry import BASES, METRICS, can_compare, can_transform, gate_operation, validate_registry

NAN, INF = float("nan"), float("inf")


def evaluate(spark, function, rows):
    """Apply a two-column outcome to (a, b) rows; returns (value, reason) pairs in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double")
    out = function(F.col("a"), F.col("b"))
    got = df.select("i", out.value.alias("v"), out.reason.alias("r")).orderBy("i").collect()
    return [(g.v, g.r) for g in got]


def check(got, expected):
    assert len(got) == len(expected)
    for (value, reason), want in zip(got, expected):
        if isinstance(want, str):
            assert (value, reason) == (None, want)
        else:
            assert reason is None and value == pytest.approx(want, rel=1e-9)


def test_yoy(spark):
    rows = [(700.75, 600.5), (800.125, 700.75), (None, None), (1.0, None), (None, 1.0), (NAN, 1.0), (INF, 1.0),
            (0.0, 0.0), (5.0, 0.0), (5.0, -1.0), (-5.0, 1.0), (0.0, 5.0)]
    check(evaluate(spark, T.yoy, rows), [
        16.694421315570352, 14.181234391723162, "both_years_missing", "previous_year_value_missing",
        "current_year_value_missing", "non_finite_value", "non_finite_value", "both_years_zero",
        "previous_year_value_not_positive", "previous_year_value_not_positive", "sign_change_across_endpoints", -100.0,
    ])


def test_two_point_changes(spark):
    rows = [(100.0, 110.0), (0.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (None, 1.0), (1.0, None), (None, None), (NAN, 1.0)]
    shared = ["missing_base_value", "missing_current_value", "both_values_missing", "non_finite_value"]
    based = ["zero_base_for_percent_change", "negative_base_for_percent_change", "sign_change_across_endpoints"]
    check(evaluate(spark, T.percent_change, rows), [10.0, *based, *shared])
    check(evaluate(spark, T.absolute_change, rows), [10.0, 1.0, 2.0, -2.0, *shared])
    check(evaluate(spark, T.period_growth, rows), [10.0, *based, *shared])
    check(evaluate(spark, lambda a, b: T.cagr(a, b, F.lit(2)), rows), [(math.sqrt(1.1) - 1) * 100, *based, *shared])
    check(evaluate(spark, lambda a, b: T.cagr(a, b, F.lit(0)), rows[:1]), ["invalid_year_interval"])


def test_cross_rate(spark):
    rows = [(83.0, 150.0), (1.0, 0.0), (0.0, 1.0), (1.0, -1.0), (None, 1.0)]
    check(evaluate(spark, T.cross_rate, rows), [
        83 / 150, "zero_base_for_percent_change", "negative_base_for_percent_change",
        "negative_base_for_percent_change", "missing_base_value",
    ])


def test_family_formulas(spark):
    changes = [(80.0, 82.0), (110.0, 105.0), (45.0, 61.0), (2.0, 1.6), (0.0, 1.0), (None, 1.0)]
    expected = [2.5, -4.545454545454541, 35.55555555555556, -20.0, "non_positive_base", "missing_endpoint"]
    check(evaluate(spark, T.positive_base_change, changes), expected)
    check(evaluate(spark, lambda a, b: T.display_cagr(a, b, F.lit(10)), [(80.0, 100.0), (80.0, 0.0), (80.0, -1.0)]), [
        (1.25 ** 0.1 - 1) * 100, -100.0, "negative_endpoint",
    ])
    check(evaluate(spark, lambda a, b: T.trade_cagr(a, b, F.lit(2)), [(100.0, 121.0), (0.0, 1.0), (-1.0, 1.0), (1.0, -1.0)]), [
        10.0, "zero_base_for_cagr", "negative_base_for_cagr", "negative_endpoint_for_cagr",
    ])
    check(evaluate(spark, T.index_period_change, [(100.0, 110.0), (0.0, 1.0), (-1.0, 1.0)]), [10.0, "zero_base", "negative_base"])
    check(evaluate(spark, T.gdp_ratio, [(-2.0, 100.0), (1.0, 0.0), (None, 1.0)]), [-2.0, "non_positive_gdp_base", "missing_leg"])
    check(evaluate(spark, T.reserve_months, [(50.0, 100.0), (1.0, 0.0)]), [6.0, "non_positive_imports_base"])
    check(evaluate(spark, T.endpoint_difference, [(5.0, 3.0), (None, 3.0)]), [-2.0, "missing_endpoint"])


def test_window_sizes():
    assert len(years.half_open(2004, 2014)) == 10
    assert len(years.after_start(2004, 2014)) == 10
    assert len(years.closed(2004, 2014)) == 11
    assert len(years.ends(2004, 2014)) == 2
    assert years.half_open(2004, 2014)[-1] == 2013 and years.after_start(2004, 2014)[0] == 2005
    with pytest.raises(ValueError):
        years.half_open(2004, 2004)
    with pytest.raises(ValueError):
        years.check_years(2004, 2014, 2014)


def test_registry():
    assert validate_registry() == [] and len(METRICS) == 20 and len(BASES) == 38
    assert can_transform(METRICS["inflation_cpi"], "PERCENT") == (False, "unsupported_transformation_for_metric")
    assert can_transform(None, "PERCENT") == (False, "unknown_metric")
    assert gate_operation("period_total", METRICS["total_current"]) == (False, "UNSUPPORTED_TRANSFORMATION")
    fx = METRICS["fx_official"]
    assert can_compare(fx, "COUNTRY", "COUNTRY", "level")[1] == "UNSUPPORTED_ENTITY_COMBINATION"
    assert can_compare(fx, "COUNTRY", "COUNTRY", "level", same_entity=True)[0]
    assert can_compare(fx, "COUNTRY", "CUSTOM_GROUP", "percent_change")[1] == "NOT_AGGREGATABLE"
    assert can_compare(fx, "COUNTRY", "CUSTOM_GROUP", "cross_rate")[1] == "UNSUPPORTED_ENTITY_COMBINATION"
    assert can_compare(METRICS["total_current"], "CUSTOM_GROUP", "OFFICIAL_AGGREGATE", "cagr")[0]


def test_text(spark):
    df = spark.createDataFrame([(" ind ", " 1.50 ", 1.5), ("", "abc", None), (None, None, 2.0), ("x", "1e400", None)],
                               "code string, t string, v double")
    got = df.select(
        text.normalize_code(F.col("code")).alias("c"), text.decimal_or_shortest(F.col("t"), F.col("v")).alias("d")
    ).collect()
    assert [(g.c, g.d) for g in got] == [("IND", "1.50"), (None, None), (None, "2.0"), ("X", None)]
    shown = spark.range(1).select(
        text.format_value(F.lit(1.2345e12), "$", scale="trillions").alias("a"),
        text.format_value(F.lit(1234.5), "$").alias("b"), text.format_percent(F.lit(2.345)).alias("c"),
        text.format_points(F.lit(-1.0)).alias("d"), text.format_index_points(F.lit(None).cast("double")).alias("e"),
    ).first()
    assert tuple(shown) == ("$1.23 trillion", "$1,235", "+2.35%", "-1.00 pp", None)
