"""Reason-coded scalar transforms as Columns.

Each returns an ``Outcome``: a value, or null with the reason it is null. Guards are ordered; the
first that holds names the reason. Codes differ between families on purpose and are fixed values.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.registry import Metric, can_transform

INFINITY = float("inf")


class Outcome(NamedTuple):
    """``raw`` is meaningful only where ``reason`` is null."""

    raw: Column
    reason: Column

    @property
    def value(self) -> Column:
        return F.when(self.reason.isNull(), self.raw)

    def struct(self) -> Column:
        return F.struct(
            self.value.alias("value"),
            self.reason.alias("reason"),
            self.reason.isNull().alias("computable"),
        )


def choose(by: str, outcomes: dict[str, Outcome]) -> Outcome:
    """The outcome named by a column."""
    raw = reason = None
    for name, out in outcomes.items():
        here = F.col(by) == name
        raw = (F.when if raw is None else raw.when)(here, out.raw)
        reason = (F.when if reason is None else reason.when)(here, out.reason)
    return Outcome(raw, reason)


def with_outcome(df: DataFrame, out: Outcome) -> DataFrame:
    """Adds ``reason`` and ``value``; the guards are evaluated once, then reused by the value."""
    return df.withColumn("reason", out.reason).withColumn("value", F.when(F.col("reason").isNull(), out.raw))


def finite(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), F.lit(False))


def first_reason(guards: list[tuple[Column, str]]) -> Column:
    chain = None
    for condition, code in guards:
        chain = F.when(condition, code) if chain is None else chain.when(condition, code)
    return F.lit(None).cast("string") if chain is None else chain


def guarded(guards: list[tuple[Column, str]], value: Column) -> Outcome:
    return Outcome(value, first_reason(guards))


def growth_percent(start: Column, end: Column) -> Column:
    return (F.try_divide(end, start) - 1) * 100


def compound_percent(start: Column, end: Column, years: Column) -> Column:
    # The exponent stays defined for an empty interval, which the guards refuse anyway.
    exponent = F.lit(1.0) / F.greatest(years.cast("double"), F.lit(1.0))
    return (F.pow(F.try_divide(end, start), exponent) - 1) * 100


def _presence(a: Column, b: Column, both: str, first: str, second: str) -> list[tuple[Column, str]]:
    return [
        (a.isNull() & b.isNull(), both),
        (a.isNull(), first),
        (b.isNull(), second),
        (~(finite(a) & finite(b)), "non_finite_value"),
    ]


def _two_point(a: Column, b: Column) -> list[tuple[Column, str]]:
    return _presence(a, b, "both_values_missing", "missing_base_value", "missing_current_value")


def _endpoints(a: Column, b: Column, missing: str = "missing_endpoint") -> list[tuple[Column, str]]:
    return [
        (a.isNull() | b.isNull(), missing),
        (~(finite(a) & finite(b)), "non_finite_value"),
    ]


def _percent_base(a: Column, b: Column) -> list[tuple[Column, str]]:
    return [
        (a == 0, "zero_base_for_percent_change"),
        (a < 0, "negative_base_for_percent_change"),
        (b < 0, "sign_change_across_endpoints"),
    ]


# --- year over year -----------------------------------------------------------------------------
def yoy(current: Column, previous: Column) -> Outcome:
    guards = _presence(
        previous, current, "both_years_missing", "previous_year_value_missing",
        "current_year_value_missing",
    ) + [
        ((previous == 0) & (current == 0), "both_years_zero"),
        (previous <= 0, "previous_year_value_not_positive"),
        (current < 0, "sign_change_across_endpoints"),
    ]
    return guarded(guards, growth_percent(previous, current))


def yoy_from_map(by_year: Column, year: Column) -> Outcome:
    return yoy(F.try_element_at(by_year, year), F.try_element_at(by_year, year - 1))


# --- generic two-point transforms ---------------------------------------------------------------
def absolute_change(a: Column, b: Column) -> Outcome:
    return guarded(_two_point(a, b), b - a)


# Same arithmetic, different unit and capability.
percentage_point_change = absolute_change
index_point_change = absolute_change


def percent_change(a: Column, b: Column) -> Outcome:
    return guarded(_two_point(a, b) + _percent_base(a, b), growth_percent(a, b))


def cagr(a: Column, b: Column, years: Column) -> Outcome:
    guards = (
        _two_point(a, b)
        + [(years.isNull() | (years <= 0), "invalid_year_interval")]
        + _percent_base(a, b)
    )
    return guarded(guards, compound_percent(a, b, years))


def cross_rate(a_per_usd: Column, b_per_usd: Column) -> Outcome:
    guards = _two_point(a_per_usd, b_per_usd) + [
        (b_per_usd == 0, "zero_base_for_percent_change"),
        ((a_per_usd <= 0) | (b_per_usd < 0), "negative_base_for_percent_change"),
    ]
    return guarded(guards, F.try_divide(a_per_usd, b_per_usd))


def cross_rate_legs(metric: Metric, a: Column, b: Column) -> Column:
    """Reason the two legs of a cross rate may not be combined, or null."""
    if not can_transform(metric, "CROSS_RATE")[0]:
        return F.lit("UNSUPPORTED_TRANSFORMATION")
    usable = finite(a) & finite(b) & (a > 0) & (b > 0)
    return F.when(~F.coalesce(usable, F.lit(False)), "MISSING_REQUIRED_DATA")


def period_growth(sum_a: Column, sum_b: Column) -> Outcome:
    return guarded(_two_point(sum_a, sum_b) + _percent_base(sum_a, sum_b), growth_percent(sum_a, sum_b))


def compute_transform(metric: Metric | None, transform: str, a: Column, b: Column,
                      years: Column | None = None) -> Outcome:
    """Gate by the registry, then compute."""
    allowed, reason = can_transform(metric, transform)
    if not allowed:
        return Outcome(F.lit(None).cast("double"), F.lit(reason))
    if transform == "CAGR":
        return cagr(a, b, years)
    return {
        "ABSOLUTE": absolute_change,
        "PP": percentage_point_change,
        "INDEX_POINT": index_point_change,
        "PERCENT": percent_change,
        "YOY": percent_change,
        "CROSS_RATE": cross_rate,
        "PERIOD_SUM_PERCENT_CHANGE": period_growth,
    }[transform](a, b)


# --- family endpoint statistics -----------------------------------------------------------------
def index_period_change(start: Column, end: Column) -> Outcome:
    guards = _endpoints(start, end) + [(start == 0, "zero_base"), (start < 0, "negative_base")]
    return guarded(guards, growth_percent(start, end))


def endpoint_difference(start: Column, end: Column) -> Outcome:
    """Index points, capital diagnostics and population change."""
    return guarded(_endpoints(start, end), end - start)


def positive_base_change(start: Column, end: Column) -> Outcome:
    """Trade endpoint change, FX annual and period change, reserve and population growth."""
    guards = _endpoints(start, end) + [(start <= 0, "non_positive_base")]
    return guarded(guards, growth_percent(start, end))


def trade_cagr(start: Column, end: Column, years: Column) -> Outcome:
    guards = _endpoints(start, end) + [
        (years.isNull() | (years <= 0), "invalid_period"),
        (start == 0, "zero_base_for_cagr"),
        (start < 0, "negative_base_for_cagr"),
        (end < 0, "negative_endpoint_for_cagr"),
    ]
    return guarded(guards, compound_percent(start, end, years))


def display_cagr(start: Column, end: Column, years: Column) -> Outcome:
    """FX and population yearly rate, shown beside the ranked change and never ranked."""
    guards = _endpoints(start, end) + [
        (years.isNull() | (years <= 0), "invalid_period"),
        (start <= 0, "non_positive_base"),
        (end < 0, "negative_endpoint"),
    ]
    return guarded(guards, compound_percent(start, end, years))


def leg_ratio(numerator: Column, denominator: Column, factor: float, reason: str) -> Outcome:
    guards = _endpoints(numerator, denominator, "missing_leg") + [(denominator <= 0, reason)]
    return guarded(guards, F.try_divide(numerator, denominator) * factor)


def gdp_ratio(flow: Column, gdp: Column) -> Outcome:
    return leg_ratio(flow, gdp, 100.0, "non_positive_gdp_base")


def reserve_months(reserves: Column, imports: Column) -> Outcome:
    return leg_ratio(reserves, imports, 12.0, "non_positive_imports_base")


def polarity(change: Column) -> Column:
    """Label of a quoted-rate change: a rise in local currency per US$ is a depreciation."""
    return (
        F.when(change > 0, "Nominal depreciation vs USD")
        .when(change < 0, "Nominal appreciation vs USD")
        .when(change == 0, "No nominal movement vs USD")
    )
