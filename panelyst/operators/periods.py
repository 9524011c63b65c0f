"""Period totals and averages over half-open intervals, strict about missing years."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions import transforms as T
from panelyst.functions.years import half_open
from panelyst.operators.yoy import by_year
from panelyst.registry import METRICS, can_transform


def _values(years: list[int]) -> list[Column]:
    return [F.try_element_at("values", F.lit(y)) for y in years]


def strict_sum(years: list[int]) -> T.Outcome:
    """Null unless every year is there; a gap is neither zero nor skipped."""
    total = reduce(add, _values(years))
    return T.guarded([(total.isNull(), "incomplete_period")], total)


def missing_years(years: list[int]) -> Column:
    return F.array_compact(F.array(*[
        F.when(v.isNull(), F.lit(y)) for y, v in zip(years, _values(years))
    ]))


def _supporting(obs: DataFrame, transform: str) -> DataFrame:
    allowed = [m.key for m in METRICS.values() if can_transform(m, transform)[0]]
    return obs.where(F.col("metric").isin(allowed))


def period_summary(obs: DataFrame, start: int, end: int) -> DataFrame:
    """Sum and average of [start, end) for every entity of the flow metrics."""
    years = half_open(start, end)
    rows = _supporting(obs, "PERIOD_SUM").where(F.col("year").isin(years))
    total = strict_sum(years)
    return by_year(rows, ["entity", "metric"]).select(
        "entity", "metric",
        F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(len(years)).alias("size"),
        total.value.alias("sum"), (total.value / len(years)).alias("average"),
        total.reason.alias("reason"), missing_years(years).alias("missing_years"),
    )


def period_total_growth(obs: DataFrame, a: int, b: int, c: int) -> DataFrame:
    """Growth of the total of [b, c) over the total of the adjacent [a, b)."""
    first, second = half_open(a, b), half_open(b, c)
    rows = _supporting(obs, "PERIOD_SUM_PERCENT_CHANGE").where(F.col("year").isin(first + second))
    one, two = strict_sum(first), strict_sum(second)
    growth = T.period_growth(one.value, two.value)
    return by_year(rows, ["entity", "metric"]).select(
        "entity", "metric", F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"),
        one.value.alias("sum_ab"), two.value.alias("sum_bc"),
        growth.value.alias("growth"), growth.reason.alias("reason"),
    )


def transforms_between(obs: DataFrame, transforms: list[str], a: int, b: int) -> DataFrame:
    """Two-point transforms of every metric from one pass; metrics that do not declare one say so."""
    rows = by_year(obs.where(F.col("year").isin([a, b])), ["entity", "metric"])
    start, end = _values([a, b])
    known = F.col("metric").isin([m.key for m in METRICS.values()])

    def one(transform: str):
        allowed = [m for m in METRICS.values() if can_transform(m, transform)[0]]
        if not allowed:
            raise ValueError("unsupported_transformation_for_metric")
        out = T.compute_transform(allowed[0], transform, start, end, F.lit(b - a))
        gate = F.when(~known, "unknown_metric").when(
            ~F.col("metric").isin([m.key for m in allowed]), "unsupported_transformation_for_metric"
        )
        reason = F.coalesce(gate, out.reason)
        return F.struct(
            F.lit(transform).alias("transform"), F.when(reason.isNull(), out.value).alias("value"), reason.alias("reason")
        )

    laid = rows.select(
        "entity", "metric", start.alias("start_value"), end.alias("end_value"),
        F.explode(F.array(*[one(t) for t in transforms])).alias("t"),
    )
    return laid.select(
        "entity", "metric", "t.transform", F.lit(a).alias("a"), F.lit(b).alias("b"), "start_value", "end_value",
        "t.value", "t.reason",
    )
