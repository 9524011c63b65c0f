"""Strict consecutive-year growth. A gap yields no pair; nothing bridges it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelyst.functions.transforms import yoy, yoy_from_map
from panelyst.operators.ordered import rank_rows
from panelyst.operators.placing import place
from panelyst.operators.rank import denominators
from panelyst.registry import METRICS


def with_previous(obs: DataFrame) -> DataFrame:
    """The value exactly one year before. ``lag`` would take the last row across a gap."""
    series = Window.partitionBy("entity", "metric").orderBy("year")
    return obs.withColumn("previous", F.max("value").over(series.rangeBetween(-1, -1)))


def yoy_rows(obs: DataFrame) -> DataFrame:
    """Growth, or the reason there is none, for each observed year."""
    out = yoy(F.col("value"), F.col("previous"))
    return with_previous(obs).select("*", out.value.alias("yoy"), out.reason.alias("reason"))


def yoy_locate(obs: DataFrame, codes: list[str], rows_bound: int | None = None) -> DataFrame:
    """What ``yoy_rank`` says of a few entities, by counting who stands before them."""
    valid = yoy_rows(obs).where(F.col("reason").isNull())
    few = yoy_rows(obs.where(F.col("entity").isin(codes))).where(F.col("reason").isNull())
    return place(valid, few, ["metric", "year"], "yoy", group_bound=len(codes), rows_bound=rows_bound)


def yoy_rank(obs: DataFrame, rows_bound: int | None = None) -> DataFrame:
    """Ordinal rank over valid pairs only; the count of pairs is its own denominator."""
    valid = yoy_rows(obs).where(F.col("reason").isNull())
    return rank_rows(valid, ["metric", "year"], "yoy", rows_bound=rows_bound)


def by_year(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series with its values in a map; a series has one entry per year."""
    entries = F.collect_list(F.struct("year", "value"))
    return obs.groupBy(*keys).agg(F.map_from_entries(entries).alias("values"))


def spine(obs: DataFrame, first: int, last: int) -> DataFrame:
    """Every year of the range for each observed series; a missing year is a null cell."""
    cells = by_year(obs, ["entity", "metric"]).select(
        "*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    )
    return cells.withColumn("value", F.try_element_at("values", F.col("year")))


def yoy_series(obs: DataFrame, first: int, last: int) -> DataFrame:
    """Growth of each calendar year of the range, with a reason in every empty cell."""
    # One year more at the start gives the first year its predecessor.
    cells = spine(obs.where(F.col("year").between(first - 1, last)), first, last)
    out = yoy_from_map(F.col("values"), F.col("year"))
    previous = F.try_element_at("values", F.col("year") - 1)
    return cells.select(
        "entity", "metric", "year", "value", previous.alias("previous"),
        out.value.alias("yoy"), out.reason.alias("reason"),
    )


def yoy_coverage(obs: DataFrame, eligible_count: DataFrame | None = None) -> DataFrame:
    """Valid pairs beside the level denominators of both years."""
    rows = yoy_rows(obs)
    per_year = rows.groupBy("metric", "year").agg(
        F.count(F.lit(1)).alias("current_valid"),
        F.count_if(F.col("reason").isNull()).alias("valid_pairs"),
        F.count("previous").alias("with_previous"),
    )
    previous = per_year.select(
        "metric", (F.col("year") + 1).alias("year"), F.col("current_valid").alias("previous_valid")
    )
    return per_year.join(previous, ["metric", "year"], "left").fillna(0, ["previous_valid"])


def focus_yearly(obs: DataFrame, places: DataFrame, focus: str, first: int, last: int,
                 universe: int | None = None) -> DataFrame:
    """Value, rank, denominator and growth of one entity for each metric and year, with reasons.

    ``places``: its ranks, as ``rank.locate`` counts them or as rows of a full ranking.
    """
    totals = denominators(obs)
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    grid = totals.select("metric").distinct().select("metric", years)
    mine = obs.where(F.col("entity") == focus)
    values = mine.select("metric", "year", "value")
    before = mine.select("metric", (F.col("year") + 1).alias("year"), F.col("value").alias("previous"))
    places = places.where(F.col("entity") == focus).select("metric", "year", "rank")
    keys = ["metric", "year"]
    cells = grid
    for side in (values, before, places, totals):
        cells = cells.join(side, keys, "left")
    grown = yoy(F.col("value"), F.col("previous"))
    no_yoy = F.col("metric").isin([m.key for m in METRICS.values() if "YOY" not in m.changes])
    unranked = F.col("metric").isin([m.key for m in METRICS.values() if m.direction == "NEUTRAL"])
    n = F.coalesce("n", F.lit(0))
    return cells.select(
        *keys,
        "value",
        F.when(F.col("value").isNull(), "no_valid_observation_for_focus_in_this_metric_year").alias("reason"),
        "rank",
        F.when(unranked, "RANK_UNSUPPORTED").alias("rank_reason"),
        n.alias("n"),
        F.greatest(F.lit(0), F.lit(universe) - n).alias("missing") if universe is not None else F.lit(None).cast("long").alias("missing"),
        "previous",
        F.when(~no_yoy, grown.value).alias("yoy"),
        F.when(no_yoy, "unsupported_transformation_for_metric").otherwise(grown.reason).alias("yoy_reason"),
    )
