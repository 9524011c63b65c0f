"""Rankings of one metric and year, for every metric and year at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions.text import normalize_code, search_match
from panelyst.functions.transforms import finite
from panelyst.operators.ordered import group_bound, group_facts, rank_rows
from panelyst.operators.placing import place
from panelyst.registry import METRICS

GROUP = ["metric", "year"]


def rankable(df: DataFrame, value: str = "value") -> DataFrame:
    """Finite values of entities that have a code."""
    return df.where(finite(F.col(value)) & normalize_code(F.col("entity")).isNotNull())


def direction_sign(metric: Column) -> Column:
    """-1 where a low value ranks first, null where the metric is not ranked."""
    chain = F.lit(1.0)
    low = [m.key for m in METRICS.values() if m.direction == "ASC"]
    neutral = [m.key for m in METRICS.values() if m.direction == "NEUTRAL"]
    return F.when(metric.isin(neutral), F.lit(None)).when(metric.isin(low), -chain).otherwise(chain)


def _signed(obs: DataFrame) -> DataFrame:
    """Rankable rows of ranked metrics with the value that ranks them, high first."""
    return rankable(obs).withColumn("_key", F.col("value") * direction_sign(F.col("metric"))).where(F.col("_key").isNotNull())


def level_rank(obs: DataFrame, rows_bound: int | None = None, competition: str | None = None) -> DataFrame:
    """Ordinal rank of every metric-year in its registry direction; neutral metrics are refused."""
    key = F.col("value") * direction_sign(F.col("metric"))
    return rank_rows(_signed(obs).drop("_key"), GROUP, key, rows_bound=rows_bound, competition=competition)


def refused_metrics(obs: DataFrame) -> DataFrame:
    """Metric-years without an order, with the reason."""
    neutral = obs.where(direction_sign(F.col("metric")).isNull())
    return neutral.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows")).withColumn("reason", F.lit("RANK_UNSUPPORTED"))


def locate(obs: DataFrame, codes: list[str], rows_bound: int | None = None) -> DataFrame:
    """What ``level_rank`` says of a few entities, by counting who stands before them."""
    signed = _signed(obs)
    return place(signed, signed.where(F.col("entity").isin(codes)), GROUP, "_key", group_bound=len(codes),
                 rows_bound=rows_bound).drop("_key")


def neighbours(ranked: DataFrame, focus: str, count: int, rows_bound: int | None = None) -> DataFrame:
    """Rows within ``count`` places of the focus, in every group where it is ranked."""
    if count < 0:
        raise ValueError("count is 0 or more")
    mine = F.max(F.when(F.col("entity") == focus, F.col("rank")))
    near = group_facts(ranked, GROUP, {"focus_rank": mine}, rows_bound=group_bound(ranked, GROUP, rows_bound))
    return near.where(F.abs(F.col("rank") - F.col("focus_rank")) <= count)


def position_facts(ranked: DataFrame) -> DataFrame:
    """Rows above and below, and the relative position; null when a group has one row."""
    rank, n = F.col("rank"), F.col("n")
    return ranked.select(
        "*",
        (rank - 1).alias("rows_above"),
        (n - rank).alias("rows_below"),
        F.when(n > 1, (rank - 1) / (n - 1)).alias("position"),
    )


def rank_change(ranked: DataFrame) -> DataFrame:
    """Rank against the same entity's rank one year before, in numbers and words."""
    before = ranked.select(
        "entity", "metric", (F.col("year") + 1).alias("year"), F.col("rank").alias("previous_rank")
    )
    delta = F.col("rank") - F.col("previous_rank")
    text = F.format_string("rank %d, before %d (%+d)", F.col("rank"), F.col("previous_rank"), delta)
    return ranked.join(before, ["entity", "metric", "year"], "left").select(
        "*", delta.alias("delta"), F.when(delta.isNotNull(), text).alias("text")
    )


def page(ranked: DataFrame, number: int, size: int, focus: str | None = None) -> DataFrame:
    """One page of each group: of those it has, the nearest to ``number``. The rank is dense, so a page is a rank
    interval, not an offset."""
    if size < 1:
        raise ValueError("size is 1 or more")
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
    at = F.least(F.lit(max(1, number)).cast("long"), pages)
    inside = F.col("rank").between((at - 1) * size + 1, at * size)
    if focus:
        inside = inside | (F.col("entity") == focus)  # the focus row comes along, wherever it stands
    return ranked.withColumn("pages", pages).withColumn("page", at).where(inside)


def search(ranked: DataFrame, query: Column) -> DataFrame:
    """Filters after ranking, so a hit keeps the rank it has in the whole group."""
    return ranked.where(search_match(query, F.col("rank"), F.col("entity"), F.col("name")))


def denominators(obs: DataFrame) -> DataFrame:
    return rankable(obs).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


def full_ranking(obs: DataFrame, dim: DataFrame, *, number: int, size: int, query: str = "",
                 focus: str | None = None, rows_bound: int | None = None) -> DataFrame:
    """A page of the searched ranking; the focus row always comes along."""
    ranked = level_rank(obs, rows_bound).join(dim.select("entity", "name"), "entity")
    if query:
        ranked = search(ranked, F.lit(query))
        return ranked.withColumn("is_focus", F.col("entity") == F.lit(focus or ""))
    wanted = page(ranked, number, size, focus).drop("pages", "page")
    return wanted.withColumn("is_focus", F.col("entity") == F.lit(focus or ""))


def verification_window(ranked: DataFrame, focus: str, count: int, rows_bound: int | None = None) -> DataFrame:
    """The neighbourhood of the focus with position facts, for checking a rank by eye."""
    return position_facts(neighbours(ranked, focus, count, rows_bound))
