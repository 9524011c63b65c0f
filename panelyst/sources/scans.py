"""Scans of the observation table. On a table as ``tables.published`` lays it out, metric filters pick folders
and filters on year and entity reach the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions.transforms import finite

KEY = ["entity", "metric", "year"]


def eligible_dim(dim: DataFrame) -> DataFrame:
    return dim.where(~F.col("is_aggregate"))


def aggregate_dim(dim: DataFrame) -> DataFrame:
    return dim.where(F.col("is_aggregate"))


def dim_entries(dim: DataFrame, codes: list[str], column: str = "entity") -> DataFrame:
    """Dimension rows by entity code, or by another code column."""
    return dim.where(F.col(column).isin(codes))


def eligible(obs: DataFrame, dim: DataFrame, metric: str, years: list[int] | None = None,
             between: tuple[int, int] | None = None) -> DataFrame:
    """Rankable observations of one metric: a year, a list of years, a range or all of them."""
    rows = obs.where((F.col("metric") == metric) & finite(F.col("value")))
    if years is not None:
        rows = rows.where(F.col("year").isin(sorted(set(years))))
    if between is not None:
        rows = rows.where(F.col("year").between(*between))
    return rows.join(eligible_dim(dim).select("entity", "name"), "entity")


def entity_list(obs: DataFrame, metric: str, codes: list[str], years: list[int]) -> DataFrame:
    """Observations of named entities, published aggregates included."""
    return obs.where(
        (F.col("metric") == metric) & F.col("entity").isin(codes) & F.col("year").isin(sorted(set(years)))
    )


def entity_series(obs: DataFrame, metric: str, code: str, first: int, last: int) -> DataFrame:
    return obs.where(
        (F.col("metric") == metric) & (F.col("entity") == code) & F.col("year").between(first, last)
    )


def point(obs: DataFrame, metric: str, code: str, year: int) -> DataFrame:
    return obs.where((F.col("metric") == metric) & (F.col("entity") == code) & (F.col("year") == year))


def comparison_columns(obs: DataFrame, metric: str, first: int, last: int) -> DataFrame:
    """The columns a content diff needs, and no others."""
    rows = obs.where((F.col("metric") == metric) & F.col("year").between(first, last))
    return rows.select("entity", "year", "value", "value_raw", "vintage")


def catalogued(obs: DataFrame, dim: DataFrame, metric_dim: DataFrame) -> DataFrame:
    """Observations with entity and metric descriptions."""
    return obs.join(metric_dim, "metric").join(dim, "entity")


def with_provenance(obs: DataFrame, dim: DataFrame, metric_dim: DataFrame, where: Column | None = None) -> DataFrame:
    """Raw observation browser: value, source text, stamps and descriptions side by side."""
    rows = obs if where is None else obs.where(where)
    return catalogued(rows, dim, metric_dim)


def any_eligible(obs: DataFrame, dim: DataFrame, metric: str) -> bool:
    """Existence probe: stops at the first row."""
    return not eligible(obs, dim, metric).limit(1).isEmpty()


def have_data(obs: DataFrame, dim: DataFrame, metric_dim: DataFrame) -> DataFrame:
    """The existence probe for every metric at once. Entities are counted before the lookup."""
    each = obs.where(finite(F.col("value"))).groupBy("metric", "entity").agg(F.lit(True).alias("_any"))
    found = each.join(eligible_dim(dim).select("entity"), "entity", "left_semi").select("metric", "_any").distinct()
    return metric_dim.join(found, "metric", "left").select("metric", F.coalesce("_any", F.lit(False)).alias("has_data"))


def latest_runs(runs: DataFrame, count: int, status: str | None = None) -> DataFrame:
    """The newest runs, of one status or of all."""
    wanted = runs if status is None else runs.where(F.col("status") == status)
    return wanted.orderBy(F.col("run_id").desc()).limit(count)
