"""Classification of source rows: every rejected row has exactly one reason, and every reason a counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.functions.text import decimal_or_shortest, normalize_code
from panelyst.functions.transforms import finite

# fixed values: rejection reasons, first match wins
MISSING_VALUE = "missing_value"
NON_FINITE = "non_finite_value"
INVALID_YEAR = "invalid_year"
BLANK_CODE = "blank_iso3"
AGGREGATE = "aggregate_entity"
UNKNOWN = "unknown_country"
# fixed values: why an entity counts as an aggregate
AGGREGATE_REASONS = {
    "malformed": "country metadata was missing or malformed",
    "region_id": 'region.id is "NA"',
    "region_value": 'region.value is "Aggregates"',
    "blank": "blank or missing ISO3 code",
}


def classify_entities(meta: DataFrame) -> DataFrame:
    """Flattens metadata records and types each as eligible or aggregate, with the reason.

    ``meta`` has a ``record`` struct (id, iso2Code, name, region, incomeLevel, lendingType) and an
    ``ingest_order``.
    """
    r = F.col("record")
    entity = normalize_code(r["id"])
    reason = (
        F.when(r.isNull(), AGGREGATE_REASONS["malformed"])
        .when(r["region"]["id"] == "NA", AGGREGATE_REASONS["region_id"])
        .when(r["region"]["value"] == "Aggregates", AGGREGATE_REASONS["region_value"])
        .when(entity.isNull(), AGGREGATE_REASONS["blank"])
    )
    return meta.select(
        "ingest_order",
        entity.alias("entity"),
        r["iso2Code"].alias("iso2"),
        F.trim(F.coalesce(r["name"], F.lit(""))).alias("name"),
        r["region"]["value"].alias("region"),
        r["region"]["id"].alias("region_id"),
        r["incomeLevel"]["value"].alias("income_level"),
        r["lendingType"]["value"].alias("lending_type"),
        reason.isNotNull().alias("is_aggregate"),
        reason.alias("aggregate_reason"),
    )


def build_universe(meta: DataFrame) -> DataFrame:
    """Entities with an id, one definition each: the first in ingest order.

    ``min_by`` merges on the map side, so an id repeated in a third of the records stays cheap.
    """
    rows = classify_entities(meta).where(F.col("entity").isNotNull())
    columns = [c for c in rows.columns if c not in ("entity", "ingest_order")]
    first = rows.groupBy("entity").agg(F.min_by(F.struct(*columns), "ingest_order").alias("d"))
    return first.select("entity", "d.*")


def universe_sizes(dim: DataFrame) -> DataFrame:
    return dim.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(~F.col("is_aggregate")).alias("eligible"),
        F.count_if("is_aggregate").alias("aggregates"),
    )


def classify_observations(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds entity, year, value, value_raw, stored and reject_reason.

    ``raw`` has metric, code, date, value_text and vintage, all as landed. Aggregate rows are rejected
    from ranking but stored.
    """
    value = F.col("value_text").try_cast("double")
    year = F.regexp_extract("date", r"^\s*([+-]?\d+)", 1).try_cast("int")
    code = normalize_code(F.col("code"))
    rows = raw.select("*", code.alias("entity"), year.alias("year"), value.alias("value"))
    # Blank codes would all meet in one join partition; they match nothing, so they are scattered.
    scattered = F.concat(F.lit("~"), F.pmod(F.xxhash64("metric", "date", "value_text"), F.lit(4096)).cast("string"))
    rows = rows.withColumn("_key", F.coalesce("entity", scattered))
    known = dim.select(F.col("entity").alias("_key"), F.col("is_aggregate").alias("_aggregate"))
    rows = rows.join(known, "_key", "left")
    reason = (
        F.when(F.col("value_text").isNull(), MISSING_VALUE)
        .when(~finite(F.col("value")), NON_FINITE)
        .when(F.col("year").isNull(), INVALID_YEAR)
        .when(F.col("entity").isNull(), BLANK_CODE)
        .when(F.col("_aggregate"), AGGREGATE)
        .when(F.col("_aggregate").isNull(), UNKNOWN)
    )
    rows = rows.withColumn("reject_reason", reason)
    stored = F.col("reject_reason").isNull() | (F.col("reject_reason") == AGGREGATE)
    return rows.select(
        *raw.columns, "entity", "year", "value",
        decimal_or_shortest(F.col("value_text"), F.col("value")).alias("value_raw"),
        "reject_reason", stored.alias("stored"),
    )


def staged(classified: DataFrame, *more: str) -> DataFrame:
    return classified.where("stored").select("entity", "metric", "year", "value", "value_raw", "vintage", *more)


def rejection_counters(classified: DataFrame) -> DataFrame:
    """What happened to every received row, per metric and year."""
    reason = F.col("reject_reason")

    def rejected(code: str) -> Column:
        return F.count_if(F.coalesce(reason == code, F.lit(False)))

    return classified.groupBy("metric", "year").agg(
        F.count(F.lit(1)).alias("rows_received"),
        F.count_if(finite(F.col("value")) & F.col("year").isNotNull()).alias("rows_with_value"),
        F.count_if("stored").alias("rows_written"),
        rejected(MISSING_VALUE).alias("rows_null_skipped"),
        rejected(NON_FINITE).alias("rows_non_finite_skipped"),
        rejected(INVALID_YEAR).alias("rows_invalid_year"),
        rejected(BLANK_CODE).alias("rows_blank_skipped"),
        F.lit(0).cast("long").alias("rows_aggregate_excluded"),
        rejected(AGGREGATE).alias("rows_aggregate_stored"),
        rejected(UNKNOWN).alias("rows_unknown"),
    )


def removed_by_universe_rule() -> Column:
    return F.col("rows_aggregate_excluded") + F.col("rows_blank_skipped") + F.col("rows_unknown")


def list_entities(dim: DataFrame, obs: DataFrame | None = None, *, kind: str | None = None, search: str = "",
                  metric: str | None = None, year: int | None = None) -> DataFrame:
    """Dimension listing by kind and text, with a flag for entities that hold data."""
    rows = dim
    if kind == "country":
        rows = rows.where(~F.col("is_aggregate"))
    elif kind == "aggregate":
        rows = rows.where("is_aggregate")
    if search:
        text = search.strip().lower()
        rows = rows.where(F.lower("entity").contains(text) | F.lower("name").contains(text))
    if obs is None or metric is None:
        return rows
    return rows.join(
        observed_entities(obs, metric, year).withColumn("has_data", F.lit(True)), "entity", "left"
    ).fillna(False, ["has_data"])


def observed_entities(obs: DataFrame, metric: str, year: int | None = None) -> DataFrame:
    rows = obs.where(F.col("metric") == metric)
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.select("entity").distinct()


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each small group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
