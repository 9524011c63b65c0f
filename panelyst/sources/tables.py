"""Panels derived from the order, line-item and event tables.

A panel holds one row per (entity, metric, year). Money is summed as whole cents, so totals are exact
and do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelyst.operators.ordered import WINDOW_ROWS, largest_group
from panelyst.session import table_folder


@dataclass(frozen=True)
class Panel:
    """``rows_bound``: proven upper bound of the rows of any one (metric, year).
    ``entities_bound``: the same for all entities together, for statistics over several years.
    """

    obs: DataFrame
    dim: DataFrame
    rows_bound: int
    entities_bound: int
    metrics: tuple[str, ...]


def bounded(obs: DataFrame, dim: DataFrame, source: DataFrame, metrics: tuple[str, ...]) -> Panel:
    """A panel with its bounds. Its source's row count, read from file footers, bounds everything; only
    when that is no use are the panel's own groups counted."""
    rows = source.count()
    if rows <= WINDOW_ROWS:
        return Panel(obs, dim, rows, rows, metrics)
    entities = obs.select("entity").distinct().count()
    return Panel(obs, dim, largest_group(obs, ["metric", "year"]), entities, metrics)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def code(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 9, "0"))


def long_form(wide: DataFrame, ids: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per metric that has a value; a missing one stays absent."""
    pairs = F.array(*[
        F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))
        for metric, value in values.items()
    ])
    return (
        wide.select(*ids, F.explode(pairs).alias("cell"))
        .select(*ids, "cell.metric", "cell.value")
        .where(F.col("value").isNotNull())
    )


# --- customers by order year: sparse, with heavy ties in the count --------------------------------
CUSTOMER_METRICS = ("total_current", "population_total")


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .select(
            code("C", "c_custkey").alias("entity"),
            F.col("c_name").alias("name"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("income_level"),
            F.col("n_name").alias("lending_type"),
            F.lit(False).alias("is_aggregate"),
        )
    )


def customer_panel(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...] = CUSTOMER_METRICS) -> Panel:
    orders = table(spark, sf_dir, "orders")
    # Only the sums asked for are built, so an unused column is never read.
    sums = {"total_current": F.sum(cents("o_totalprice")) / 100.0, "population_total": F.count(F.lit(1))}
    wide = (
        orders.select(F.col("o_custkey"), F.year("o_orderdate").alias("year"), "o_totalprice")
        .groupBy("o_custkey", "year")
        .agg(*[sums[m].alias(m) for m in metrics])
        .withColumn("entity", code("C", "o_custkey"))
    )
    obs = long_form(wide, ["entity", "year"], {m: F.col(m) for m in metrics})
    return bounded(obs, customer_dim(spark, sf_dir), orders, metrics)


# --- parts by ship year: every registry family, some metrics sparse or signed ----------------------
PART_METRICS = (
    "total_current", "exports_current", "imports_current", "fdi_inflows", "fdi_inflows_pct_gdp",
    "current_account", "reserves_ex_gold", "remittances_received", "population_total",
    "fx_official", "inflation_cpi_index", "inflation_cpi", "inflation_deflator", "nominal_current",
)
ADDITIVE_PART_METRICS = (
    "total_current", "exports_current", "imports_current", "fdi_inflows", "current_account",
    "reserves_ex_gold", "remittances_received", "population_total",
)
_PART_SUMS = ("gross", "net", "accepted", "kept", "disc", "tax", "quantity", "lines")


def within(df: DataFrame, column: str, span: tuple[int, int] | None) -> DataFrame:
    """Rows of the years asked for, as a plain range on the date so that the reader can skip files."""
    if span is None:
        return df
    first, after = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (span[0], span[1] + 1))
    return df.where((F.col(column) >= first) & (F.col(column) < after))


def _part_year_sums(spark: SparkSession, sf_dir: str, span: tuple[int, int] | None) -> DataFrame:
    price = cents("l_extendedprice")
    flag = F.col("l_returnflag")
    return (
        within(table(spark, sf_dir, "lineitem"), "l_shipdate", span)
        .groupBy("l_partkey", F.year("l_shipdate").alias("year"))
        .agg(
            F.sum(price).alias("gross"),
            F.sum(F.when(flag == "R", -price).otherwise(price)).alias("net"),
            F.sum(F.when(flag == "A", price)).alias("accepted"),
            F.sum(F.when(flag == "N", price)).alias("kept"),
            F.sum(price * cents("l_discount")).alias("disc"),
            F.sum(price * cents("l_tax")).alias("tax"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def _part_values() -> dict[str, Column]:
    gross, net, disc, tax = (F.col(c).cast("double") for c in ("gross", "net", "disc", "tax"))
    accepted, kept = F.col("accepted"), F.col("kept")
    zero = F.lit(0)
    return {
        "total_current": gross / 100,
        "exports_current": accepted / 100,
        "imports_current": kept / 100,
        "fdi_inflows": net / 100,
        "fdi_inflows_pct_gdp": net / gross * 100,
        "current_account": (F.coalesce(accepted, zero) - F.coalesce(kept, zero)) / 100,
        "reserves_ex_gold": tax / 10000,
        "remittances_received": disc / 10000,
        "population_total": F.col("quantity"),
        "fx_official": gross / 100 / F.col("quantity"),
        "inflation_cpi_index": gross / 1000 / F.col("quantity"),
        "inflation_cpi": (tax - disc) / gross,
        "inflation_deflator": disc / gross,
        "nominal_current": gross / 100 / F.col("lines"),
    }


def _brand_code() -> Column:
    return F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))


def part_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, and their brands as published aggregates."""
    part = table(spark, sf_dir, "part")
    parts = part.select(
        code("P", "p_partkey").alias("entity"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("region"),
        F.col("p_brand").alias("income_level"),
        F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("lending_type"),
        F.lit(False).alias("is_aggregate"),
    )
    brands = part.select(
        _brand_code().alias("entity"),
        F.col("p_brand").alias("name"),
        F.lit("Aggregates").alias("region"),
        F.lit(None).cast("string").alias("income_level"),
        F.lit(None).cast("string").alias("lending_type"),
        F.lit(True).alias("is_aggregate"),
    ).distinct()
    return parts.unionByName(brands)


def part_panel(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...] = PART_METRICS,
               aggregates: bool = False, span: tuple[int, int] | None = None) -> Panel:
    """Eligible parts; with ``aggregates`` also the published brand totals. ``span`` limits the years."""
    sums = _part_year_sums(spark, sf_dir, span)
    values = _part_values()
    wide = sums.withColumn("entity", code("P", "l_partkey"))
    obs = long_form(wide, ["entity", "year"], {m: values[m] for m in metrics})
    if aggregates:
        part = table(spark, sf_dir, "part").select("p_partkey", _brand_code().alias("entity"))
        brand = (
            sums.join(part, sums["l_partkey"] == part["p_partkey"])
            .groupBy("entity", "year")
            .agg(*[F.sum(c).alias(c) for c in _PART_SUMS])
        )
        published = {m: values[m] for m in metrics if m in ADDITIVE_PART_METRICS}
        obs = obs.unionByName(long_form(brand, ["entity", "year"], published))
    return bounded(obs, part_dim(spark, sf_dir), table(spark, sf_dir, "lineitem"), metrics)


def published(obs: DataFrame) -> DataFrame:
    """``obs`` as a table in the shared folder: a folder for each metric, sorted by year and entity inside files."""
    path = table_folder(obs.sparkSession)
    rows = obs.repartition("metric", F.pmod(F.xxhash64("entity"), F.lit(8))).sortWithinPartitions("metric", "year", "entity")
    rows.write.partitionBy("metric").parquet(path)
    return obs.sparkSession.read.schema(obs.schema).parquet(path).select(*obs.columns)


def stored(panel: Panel) -> DataFrame:
    """The panel as a published table: decimal text, vintage stamp and retrieval time."""
    late = F.substring("entity", -1, 1).try_cast("int") % 5 == 0
    return panel.obs.select(
        "entity",
        "metric",
        "year",
        "value",
        F.col("value").cast("decimal(28,4)").cast("string").alias("value_raw"),
        F.when(late, "2024-07-01").otherwise("2024-01-01").alias("vintage"),
        F.when(F.col("year") >= 2000, F.lit("2024-07-02T00:00:00").cast("timestamp_ntz"))
        .otherwise(F.lit("2024-01-02T00:00:00").cast("timestamp_ntz"))
        .alias("fetched_at"),
    )


# --- users by day: a second sparse panel whose period is a day ------------------------------
FIRST_DAY = "2020-01-01"


def user_day_panel(spark: SparkSession, sf_dir: str) -> Panel:
    events = table(spark, sf_dir, "events")
    obs = (
        events.select(code("U", "user_id").alias("entity"), F.datediff("ts", F.lit(FIRST_DAY).cast("date")).alias("year"), "value")
        .groupBy("entity", "year")
        .agg((F.sum(cents("value")) / 100.0).alias("value"))
        .select("entity", F.lit("remittances_received").alias("metric"), "year", "value")
    )
    dim = obs.select("entity", F.col("entity").alias("name"), F.lit(False).alias("is_aggregate")).distinct()
    return bounded(obs, dim, events, ("remittances_received",))

