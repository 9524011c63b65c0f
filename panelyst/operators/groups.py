"""Group series from member rows: sums with coverage, ratios of sums, like-for-like, membership effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.functions.plan import plan_rows, text_map
from panelyst.functions.transforms import finite
from panelyst.operators.ordered import EXACT
from panelyst.registry import METRICS


def member_cells(members: DataFrame, obs: DataFrame, metrics: list[str], years: list[int]) -> DataFrame:
    """Every member, metric and year, with the value or null. ``members``: (group_key, member)."""
    rows = obs.where(F.col("metric").isin(metrics) & F.col("year").isin(years) & finite(F.col("value")))
    plan = plan_rows([{"metric": m, "year": y} for m in metrics for y in years], "metric string; year int")
    cells = members.select("group_key", "member", F.explode(plan).alias("c")).select("group_key", "member", "c.*")
    columns = ["entity", "metric", "year", "value"] + (["vintage"] if "vintage" in obs.columns else [])
    return cells.join(
        rows.select(*columns).withColumnRenamed("entity", "member"), ["member", "metric", "year"], "left"
    )


def year_vectors(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """``members`` with ``values``, aligned to ``years``, and how many of them are ``held``: one join by entity.

    The panel is grouped once, to a row for each entity; members without any value get an empty vector.
    """
    rows = obs.where((F.col("metric") == metric) & F.col("year").isin(years) & finite(F.col("value")))
    at = [F.max(F.when(F.col("year") == y, F.col("value"))) for y in years]
    series = rows.groupBy(F.col("entity").alias("member")).agg(F.array(*at).alias("values"), F.count("value").alias("held"))
    return members.join(series, "member", "left").withColumn("held", F.coalesce("held", F.lit(0)))


def group_series(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """Observed and like-for-like sums per group and year.

    Observed sums what is there and says whether it is all there. Like-for-like sums the members that
    hold every year.
    """
    rows = year_vectors(members, obs, metric, years).withColumn("_complete", F.col("held") == len(years))
    sums = []
    for i in range(len(years)):
        value = F.get("values", F.lit(i))
        sums += [
            F.sum(value.cast(EXACT)).cast("double").alias(f"_sum{i}"), F.count(value).alias(f"_valid{i}"),
            F.sum(F.when(F.col("_complete"), value.cast(EXACT))).cast("double").alias(f"_same{i}"),
        ]
    # One row for each group: positions add up where the members are, so a group of any size moves one row a partition.
    added = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("members"), F.count_if("_complete").alias("common_members"), *sums)
    cells = F.array(*[
        F.struct(
            F.lit(y).alias("year"), F.col(f"_sum{i}").alias("observed"), F.col(f"_valid{i}").alias("valid"),
            F.col(f"_same{i}").alias("like_for_like"),
        )
        for i, y in enumerate(years)
    ])
    per_year = added.select("group_key", F.lit(metric).alias("metric"), "members", "common_members", F.inline(cells))
    missing = F.col("members") - F.col("valid")
    return per_year.select(
        "group_key", "metric", "year", "observed",
        (missing == 0).alias("complete"),
        F.when(missing > 0, "missing_member_observations").alias("partial_reason"),
        "valid", missing.alias("missing"),
        "like_for_like", "common_members",
        F.when(F.col("valid") == 0, "empty_input_set").alias("reason"),
    )


def missing_members(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """The members behind each gap, as rows."""
    rows = year_vectors(members, obs, metric, years).where(F.col("held") < len(years))
    return rows.select("group_key", F.lit(metric).alias("metric"), F.explode(_gaps(years)).alias("year"), "member")


def _gaps(years: list[int]) -> Column:
    """The years in which a vector holds nothing."""
    return F.filter(F.lit(years), lambda y, i: F.get("values", i).isNull())


def group_coverage(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """How much of each group there is: members used (those holding every year), and valid and missing ones per year."""
    series = group_series(members, obs, metric, years)
    return series.select(
        "group_key", "metric", "year", (F.col("valid") + F.col("missing")).alias("members"),
        F.col("common_members").alias("used"), (F.col("common_members") == F.col("valid") + F.col("missing")).alias("complete"),
        "valid", "missing",
    )


def member_coverage(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """The members behind the coverage of each group as rows: used or missing, with the years that a member lacks."""
    rows = year_vectors(members, obs, metric, years)
    role = F.when(F.col("held") == len(years), "used").otherwise("missing")
    return rows.select("group_key", F.lit(metric).alias("metric"), "member", role.alias("role"), _gaps(years).alias("missing_years"))


def point_coverage(entities: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """Single entities (countries or published aggregates) against the years that a comparison needs.

    ``entities``: (entity, is_aggregate). A point is used only if it holds every year. What a published aggregate is
    made of is not the common universe, which ``basis`` says.
    """
    points = entities.select(F.col("entity").alias("group_key"), F.col("entity").alias("member"), "is_aggregate")
    rows = year_vectors(points, obs, metric, years)
    return rows.select(
        F.col("member").alias("entity"), F.lit(metric).alias("metric"),
        F.when(F.col("is_aggregate"), "published_aggregate").otherwise("own_observation").alias("basis"),
        (F.col("held") == len(years)).alias("complete"), F.col("held").alias("years_held"), _gaps(years).alias("missing_years"),
    )


def membership_effect(series: DataFrame, first: int, last: int, value: str = "observed",
                      common: str = "like_for_like") -> DataFrame:
    """Observed change less like-for-like change between the first and last year."""
    def at(column, year):
        return F.max(F.when(F.col("year") == year, F.col(column)))

    ends = series.groupBy("group_key", "metric").agg(
        at(value, first).alias("obs_a"), at(value, last).alias("obs_b"),
        at(common, first).alias("lfl_a"), at(common, last).alias("lfl_b"),
    )
    effect = (F.col("obs_b") - F.col("obs_a")) - (F.col("lfl_b") - F.col("lfl_a"))
    return ends.withColumn("membership_effect", effect)


def group_ratio_series(members: DataFrame, obs: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """Sum of numerators over sum of denominators, x100; never a mean of member ratios.

    Strict: every member needs both legs, each leg one vintage. Like-for-like keeps the members that
    hold the metric itself in every year.
    """
    definition = METRICS[metric]
    numerator, denominator = METRICS[definition.numerator], METRICS[definition.denominator]
    compatible = (numerator.price_basis, numerator.currency_basis) == (
        denominator.price_basis, denominator.currency_basis
    )
    cells = member_cells(members, obs, [metric, numerator.key, denominator.key], years)
    stamp = F.col("vintage") if "vintage" in cells.columns else F.lit(None).cast("string")

    def leg(key, column=F.col("value")):
        return F.max(F.when(F.col("metric") == key, column))

    wide = cells.groupBy("group_key", "member", "year").agg(
        leg(metric).alias("own"), leg(numerator.key).alias("num"), leg(denominator.key).alias("den"),
        leg(numerator.key, stamp).alias("num_stamp"), leg(denominator.key, stamp).alias("den_stamp"),
    )
    held = F.count("own").over(Window.partitionBy("group_key", "member"))
    wide = wide.withColumn("_common", held == len(years))
    both = F.col("num").isNotNull() & F.col("den").isNotNull()
    aggregates = []
    for prefix, inside in (("obs", F.lit(True)), ("lfl", F.col("_common"))):
        used = inside & both
        aggregates += [
            F.count_if(inside).alias(f"{prefix}_members"),
            F.count_if(used).alias(f"{prefix}_valid"),
            F.sum(F.when(used, F.col("num").cast(EXACT))).cast("double").alias(f"{prefix}_num"),
            F.sum(F.when(used, F.col("den").cast(EXACT))).cast("double").alias(f"{prefix}_den"),
            # Two stamps differ exactly when the least and the greatest do.
            (F.min(F.when(used, F.col("num_stamp"))) != F.max(F.when(used, F.col("num_stamp")))).alias(f"{prefix}_num_mixed"),
            (F.min(F.when(used, F.col("den_stamp"))) != F.max(F.when(used, F.col("den_stamp")))).alias(f"{prefix}_den_mixed"),
        ]
    sums = wide.groupBy("group_key", "year").agg(
        *aggregates,
        F.count_if(F.col("num").isNull()).alias("missing_numerators"),
        F.count_if(F.col("den").isNull()).alias("missing_denominators"),
    )
    columns = []
    for prefix, name in (("obs", "observed"), ("lfl", "like_for_like")):
        count, valid = F.col(f"{prefix}_members"), F.col(f"{prefix}_valid")
        mixed = F.coalesce(F.col(f"{prefix}_num_mixed"), F.lit(False)) | F.coalesce(
            F.col(f"{prefix}_den_mixed"), F.lit(False)
        )
        base = F.col(f"{prefix}_den")
        reason = (
            F.when(F.lit(not compatible), "INCOMPATIBLE_LEGS")
            .when(valid < count, "MISSING_REQUIRED_DATA")
            .when(mixed, "INCOMPATIBLE_LEGS")
            .when(count == 0, "empty_input_set")
            .when(base == 0, "zero_base_for_percent_change")
            .when(base < 0, "negative_base_for_percent_change")
        )
        columns += [
            F.when(reason.isNull(), F.try_divide(F.col(f"{prefix}_num"), base) * 100).alias(name),
            reason.alias(f"{name}_reason"),
            valid.alias(f"{name}_members"),
        ]
    return sums.select(
        "group_key", F.lit(metric).alias("metric"), "year", *columns, "missing_numerators", "missing_denominators"
    )


def group_evaluation(members: DataFrame, obs: DataFrame, metrics: list[str], years: list[int]) -> DataFrame:
    """What a comparison could compute for a group, without computing it: capability and coverage."""
    legs = {m: METRICS[m].denominator for m in metrics}
    wanted = sorted(set(metrics) | {d for d in legs.values() if d})
    cells = member_cells(members, obs, wanted, years)
    counts = cells.groupBy("group_key", "metric", "year").agg(
        F.count("value").alias("valid"), F.count(F.lit(1)).alias("members")
    )
    denominators = text_map({m: d for m, d in legs.items() if d})
    base = counts.select(
        "group_key", F.col("metric").alias("denominator"), "year", F.col("valid").alias("denominator_valid")
    )
    computable = [m for m in metrics if METRICS[m].aggregation in ("SUM", "WEIGHTED_RATIO")]
    can = F.col("metric").isin(computable)
    asked = counts.where(F.col("metric").isin(metrics)).withColumn(
        "denominator", F.try_element_at(denominators, F.col("metric"))
    )
    return asked.join(base, ["group_key", "denominator", "year"], "left").select(
        "group_key", "metric", "year", "valid", (F.col("members") - F.col("valid")).alias("missing"),
        "denominator", "denominator_valid",
        can.alias("can_compute"), F.when(~can, "NOT_AGGREGATABLE").alias("reason"),
    )
