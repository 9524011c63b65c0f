"""Comparisons of two entities each - single, published aggregate or ad-hoc group - many at a time.

A request is planned on the driver into intervals (years it needs, statistic it takes). Everything else
is rows: the members of both sides, their yearly series, one formula set over the intervals, and rank
frames over all eligible entities, one per distinct plan rather than per request.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelyst.functions import transforms as T
from panelyst.functions.plan import struct_fields, plan_map, plan_rows, text_map
from panelyst.functions.years import after_start, closed, half_open
from panelyst.operators import bases as B
from panelyst.operators.entities import parse_specs, resolve_specs, spec_members
from panelyst.operators.ordered import EXACT, join_small, rank_rows
from panelyst.operators.placing import place
from panelyst.registry import (
    BASES, ENTITY_KINDS, LEG_BASES, METRICS, OPERATIONS, TRADE_METRICS, can_compare, gate_operation, rank_rule,
)
from panelyst.session import cut_lineage, written

PARTIAL = "COVERAGE_INCOMPLETE"
AGGREGATE = "AGGREGATE_COVERAGE_NOT_COMPARABLE"
MISSING = "MISSING_REQUIRED_DATA"


@dataclass(frozen=True)
class Request:
    key: str
    a: str
    b: str
    metric: str
    operation: str
    year_a: int
    year_b: int | None = None
    year_c: int | None = None
    mode: str = "observed"


@dataclass(frozen=True)
class Interval:
    name: str
    start: int
    end: int
    years: tuple[int, ...]
    later: tuple[int, ...] = ()
    statistic: str = "level"


@dataclass(frozen=True)
class Plan:
    required: tuple[int, ...] = ()
    series: tuple[int, ...] = ()
    intervals: tuple[Interval, ...] = field(default=())
    error: str | None = None


def _spans(a, b, c):
    if b is not None and c is not None:
        return [("AB", a, b), ("BC", b, c), ("AC", a, c)]
    end = c if c is not None else b
    return [] if end is None else [("AC" if c is not None else "AB", a, end)]


def resolve_plan(operation: str, metric: str, a: int | None, b: int | None = None, c: int | None = None) -> Plan:
    """Years, intervals and statistics of an operation, or the error that refuses it."""
    definition = OPERATIONS.get(operation)
    if definition is None:
        return Plan(error="INVALID_OPERATION")
    if a is None:
        return Plan(error="MISSING_YEAR")
    allowed, reason = gate_operation(operation, METRICS.get(metric))
    if not allowed:
        return Plan(error=reason)
    given = [y for y in (a, b, c) if y is not None]
    ordered = all(x < y for x, y in zip(given, given[1:]))
    if definition.kind == "single":
        if len(given) > 1:
            return Plan(error="INVALID_OPERATION")
        return Plan((a,), (a,), (Interval("A", a, a, (a,), statistic="CROSS_RATE"),))
    if definition.kind == "point":
        if len(set(given)) < len(given):
            return Plan(error="SAME_YEAR_SELECTED")
        if not ordered:
            return Plan(error="INVALID_YEAR_ORDER")
        points = tuple(Interval(str(y), y, y, (y,)) for y in given)
        return Plan(tuple(given), tuple(closed(given[0], given[-1])), points)
    spans = _spans(a, b, c)
    partitioned = definition.kind in ("partitioned", "partitioned_period")
    if not spans or (partitioned and c is None):
        return Plan(error="MISSING_YEAR")
    end = spans[-1][2]
    if definition.kind == "two_point" and end == a:
        return Plan(error="SAME_YEAR_SELECTED")
    if not ordered:
        return Plan(error="INVALID_YEAR_ORDER")
    if definition.kind == "two_point":
        made = [Interval(n, s, e, (s, e), statistic=definition.transform) for n, s, e in spans]
    elif definition.kind == "period":
        made = [Interval(n, s, e, tuple(half_open(s, e)), statistic=definition.transform) for n, s, e in spans]
    elif definition.kind == "movement_period":
        window = closed if metric in TRADE_METRICS else after_start
        made = [Interval(n, s, e, tuple(window(s, e)), statistic=definition.transform) for n, s, e in spans]
    elif operation == "segmented_growth":
        named = [("AM", a, b), ("MB", b, c), ("AB", a, c)] if b is not None else [("AC", a, c)]
        made = [Interval(n, s, e, (s, e), statistic="PERCENT") for n, s, e in named]
    elif b is None:
        made = [Interval("AC", a, c, tuple(half_open(a, c)), statistic="MISSING_MIDDLE_YEAR")]
    else:
        first, second = tuple(half_open(a, b)), tuple(half_open(b, c))
        made = [
            Interval("AB", a, b, first, statistic="PERIOD_SUM"),
            Interval("BC", b, c, second, statistic="PERIOD_SUM"),
            Interval("AC", a, c, first, second, definition.transform),
        ]
    required = sorted({y for i in made for y in i.years + i.later})
    return Plan(tuple(required), tuple(closed(a, end)), tuple(made))


# --- yearly series of both sides --------------------------------------------------------------------
def _request_frame(spark: SparkSession, requests: list[Request], plans: dict[str, Plan]) -> DataFrame:
    rows = []
    for r in requests:
        capability = [
            (ka, kb, can_compare(METRICS.get(r.metric), ka, kb, r.operation, r.a.strip() == r.b.strip())[1])
            for ka in ENTITY_KINDS for kb in ENTITY_KINDS
        ]
        metric = METRICS.get(r.metric)
        rows.append((
            r.key, r.a, r.b, r.metric, r.operation, r.mode, plans[r.key].error, list(plans[r.key].required),
            list(plans[r.key].series),
            {f"{ka}|{kb}": reason for ka, kb, reason in capability if reason},
            metric.gap_unit if metric else None,
        ))
    return spark.createDataFrame(
        rows,
        "request string, spec_a string, spec_b string, metric string, operation string, mode string,"
        "plan_error string, required array<int>, series array<int>, blocks map<string,string>, gap_unit string",
    )


def request_entities(obs_dim: DataFrame, requests: DataFrame) -> DataFrame:
    """Both sides of every request, parsed and resolved."""
    sides = requests.select("request", F.explode(F.array(
        F.struct(F.lit("a").alias("slot"), F.col("spec_a").alias("spec")),
        F.struct(F.lit("b").alias("slot"), F.col("spec_b").alias("spec")),
    )).alias("s")).select("request", "s.*").withColumn("label", F.lit(None).cast("string"))
    return resolve_specs(parse_specs(sides), obs_dim)


def _needed(obs: DataFrame, metrics: list[str], years: list[int]) -> DataFrame:
    legs = {leg for m in metrics for leg in (METRICS[m].numerator, METRICS[m].denominator) if leg}
    wanted = F.col("metric").isin(sorted(set(metrics) | legs)) & F.col("year").isin(years)
    return obs.where(wanted & T.finite(F.col("value"))).select("entity", "metric", "year", "value")


def _slot_values(obs: DataFrame, members: DataFrame, requests: DataFrame, metrics: list[str], years: list[int],
                 bound: int, span: str = "required") -> DataFrame:
    """Value of each slot in each year of ``span``, with whether it is complete.

    A group sums its members: those present (observed), or those holding every required year
    (like-for-like). A single entity shows what it holds; the caller admits it or not.
    """
    ratio = {m: METRICS[m] for m in metrics if METRICS[m].aggregation == "WEIGHTED_RATIO"}
    rows = _needed(obs, metrics, years)
    wanted = members.select(F.col("member").alias("entity")).distinct()
    # Members are bounded by the requests and the group size limit, so the panel is not shuffled.
    hits = join_small(rows, wanted, ["entity"], bound, "left_semi")
    asked = requests.select("request", "metric", "mode", "required", F.col(span).alias("_span"))
    cells = members.join(F.broadcast(asked), "request").select("*", F.explode("_span").alias("year"))
    by_member = hits.groupBy("entity", "year").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("values")
    ).withColumnRenamed("entity", "member")
    cells = cells.join(by_member, ["member", "year"], "left")

    def of(column: Column) -> Column:
        return F.try_element_at("values", column)

    def linked(part: str) -> Column:
        chain = F.lit(None).cast("string")
        for m, d in ratio.items():
            chain = F.when(F.col("metric") == m, F.lit(getattr(d, part))).otherwise(chain)
        return chain

    own = of(F.col("metric"))
    needed = F.when(F.array_contains("required", F.col("year")), F.col("own"))
    held = F.count(needed).over(Window.partitionBy("request", "slot", "member"))
    cells = cells.withColumn("own", own).withColumn("_complete", held == F.size("required"))
    cells = cells.withColumn("num", of(linked("numerator"))).withColumn("den", of(linked("denominator")))
    like = F.col("mode") == "like_for_like"
    used = ~like | F.col("_complete") | (F.col("kind") != "CUSTOM_GROUP")
    per = cells.groupBy("request", "slot", "kind", "metric", "mode", "year").agg(
        F.sum(F.when(used, F.col("own").cast(EXACT))).cast("double").alias("total"),
        F.count_if(used & F.col("own").isNotNull()).alias("valid"),
        F.count_if(used).alias("counted"),
        F.count(F.lit(1)).alias("members"),
        F.count_if(used & F.col("num").isNotNull() & F.col("den").isNotNull()).alias("both"),
        F.sum(F.when(used, F.col("num").cast(EXACT))).cast("double").alias("num"),
        F.sum(F.when(used, F.col("den").cast(EXACT))).cast("double").alias("den"),
    )
    group = F.col("kind") == "CUSTOM_GROUP"
    weighted = F.col("metric").isin(list(ratio)) if ratio else F.lit(False)
    group_ratio = F.when(
        (F.col("both") == F.col("counted")) & (F.col("counted") > 0) & (F.col("den") > 0),
        F.try_divide(F.col("num"), F.col("den")) * 100,
    )
    value = F.when(group & weighted, group_ratio).otherwise(F.col("total"))
    complete = F.when(like, value.isNotNull()).otherwise(F.col("valid") == F.col("members"))
    complete = F.when(group & weighted, F.col("both") == F.col("counted")).otherwise(complete)
    return per.select(
        "request", "slot", "kind", "metric", "mode", "year", value.alias("value"),
        (complete & value.isNotNull()).alias("complete"), "valid", "members",
    )


_CELL = (
    "position int; interval string; start int; end int; years array<int>; later array<int>; statistic string"
)


def _plan_cells(plan: Plan) -> list[dict]:
    return [
        {
            "position": n, "interval": i.name, "start": i.start, "end": i.end, "years": list(i.years),
            "later": list(i.later), "statistic": i.statistic,
        }
        for n, i in enumerate(plan.intervals)
    ]


def _evaluate(rows: DataFrame) -> DataFrame:
    """Value and reason of an interval over a map of yearly values. Needs ``values``, ``metric`` and the
    interval columns."""
    at = F.transform("years", lambda y: F.try_element_at("values", y))
    after = F.transform("later", lambda y: F.try_element_at("values", y))
    rows = rows.select("*", at.alias("_xs"), after.alias("_later"))
    zero = F.lit(0.0)
    cumulative = F.col("statistic") == "MOVEMENT_CUMULATIVE_INFLATION"
    rows = rows.select(
        "*",
        F.get("_xs", F.lit(0)).alias("_first"),
        F.try_element_at("_xs", F.lit(-1)).alias("_last"),
        F.when(F.col("statistic").contains("PERIOD") | cumulative, F.reduce("_xs", zero, lambda acc, v: acc + v)).alias("_total"),
        F.reduce("_later", zero, lambda acc, v: acc + v).alias("_later_total"),
        F.when(cumulative, F.reduce("_xs", F.lit(1.0), lambda acc, v: acc * (1 + v / 100))).alias("_product"),
    )
    first, last, total = F.col("_first"), F.col("_last"), F.col("_total")
    span = F.col("end") - F.col("start")
    incomplete = [(total.isNull(), "incomplete_period")]
    by_statistic = {
        "level": T.guarded([(first.isNull(), MISSING)], first),
        "ABSOLUTE": T.absolute_change(first, last),
        "PP": T.percentage_point_change(first, last),
        "INDEX_POINT": T.index_point_change(first, last),
        "PERCENT": T.percent_change(first, last),
        "CAGR": T.cagr(first, last, span),
        "CROSS_RATE": T.guarded([(first.isNull(), MISSING)], first),
        "PERIOD_SUM": T.guarded(incomplete, total),
        "PERIOD_AVG": T.guarded(incomplete, total / F.size("years")),
        "MOVEMENT_PERIOD_TOTAL": T.guarded(incomplete, total),
        "MOVEMENT_PERIOD_AVERAGE": T.guarded(incomplete, total / F.size("years")),
        "MOVEMENT_CUMULATIVE_INFLATION": T.guarded(incomplete, (F.col("_product") - 1) * 100),
        "PERIOD_SUM_PERCENT_CHANGE": T.period_growth(total, F.col("_later_total")),
        "MISSING_MIDDLE_YEAR": T.Outcome(F.lit(None).cast("double"), F.lit("MISSING_MIDDLE_YEAR")),
    }
    kept = [c for c in rows.columns if not c.startswith("_")]
    return T.with_outcome(rows, T.choose("statistic", by_statistic)).select(*kept, "value", "reason")


def rank_frames(eligible: DataFrame, plans: dict[tuple, Plan], participants: DataFrame, *, few_bound: int,
                group_bound: int, rows_bound: int | None) -> DataFrame | None:
    """Rank of the participants (frame, entity) among all eligible entities, in every ranked plan interval.

    Columns: frame, interval, entity, rank, n. Everyone's statistic is needed to count who stands before them, but
    nothing is ordered. ``few_bound`` bounds the participants, ``group_bound`` those of one frame.
    """
    ranked = {}
    for (metric, operation, mode, years), plan in plans.items():
        kind = OPERATIONS[operation].kind
        if kind not in ("point", "two_point", "movement_period") or plan.error:
            continue
        rule = rank_rule(METRICS[metric], "level" if kind == "point" else "derived")
        if rule:
            ranked[(metric, operation, mode, years)] = (plan, rule)
    if not ranked:
        return None
    metrics = sorted({key[0] for key in ranked})
    years = sorted({y for plan, _ in ranked.values() for y in plan.required})
    rows = eligible.where(F.col("metric").isin(metrics) & F.col("year").isin(years) & T.finite(F.col("value")))
    layout = plan_rows(
        [
            {
                "frame": frame_key(*key), "of": key[0], "mode": key[2], "rule": rule[0],
                "sign": -1.0 if rule[1] == "ASC" else 1.0, "required": list(plan.required), "cells": _plan_cells(plan),
            }
            for key, (plan, rule) in ranked.items()
        ],
        "frame string; of string; mode string; rule string; sign double; required array<int>;"
        f"cells array<struct<{struct_fields(_CELL)}>>",
    )

    def evaluated(rows: DataFrame) -> DataFrame:
        series = rows.groupBy("metric", "entity").agg(
            F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("values")
        )
        laid = series.select("*", F.explode(layout).alias("f")).where(F.col("f.of") == F.col("metric"))
        complete = F.forall("f.required", lambda y: F.try_element_at("values", y).isNotNull())
        laid = laid.where((F.col("f.mode") != "like_for_like") | complete)
        laid = laid.select(
            "metric", "entity", "values", "f.frame", "f.rule", "f.sign", F.explode("f.cells").alias("c")
        ).select("metric", "entity", "values", "frame", "rule", "sign", "c.*")
        done = _evaluate(laid).where(F.col("reason").isNull())
        return done.select("frame", "interval", "entity", "rule", (F.col("value") * F.col("sign")).alias("_signed"))

    mine = join_small(rows, participants.select("entity").distinct(), ["entity"], few_bound, "left_semi")
    few = join_small(evaluated(mine), participants.distinct(), ["frame", "entity"], few_bound, "left_semi")
    most = max(len(plan.intervals) for plan, _ in ranked.values())
    out = place(evaluated(rows), few, ["frame", "interval"], "_signed", few_bound=few_bound * most,
                group_bound=group_bound, rank="_ordinal", competition="_tied", rows_bound=rows_bound)
    rank = F.when(F.col("rule") == "ordinal", F.col("_ordinal")).otherwise(F.col("_tied"))
    return out.select("frame", "interval", "entity", rank.alias("rank"), "n")


def frame_key(metric: str, operation: str, mode: str, years: tuple) -> str:
    return "|".join([metric, operation, mode, *("-" if y is None else str(y) for y in years)])


def compare(obs: DataFrame, dim: DataFrame, requests: list[Request], *, rows_bound: int | None = None) -> DataFrame:
    """One row per request and interval: both values with reasons and ranks, the gap and what blocks it.

    ``block`` names the first obstacle in the fixed order: aggregate in like-for-like, capability,
    partial coverage, missing data.
    """
    spark = obs.sparkSession
    plans = {r.key: resolve_plan(r.operation, r.metric, r.year_a, r.year_b, r.year_c) for r in requests}
    frame = _request_frame(spark, requests, plans)
    # Sides and observations are read by several branches; both are fixed once.
    entities = cut_lineage(request_entities(dim, frame))
    usable = [r for r in requests if not plans[r.key].error]
    if not usable:
        raise ValueError(f"no usable request: { {r.key: plans[r.key].error for r in requests} }")
    members = spec_members(entities.select("request", "slot", "kind", "members", "error_code", "name", "label"))
    metrics = sorted({r.metric for r in usable})
    years = sorted({y for r in usable for y in plans[r.key].required})
    bound = members.count()
    obs = written(_needed(obs, metrics, years))
    values = _slot_values(obs, members, frame, metrics, years, bound)
    entry = F.struct("year", "value")
    series = values.groupBy("request", "slot", "kind", "metric", "mode").agg(
        F.map_from_entries(F.collect_list(entry)).alias("values"),
        F.collect_set(F.when(F.col("value").isNotNull() & ~F.col("complete"), F.col("year"))).alias("partial_years"),
        F.count("value").alias("present"),
        F.max(F.struct("members")).alias("_m"),
    )
    cells = plan_map({r.key: _plan_cells(plans[r.key]) for r in usable}, _CELL)[F.col("request")]
    laid = series.select("*", F.explode(cells).alias("c")).select("*", "c.*").drop("c", "_m")
    required = frame.select("request", F.size("required").alias("_required"))
    laid = laid.join(F.broadcast(required), "request")
    # A single entity outside the common universe is out in every interval.
    admitted = (F.col("mode") != "like_for_like") | (F.col("kind") == "CUSTOM_GROUP") | (
        F.col("present") == F.col("_required")
    )
    laid = laid.withColumn("values", F.when(admitted, F.col("values")).otherwise(F.create_map().cast("map<int,double>")))
    done = _evaluate(laid)
    touched = F.size(F.array_intersect(F.array_union("years", "later"), "partial_years")) > 0
    level = F.col("statistic").isin("level")
    done = done.withColumn("partial", touched)
    done = done.withColumn("reason", F.when(touched & ~level, PARTIAL).otherwise(F.col("reason")))
    done = done.withColumn("value", F.when(touched & ~level, F.lit(None)).otherwise(F.col("value")))

    frame_of = {r.key: frame_key(r.metric, r.operation, r.mode, (r.year_a, r.year_b, r.year_c)) for r in usable}
    named = text_map(frame_of)
    single = members.where(F.col("kind") == "COUNTRY").select(
        "request", "slot", named[F.col("request")].alias("frame"), F.col("member").alias("entity")
    ).where(F.col("frame").isNotNull())
    frames = rank_frames(
        obs.join(dim.where(~F.col("is_aggregate")).select("entity"), "entity", "left_semi"),
        {(r.metric, r.operation, r.mode, (r.year_a, r.year_b, r.year_c)): plans[r.key] for r in usable},
        single.select("frame", "entity"), few_bound=bound, group_bound=2 * max(Counter(frame_of.values()).values()),
        rows_bound=rows_bound,
    )
    if frames is not None:
        placed = join_small(frames, single, ["frame", "entity"], bound, "inner").select(
            "request", "slot", "interval", "rank", "n"
        )
        done = done.join(placed, ["request", "slot", "interval"], "left")
    else:
        done = done.withColumn("rank", F.lit(None).cast("long")).withColumn("n", F.lit(None).cast("long"))
    done = done.withColumn("rank", F.when(F.col("value").isNotNull(), F.col("rank")))

    per = ["request", "interval", "position", "start", "end", "statistic"]

    def side(slot, column):
        return F.max(F.when(F.col("slot") == slot, F.col(column)))

    both = done.groupBy(*per).agg(*[
        side(s, c).alias(f"{s}_{c}") for s in ("a", "b") for c in ("kind", "value", "reason", "partial", "rank", "n")
    ])
    both = both.join(F.broadcast(frame.select("request", "metric", "operation", "mode", "blocks", "gap_unit")), "request")
    a, b = F.col("a_value"), F.col("b_value")
    hard = F.try_element_at("blocks", F.concat("a_kind", F.lit("|"), "b_kind"))
    aggregate = (F.col("mode") == "like_for_like") & (
        (F.col("a_kind") == "OFFICIAL_AGGREGATE") | (F.col("b_kind") == "OFFICIAL_AGGREGATE")
    )
    partial = F.col("a_partial") | F.col("b_partial")
    none = a.isNull() | b.isNull()
    cross = F.col("statistic") == "CROSS_RATE"
    # A level keeps a partial subtotal visible but takes no difference of it.
    level_reason = (
        F.when(none, MISSING).when(hard.isNotNull(), hard).when(partial, PARTIAL).when(aggregate, AGGREGATE)
    )
    cross_reason = F.when(hard.isNotNull(), hard).when(none | (a <= 0) | (b <= 0), MISSING)
    other_reason = (
        F.when(hard.isNotNull(), hard)
        .when(aggregate, AGGREGATE)
        .when(F.col("a_reason").isNotNull(), F.col("a_reason"))
        .when(F.col("b_reason").isNotNull(), F.col("b_reason"))
    )
    gap_reason = F.when(F.col("statistic") == "level", level_reason).when(cross, cross_reason).otherwise(other_reason)
    gap = F.when(cross, F.try_divide(a, b)).otherwise(a - b)
    middle = F.col("statistic") == "MISSING_MIDDLE_YEAR"
    block = (
        F.when(middle, "MISSING_MIDDLE_YEAR")
        .when(aggregate, AGGREGATE)
        .when(hard.isNotNull(), hard)
        .when(partial, PARTIAL)
        .when(gap_reason.isNotNull(), MISSING)
    )
    points = F.col("statistic").isin("PERCENT", "CAGR", "PERIOD_SUM_PERCENT_CHANGE", "MOVEMENT_CUMULATIVE_INFLATION", "PP", "MISSING_MIDDLE_YEAR")
    unit = (
        F.when(cross, "cross_rate").when(points, "percentage points")
        .when(F.col("statistic") == "INDEX_POINT", "index points").otherwise(F.col("gap_unit"))
    )
    return both.select(
        "request", "metric", "operation", "mode", "interval", "position", "start", "end",
        "a_value", "a_reason", "a_rank", "a_n", "b_value", "b_reason", "b_rank", "b_n",
        F.when(gap_reason.isNull(), gap).alias("gap"), gap_reason.alias("gap_reason"), block.alias("block"),
        unit.alias("gap_unit"),
    )


def refused_requests(requests: list[Request], dim: DataFrame) -> DataFrame:
    """Requests that cannot be answered, with the first error found."""
    spark = dim.sparkSession
    plans = {r.key: resolve_plan(r.operation, r.metric, r.year_a, r.year_b, r.year_c) for r in requests}
    frame = _request_frame(spark, requests, plans)
    bad = request_entities(dim, frame).groupBy("request").agg(
        F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("slot"))).alias("entity_error")
    )
    out = frame.join(bad, "request").select("request", F.coalesce("plan_error", "entity_error").alias("error"))
    return out.where(F.col("error").isNotNull())


def slot_series(obs: DataFrame, dim: DataFrame, requests: list[Request]) -> DataFrame:
    """Chart points of both sides over the whole series; a partial group year is a gap."""
    plans = {r.key: resolve_plan(r.operation, r.metric, r.year_a, r.year_b, r.year_c) for r in requests}
    usable = [r for r in requests if not plans[r.key].error]
    frame = _request_frame(obs.sparkSession, usable, plans)
    entities = cut_lineage(request_entities(dim, frame))
    members = spec_members(entities.select("request", "slot", "kind", "members", "error_code", "name", "label"))
    years = sorted({y for r in usable for y in plans[r.key].series})
    values = _slot_values(
        obs, members, frame, sorted({r.metric for r in usable}), years, members.count(), "series"
    )
    return values.select(
        "request", "slot", "kind", "year", F.when(F.col("complete"), F.col("value")).alias("value"),
        "complete", "valid", (F.col("members") - F.col("valid")).alias("missing"),
    )


# --- bases built from several legs -------------------------------------------------------------------
def compare_basis(obs: DataFrame, dim: DataFrame, basis_key: str, pairs: list[tuple[str, str, str]], a: int, b: int,
                  m: int | None = None, *, operation: str = "level", mode: str = "observed",
                  rows_bound: int | None = None) -> DataFrame:
    """Compare over a ratio basis. Groups sum each leg first and take the ratio of the sums.

    ``pairs`` holds (request, entity spec, entity spec). Like-for-like members must be calculable in
    every selected year or interval.
    """
    if basis_key not in LEG_BASES or operation not in LEG_BASES[basis_key]:
        raise ValueError("UNSUPPORTED_TRANSFORMATION")
    basis = BASES[basis_key]
    spark = obs.sparkSession
    frame = spark.createDataFrame(pairs, "request string, spec_a string, spec_b string")
    entities = cut_lineage(request_entities(dim, frame))
    members = spec_members(entities.select("request", "slot", "kind", "members", "error_code", "name", "label"))
    years = B.years_needed([basis], a, b, m)
    obs = written(obs.where(F.col("metric").isin(list(basis.legs)) & F.col("year").isin(years)))
    eligible = obs.join(dim.where(~F.col("is_aggregate")).select("entity"), "entity", "left_semi")
    movement = B.basis_movement(eligible, [basis], a, b, m, rows_bound=rows_bound)
    periods = len(B.periods_of(basis, a, b, m))

    bound = members.count()
    wanted = members.select(F.col("member").alias("entity")).distinct()
    rows = obs.where(T.finite(F.col("value")))
    hits = join_small(rows, wanted, ["entity"], bound, "left_semi").withColumnRenamed("entity", "member")
    inside = members
    if mode == "like_for_like":
        # Group members outside the common set leave the sums; single entities stay as they are.
        common = join_small(B.common_rows(movement, periods), wanted, ["entity"], bound, "left_semi")
        kept = common.select(F.col("entity").alias("member"), F.lit(True).alias("_common"))
        inside = members.join(kept, "member", "left")
        inside = inside.where(F.coalesce("_common", F.lit(False)) | (F.col("kind") != "CUSTOM_GROUP"))
    plan = plan_rows([{"metric": leg, "year": y} for leg in basis.legs for y in years], "metric string; year int")
    cells = inside.select("request", "slot", "kind", "member", F.explode(plan).alias("c")).select(
        "request", "slot", "kind", "member", "c.*"
    )
    sums = cells.join(hits, ["member", "metric", "year"], "left").groupBy("request", "slot", "kind", "metric", "year").agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("value").cast(EXACT)).cast("double")).alias("value")
    )
    entity = F.concat_ws("|", "request", "slot", "kind")
    legs = B.entity_legs(sums.withColumn("entity", entity), [basis], years)
    laid = B._lay_out(legs, B._cells([basis], a, b, m), list(dict.fromkeys(sorted(basis.legs))))
    done = T.with_outcome(laid, B._outcome()).select("entity", "period", "start", "end", "value", "reason")
    part = F.split("entity", "\\|")
    done = done.select(
        part[0].alias("request"), part[1].alias("slot"), part[2].alias("kind"), "period", "start", "end", "value", "reason"
    )
    single = members.where(F.col("kind") == "COUNTRY").select("request", "slot", F.col("member").alias("entity"))
    universe = "like_for_like" if mode == "like_for_like" else "observed"
    places = movement.where((F.col("universe") == universe) & F.col("rank").isNotNull())
    if operation != "level":
        # The change of the yearly statistic is itself ranked, over every eligible entity.
        transform = OPERATIONS[operation].transform
        chosen = [y for y in (a, m, b) if y is not None]
        done = _between_years(done, transform, chosen, ["request", "slot", "kind"])
        changes = _between_years(places, transform, chosen, ["entity"]).where(F.col("reason").isNull())
        places = rank_rows(changes, ["period"], "value", rank="_at", competition="rank", rows_bound=rows_bound)
    ranks = join_small(places, single, ["entity"], bound, "inner").select("request", "slot", "period", "rank", "n")
    done = done.join(ranks, ["request", "slot", "period"], "left")
    done = done.withColumn("rank", F.when(F.col("value").isNotNull(), F.col("rank")))

    def side(slot, column):
        return F.max(F.when(F.col("slot") == slot, F.col(column)))

    spans = [{"period": p, "start": s, "end": e} for p, s, e in _basis_spans(basis, operation, a, b, m)]
    spans = plan_rows(spans, "period string; start int; end int")
    slots = frame.select("request", F.explode(spans).alias("p")).select("request", "p.*")
    kinds = entities.groupBy("request").agg(*[side(s, "kind").alias(f"{s}_kind") for s in ("a", "b")])
    both = done.groupBy("request", "period").agg(*[
        side(s, c).alias(f"{s}_{c}") for s in ("a", "b") for c in ("value", "reason", "rank", "n")
    ])
    both = slots.join(kinds, "request").join(both, ["request", "period"], "left")
    blocked = F.lit(mode == "like_for_like") & (
        (F.col("a_kind") == "OFFICIAL_AGGREGATE") | (F.col("b_kind") == "OFFICIAL_AGGREGATE")
    )
    reason = (
        F.when(blocked, AGGREGATE)
        .when(F.col("a_value").isNull(), F.coalesce("a_reason", F.lit(MISSING)))
        .when(F.col("b_value").isNull(), F.coalesce("b_reason", F.lit(MISSING)))
    )
    return both.select(
        "request", F.lit(basis_key).alias("basis"), F.lit(operation).alias("operation"), F.lit(mode).alias("mode"),
        "period", "start", "end", "a_value", "a_rank", "a_n", "b_value", "b_rank", "b_n",
        F.when(reason.isNull(), F.col("a_value") - F.col("b_value")).alias("gap"), reason.alias("gap_reason"),
    )


def _basis_spans(basis, operation, a, b, m):
    spans = B.periods_of(basis, a, b, m)
    if operation == "level":
        return spans
    return [(f"{s}-{e}", s, e) for s, e in _year_pairs([y for y in (a, m, b) if y is not None])]


def _year_pairs(years):
    return [(years[0], years[1])] if len(years) == 2 else [(years[0], years[1]), (years[1], years[2]), (years[0], years[2])]


def _between_years(done: DataFrame, transform: str, years: list[int], keys: list[str]) -> DataFrame:
    """Change of a yearly ratio between each pair of selected years."""
    by_year = done.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("start", F.struct("value", "reason")))).alias("_y")
    )
    plan = plan_rows([{"start": s, "end": e} for s, e in _year_pairs(years)], "start int; end int")
    laid = by_year.select("*", F.explode(plan).alias("_p")).select("*", "_p.*")
    first, last = F.try_element_at("_y", F.col("start")), F.try_element_at("_y", F.col("end"))
    change = {"PP": T.percentage_point_change, "ABSOLUTE": T.absolute_change}[transform](first["value"], last["value"])
    return laid.select(
        *keys, F.concat_ws("-", "start", "end").alias("period"), "start", "end",
        change.value.alias("value"), F.coalesce(first["reason"], last["reason"], change.reason).alias("reason"),
    )
