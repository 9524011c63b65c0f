"""The family statistics: one operator for every basis in the registry.

The panel is shuffled once, by entity, into a map of years per leg. The request is laid out beside
each entity as one cell per basis and period, and one set of formulas works on the cells. Strict
completeness needs no counting: a sum over a missing year is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions import transforms as T
from panelyst.functions.plan import plan_rows, text_map
from panelyst.functions.years import check_years, intervals, window_years
from panelyst.operators.ordered import EXACT, group_bound, group_facts, join_small, rank_rows
from panelyst.registry import FOCUS_MINUS_PEER, Basis

GROUP = ["basis", "period", "universe"]
GROUP_COLUMNS = ("income_level", "region", "lending_type")


def restrict_to_group(obs: DataFrame, dim: DataFrame, column: str, value: str) -> DataFrame:
    """Entities of one dimension value, applied before any statistic. An unknown value is an error."""
    if column not in GROUP_COLUMNS:
        raise ValueError("UNKNOWN_GROUP_TYPE")
    members = dim.where((F.col(column) == value) & ~F.col("is_aggregate")).select("entity")
    if members.limit(1).isEmpty():
        raise ValueError("UNKNOWN_GROUP_VALUE")
    return obs.join(members, "entity", "left_semi")


def group_catalogue(dim: DataFrame) -> DataFrame:
    """Eligible entities per value of each group column."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("group_type"), F.col(c).alias("group_value")) for c in GROUP_COLUMNS
    ]))
    rows = dim.where(~F.col("is_aggregate")).select(cells.alias("g")).select("g.*")
    rows = rows.where(F.col("group_value").isNotNull())
    return rows.groupBy("group_type", "group_value").agg(F.count(F.lit(1)).alias("entities"))


def _outcome() -> T.Outcome:
    """Value or reason of a laid-out cell, by its statistic.

    Works on the cell's own columns, so each formula stands in the plan once however many bases and
    periods are asked for and however long they are.
    """
    c = F.col
    first, last, span = c("x_first"), c("x_last"), c("end") - c("start")
    own_gap, leg_gap = c("x_gap"), c("x_gap") | c("y_gap")
    incomplete = [(own_gap, "incomplete_period")]
    base = c("y_total")
    share_value = F.try_divide(c("x_total"), base) * 100
    capital = [(base == 0, "zero_gdp_base"), (base < 0, "negative_gdp_base")]
    by_stat = {
        "level": T.guarded([(first.isNull(), "missing_value")], first),
        "index_change": T.index_period_change(first, last),
        "ends_change": T.positive_base_change(first, last),
        "annual_change": T.positive_base_change(first, last),
        "difference": T.endpoint_difference(first, last),
        "trade_cagr": T.trade_cagr(first, last, span),
        "total": T.guarded(incomplete, c("x_total")),
        "average": T.guarded(incomplete, c("x_total") / F.size("years")),
        "compound": T.guarded(incomplete, (c("x_product") - 1) * 100),
        "leg_ratio": T.gdp_ratio(first, c("y_first")),
        "months": T.reserve_months(first, c("y_first")),
        "mean_ratio": T.Outcome(c("ratio_total") / F.size("years"), c("ratio_reason")),
        "capital_share": T.guarded([(leg_gap, "incomplete_period"), *capital], share_value),
        "share": T.guarded(
            [(leg_gap, "incomplete_period"), (base <= 0, "non_positive_gdp_base")], share_value
        ),
    }
    return T.choose("stat", by_stat)


def periods_of(basis: Basis, a: int, b: int, m: int | None = None) -> list[tuple[str, int, int]]:
    a, m, b = check_years(a, b, m)
    if basis.scope == "year":
        return [(str(y), y, y) for y in (a, m, b) if y is not None]
    return intervals(a, b, m)


def candidate_years(basis: Basis, a: int, b: int, m: int | None) -> list[int]:
    """Years whose rows make an entity a candidate: the span the basis reads."""
    chosen = [y for y in (a, m, b) if y is not None]
    if basis.family == "external":
        return window_years("closed", a, b)
    if basis.scope == "year":
        return sorted({y for c in chosen for y in window_years(basis.window, c)})
    if basis.family == "fx":
        return chosen
    if basis.stat == "share" or (basis.family == "prices" and basis.window == "after_start"):
        return window_years("after_start", a, b)
    return window_years("closed", a, b)


def years_needed(bases: list[Basis], a: int, b: int, m: int | None) -> list[int]:
    needed = set()
    for basis in bases:
        needed |= set(candidate_years(basis, a, b, m))
        for _, s, e in periods_of(basis, a, b, m):
            needed |= set(window_years(basis.window, s, e))
    return sorted(needed)


def entity_legs(obs: DataFrame, bases: list[Basis], years: list[int]) -> DataFrame:
    """One row per entity, one year-to-value map per leg; only the needed metrics and years are read."""
    legs = sorted({leg for basis in bases for leg in basis.legs})
    wanted = obs.where(F.col("metric").isin(legs) & F.col("year").isin(years) & T.finite(F.col("value")))
    entry = F.struct("year", "value")
    return wanted.groupBy("entity").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("metric") == leg, entry))).alias(leg) for leg in legs
    ])


_CELL = (
    "basis string; period string; start int; end int; stat string; own string; leg string; years array<int>;"
    "common_rule string; common_years array<int>; start_years array<int>; seen_years array<int>; seen_in_leg boolean"
)


def _cells(bases: list[Basis], a: int, b: int, m: int | None) -> Column:
    """The plan of the request as rows: one struct per basis and period."""
    chosen = [y for y in (a, m, b) if y is not None]
    out = []
    for basis in bases:
        shared = {
            "basis": basis.key,
            "stat": "capital_share" if basis.stat == "share" and basis.family == "capital" else basis.stat,
            "own": basis.legs[0],
            "leg": (basis.legs + ("",))[1],
            "common_rule": basis.common,
            "common_years": window_years(basis.window, a, b) if basis.common == "window" else chosen,
            "start_years": chosen[:-1] if basis.common == "positive_starts" else [],
            "seen_years": candidate_years(basis, a, b, m),
            "seen_in_leg": basis.family == "external",
        }
        for period, s, e in periods_of(basis, a, b, m):
            out.append(shared | {"period": period, "start": s, "end": e, "years": window_years(basis.window, s, e)})
    return plan_rows(out, _CELL)


def _pick(legs: list[str], name: str) -> Column:
    chain = None
    for leg in legs:
        chain = (F.when if chain is None else chain.when)(F.col(name) == leg, F.col(leg))
    return chain


def _at(series: str, year: Column) -> Column:
    return F.try_element_at(F.col(series), year)


def _common() -> Column:
    """Membership of the one like-for-like set of a basis, frozen over all its periods."""
    def computable(y):
        x, other = _at("x", y), _at("y", y)
        paired = F.coalesce(other > 0, F.lit(False))
        return (
            F.when(F.col("stat") == "annual_change", F.coalesce(_at("x", y - 1) > 0, F.lit(False)) & x.isNotNull())
            .when(F.col("stat").isin("leg_ratio", "months"), paired & x.isNotNull())
            .otherwise(x.isNotNull())
        )

    def held(y):
        return _at("x", y).isNotNull() & ((F.col("leg") == "") | _at("y", y).isNotNull())

    rule = F.col("common_rule")
    return F.when(rule == "computable", F.forall("common_years", computable)).otherwise(
        F.forall("common_years", held)
        & F.forall("start_years", lambda y: F.coalesce(_at("x", y) > 0, F.lit(False)))
    )


def _lay_out(rows: DataFrame, cells: Column, legs: list[str]) -> DataFrame:
    """One row per entity and cell, with the figures the formulas read."""
    laid = rows.select("*", F.explode(cells).alias("_cell")).select("*", "_cell.*")
    laid = laid.select(
        "*", _pick(legs, "own").alias("x"), _pick(legs, "leg").alias("y")
    ).drop("_cell", *legs)
    laid = laid.select(
        "*",
        F.transform("years", lambda y: _at("x", y)).alias("xs"),
        F.transform("years", lambda y: _at("y", y)).alias("ys"),
    )
    zero = F.lit(0.0)
    ratios = F.transform("years", lambda y: T.gdp_ratio(_at("x", y), _at("y", y)).struct())
    laid = laid.select("*", F.when(F.col("stat") == "mean_ratio", ratios).alias("ratios"))
    return laid.select(
        "entity", "basis", "period", "start", "end", "stat", "years",
        F.get("xs", F.lit(0)).alias("x_first"),
        F.try_element_at("xs", F.lit(-1)).alias("x_last"),
        F.exists("xs", lambda v: v.isNull()).alias("x_gap"),
        F.reduce("xs", zero, lambda acc, v: acc + v).alias("x_total"),
        F.reduce("xs", F.lit(1.0), lambda acc, v: acc * (1 + v / 100)).alias("x_product"),
        F.get("ys", F.lit(0)).alias("y_first"),
        F.exists("ys", lambda v: v.isNull()).alias("y_gap"),
        F.reduce("ys", zero, lambda acc, v: acc + v).alias("y_total"),
        F.reduce("ratios", zero, lambda acc, r: acc + r["value"]).alias("ratio_total"),
        F.get(F.filter(F.transform("ratios", lambda r: r["reason"]), lambda r: r.isNotNull()), F.lit(0)).alias("ratio_reason"),
        _common().alias("common"),
        F.exists(
            "seen_years",
            lambda y: _at("x", y).isNotNull() | (F.col("seen_in_leg") & F.coalesce(_at("y", y).isNotNull(), F.lit(False))),
        ).alias("seen"),
    )


def basis_values(obs: DataFrame, bases: list[Basis], a: int, b: int, m: int | None = None) -> DataFrame:
    """Value or reason of every basis, period and candidate entity, in both universes."""
    a, m, b = check_years(a, b, m)
    rows = entity_legs(obs, bases, years_needed(bases, a, b, m))
    laid = _lay_out(rows, _cells(bases, a, b, m), [c for c in rows.columns if c != "entity"])
    universes = F.when(
        F.col("common"), F.array(F.lit("observed"), F.lit("like_for_like"))
    ).otherwise(F.array(F.lit("observed")))
    done = T.with_outcome(laid.where("seen"), _outcome())
    return done.select(
        "basis", "period", "start", "end", F.explode(universes).alias("universe"), "entity", "value", "reason"
    )


def _by_basis(bases: list[Basis], pick) -> Column:
    chain = None
    for basis in bases:
        value = pick(basis)
        if value is not None:
            chain = (F.when if chain is None else chain.when)(F.col("basis") == basis.key, F.lit(value))
    return F.lit(None) if chain is None else chain


def leave_one_out_median(position: Column, n: Column, low: Column, middle: Column, high: Column) -> Column:
    """Median of the other n-1 values, from the group's central order statistics.

    ``low``, ``middle`` and ``high`` sit at ordinal n//2, n//2+1 and n//2+2. Dropping a row shifts
    every later one down by one place.
    """
    half = F.floor(n / 2)
    first = F.when(half < position, low).otherwise(middle)
    second = F.when(half + 1 < position, middle).otherwise(high)
    return F.when(n <= 1, F.lit(None)).when(n % 2 == 0, first).otherwise((first + second) / 2)


def basis_movement(obs: DataFrame, bases: list[Basis], a: int, b: int, m: int | None = None, *,
                   rows_bound: int | None = None) -> DataFrame:
    """Values, competition ranks and leave-one-out benchmarks for every entity as the focus.

    Rows that cannot be computed keep their reason and take no part in ranks or benchmarks.
    """
    rows = basis_values(obs, bases, a, b, m)
    direction = _by_basis(bases, lambda basis: {"ASC": -1.0, "DESC": 1.0}.get(basis.direction))
    rows = rows.withColumn("_ok", F.col("reason").isNull())
    signed = F.col("value") * F.coalesce(direction, F.lit(1.0))
    bound = group_bound(rows, GROUP, rows_bound)
    # A value that cannot be computed is null and comes after every ranked one.
    rows = rank_rows(rows, GROUP, signed, rank="_at", competition="_rank", total="_all", rows_bound=bound)
    groups = sum(len(periods_of(basis, a, b, m)) for basis in bases) * 2
    counts = {"n": F.count_if("_ok"), "incomplete": F.count_if(~F.col("_ok"))}
    rows = group_facts(rows, GROUP, counts, rows_bound=bound, groups_bound=groups)
    half = F.floor(F.col("n") / 2)
    central = {f"_c{i}": F.max(F.when(F.col("_at") == half + i, F.col("value"))) for i in range(3)}
    total = {"_sum": F.sum(F.col("value").cast(EXACT))}
    rows = group_facts(rows, GROUP, central | total, rows_bound=bound, groups_bound=groups)
    n = F.col("n")
    mean = F.try_divide(F.col("_sum").cast("double") - F.col("value"), n - 1)
    median = leave_one_out_median(F.col("_at"), n, F.col("_c0"), F.col("_c1"), F.col("_c2"))
    kind = _by_basis(bases, lambda basis: basis.benchmark)
    benchmark = F.when(F.col("_ok"), F.when(kind == "median", median).when(kind == "mean", mean))
    focus_first = _by_basis(bases, lambda basis: basis.gap) == FOCUS_MINUS_PEER
    gap = F.when(focus_first, F.col("value") - benchmark).otherwise(benchmark - F.col("value"))
    ranked = F.col("_ok") & direction.isNotNull()
    return rows.select(
        *GROUP, "start", "end", "entity", "value", "reason",
        F.when(ranked, F.col("_rank")).alias("rank"),
        n.alias("n"),
        "incomplete",
        benchmark.alias("benchmark"),
        F.when(ranked, n - 1).alias("peers"),
        gap.alias("gap"),
        F.when(ranked & (n <= 1), "insufficient_comparison_universe").alias("benchmark_reason"),
    )


# metric: the descriptive figure shown beside its bases
COMPANIONS = {
    "inflation_cpi_index": "index_point_change",
    "exports_current": "endpoint_change",
    "imports_current": "endpoint_change",
    "fdi_inflows": "fdi_flow_change",
    "fdi_inflows_pct_gdp": "fdigdp_ratio_change",
    "fx_official": "display_cagr",
    "population_total": "display_cagr",
}


def companions(obs: DataFrame, a: int, b: int, m: int | None = None) -> DataFrame:
    """Descriptive figures shown beside a basis. They are never ranked."""
    spans = intervals(a, b, m)
    years = sorted({y for _, s, e in spans for y in (s, e)})
    rows = obs.where(F.col("metric").isin(list(COMPANIONS)) & F.col("year").isin(years))
    rows = rows.groupBy("entity", "metric").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("own")
    )
    plan = plan_rows([{"period": p, "start": s, "end": e} for p, s, e in spans], "period string; start int; end int")
    kinds = text_map(COMPANIONS)
    laid = rows.select("*", kinds[F.col("metric")].alias("kind"), F.explode(plan).alias("_plan"))
    laid = laid.select(
        "entity", "metric", "kind", "_plan.*",
        _at("own", F.col("_plan.start")).alias("_s"), _at("own", F.col("_plan.end")).alias("_e"),
    )
    start, end, span = F.col("_s"), F.col("_e"), F.col("end") - F.col("start")
    kind = F.col("kind")
    change = T.positive_base_change(start, end)
    yearly = T.display_cagr(start, end, span)
    difference = T.endpoint_difference(start, end)
    value, reason = (
        F.when(kind == "endpoint_change", getattr(change, part))
        .when(kind == "display_cagr", getattr(yearly, part))
        .otherwise(getattr(difference, part))
        for part in ("value", "reason")
    )
    return laid.select(
        "entity", "metric", "kind", "period", "start", "end", value.alias("value"), reason.alias("reason")
    ).withColumn("polarity", F.when(F.col("metric") == "fx_official", T.polarity(F.col("value"))))


def _by_entity(movement: DataFrame) -> DataFrame:
    """One row per basis and entity with its observed rows and its like-for-like ranks: a handful of periods each."""
    kept = movement.where(F.col("reason").isNull())
    like = F.col("universe") == "like_for_like"
    return kept.groupBy("basis", "entity").agg(
        F.map_from_entries(F.collect_list(F.when(like, F.struct("period", F.struct("value", "rank"))))).alias("by_period"),
        F.collect_list(F.when(F.col("universe") == "observed", F.struct(*[c for c in movement.columns if c not in ("basis", "entity")]))).alias("_seen"),
    )


def common_rows(movement: DataFrame, periods: int) -> DataFrame:
    """Entities ranked in every like-for-like period: value and rank of each, as maps by period."""
    return _by_entity(movement).where(F.size("by_period") == periods).select("basis", "entity", "by_period")


def outside_rows(movement: DataFrame, periods: int) -> DataFrame:
    """Observed rows of entities outside the common table, from the same pass."""
    outside = _by_entity(movement).where(F.size("by_period") != periods)
    return outside.select("basis", "entity", F.inline("_seen")).select(*movement.columns)


def competition_relation(movement: DataFrame, focuses: list[str], groups_bound: int) -> DataFrame:
    """Above, below or tied: a shared competition rank is a tie, unlike an ordinal position."""
    mine = movement.where(F.col("entity").isin(focuses) & F.col("rank").isNotNull()).select(
        *GROUP, F.col("entity").alias("focus"), F.col("rank").alias("focus_rank")
    )
    rows = join_small(movement.where(F.col("rank").isNotNull()), mine, GROUP, len(focuses) * groups_bound, "inner")
    relation = (
        F.when(F.col("rank") < F.col("focus_rank"), "above")
        .when(F.col("rank") > F.col("focus_rank"), "below")
        .otherwise("tied")
    )
    return rows.select(*GROUP, "focus", "entity", "rank", "focus_rank", relation.alias("relation"))
