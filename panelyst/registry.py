"""Metrics, movement bases and compare operations: the data that gates every operator.

New statistics are added here as rows; the operators read only these fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: closed vocabularies -------------------------------------------------------
OBSERVATION_TYPES = ("LEVEL", "FLOW", "RATE", "RATIO", "INDEX", "QUOTED_RATE")
CHANGE_TYPES = ("ABSOLUTE", "PERCENT", "PP", "INDEX_POINT", "YOY", "CAGR")
RANK_DIRECTIONS = ("DESC", "ASC", "NEUTRAL")
AGGREGATIONS = ("SUM", "WEIGHTED_RATIO", "OFFICIAL_ONLY", "MEMBER_ONLY", "NOT_AGGREGATABLE")
SIGN_DOMAINS = ("POSITIVE_ONLY", "NON_NEGATIVE", "SIGNED")
ENTITY_KINDS = ("COUNTRY", "OFFICIAL_AGGREGATE", "CUSTOM_GROUP")
SUBJECTS = (
    "gdp_per_capita", "gdp_total", "prices", "trade",
    "capital_flows", "exchange", "external", "population",
)
PLAUSIBLE_FIRST_YEAR = 1960


@dataclass(frozen=True)
class Metric:
    key: str
    subject: str
    observation: str
    changes: tuple[str, ...]
    aggregation: str
    direction: str
    sign: str
    unit: str
    period: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ENTITY_KINDS
    numerator: str | None = None
    denominator: str | None = None
    quotation: str | None = None
    price_basis: str = "NOT_APPLICABLE"
    currency_basis: str = "NOT_APPLICABLE"

    @property
    def gap_unit(self) -> str:
        if self.observation in ("RATE", "RATIO"):
            return "percentage points"
        return "index points" if self.observation == "INDEX" else self.unit


_GROWING = ("ABSOLUTE", "PERCENT", "YOY", "CAGR")
_USD = "current US$"


def _money(key, subject, observation, unit=_USD, *, changes=_GROWING, aggregation="SUM",
           sign="POSITIVE_ONLY", period=(), price="current", currency="USD"):
    return Metric(key, subject, observation, changes, aggregation, "DESC", sign, unit, period,
                  price_basis=price, currency_basis=currency)


# --- fixed values: the metric catalogue ------------------------------------------------------
_CATALOGUE = [
    _money("nominal_current", "gdp_per_capita", "LEVEL", aggregation="NOT_AGGREGATABLE"),
    _money("nominal_constant", "gdp_per_capita", "LEVEL", "constant 2015 US$",
           aggregation="NOT_AGGREGATABLE", price="constant"),
    _money("ppp_current", "gdp_per_capita", "LEVEL", "current international $",
           aggregation="NOT_AGGREGATABLE", currency="INTERNATIONAL_DOLLAR"),
    _money("ppp_constant", "gdp_per_capita", "LEVEL", "constant 2021 international $",
           aggregation="NOT_AGGREGATABLE", price="constant", currency="INTERNATIONAL_DOLLAR"),
    _money("total_current", "gdp_total", "LEVEL"),
    _money("total_constant", "gdp_total", "LEVEL", "constant 2015 US$", price="constant"),
    _money("total_ppp_current", "gdp_total", "LEVEL", "current international $",
           currency="INTERNATIONAL_DOLLAR"),
    _money("total_ppp_constant", "gdp_total", "LEVEL", "constant 2021 international $",
           price="constant", currency="INTERNATIONAL_DOLLAR"),
    Metric("inflation_cpi", "prices", "RATE", ("ABSOLUTE", "PP"), "OFFICIAL_ONLY", "ASC", "SIGNED",
           "annual %"),
    Metric("inflation_cpi_index", "prices", "INDEX", ("ABSOLUTE", "PERCENT", "INDEX_POINT"),
           "OFFICIAL_ONLY", "NEUTRAL", "POSITIVE_ONLY", "index points (2010 = 100)"),
    Metric("inflation_deflator", "prices", "RATE", ("ABSOLUTE", "PP"), "OFFICIAL_ONLY", "ASC",
           "SIGNED", "annual %"),
    _money("exports_current", "trade", "FLOW", period=("SUM", "AVG")),
    _money("imports_current", "trade", "FLOW", period=("SUM", "AVG")),
    _money("fdi_inflows", "capital_flows", "FLOW", changes=("ABSOLUTE", "YOY"), sign="SIGNED",
           period=("SUM", "AVG")),
    Metric("fdi_inflows_pct_gdp", "capital_flows", "RATIO", ("ABSOLUTE", "PP"), "WEIGHTED_RATIO",
           "DESC", "SIGNED", "% of GDP", numerator="fdi_inflows", denominator="total_current"),
    Metric("fx_official", "exchange", "QUOTED_RATE", ("ABSOLUTE", "PERCENT", "YOY"), "MEMBER_ONLY",
           "NEUTRAL", "POSITIVE_ONLY", "local currency units per US$ (period average)",
           kinds=("COUNTRY", "CUSTOM_GROUP"), quotation="LCU_PER_USD"),
    _money("current_account", "external", "FLOW", changes=("ABSOLUTE", "YOY"), sign="SIGNED",
           period=("SUM", "AVG")),
    _money("reserves_ex_gold", "external", "LEVEL"),
    _money("remittances_received", "external", "FLOW", period=("SUM", "AVG")),
    Metric("population_total", "population", "LEVEL", _GROWING, "SUM", "DESC", "POSITIVE_ONLY",
           "people"),
]
METRICS: dict[str, Metric] = {m.key: m for m in _CATALOGUE}


@dataclass(frozen=True)
class Basis:
    """One family statistic.

    ``scope``: ``year`` (one value per selected year) or ``period`` (one per interval).
    ``window``: ``point``, ``pair`` (year and its predecessor), ``ends``, ``after_start``
    (S+1..E) or ``closed`` (S..E).
    ``common``: like-for-like membership rule: ``computable`` in every selected year, ``ends``
    (finite at each selected year), ``positive_starts`` or ``window`` (whole span present).
    """

    key: str
    family: str
    metric: str
    stat: str
    scope: str
    window: str
    direction: str | None
    benchmark: str | None
    gap: str | None
    common: str
    legs: tuple[str, ...] = field(default=())


PEER_MINUS_FOCUS = "benchmark_minus_focus"
FOCUS_MINUS_PEER = "focus_minus_benchmark"


def _basis(key, family, metric, stat, scope, window, direction, benchmark, gap, common, *legs):
    return Basis(key, family, metric, stat, scope, window, direction, benchmark, gap, common,
                 legs or (metric,))


def _bases():
    pmf, fmp = PEER_MINUS_FOCUS, FOCUS_MINUS_PEER
    yield _basis("cpi_index_annual", "prices", "inflation_cpi_index", "level", "year", "point",
                 None, None, None, "computable")
    yield _basis("cpi_index_period_change", "prices", "inflation_cpi_index", "index_change",
                 "period", "ends", "ASC", "mean", pmf, "ends")
    for stem, metric in (("cpi_inflation", "inflation_cpi"), ("deflator", "inflation_deflator")):
        yield _basis(f"{stem}_annual", "prices", metric, "level", "year", "point", "ASC", "mean",
                     pmf, "computable")
        yield _basis(f"{stem}_average", "prices", metric, "average", "period", "after_start",
                     "ASC", "mean", pmf, "window")
        yield _basis(f"{stem}_cumulative", "prices", metric, "compound", "period", "after_start",
                     "ASC", "mean", pmf, "window")
    for stem, metric in (("exp", "exports_current"), ("imp", "imports_current")):
        yield _basis(f"{stem}_annual_value", "trade", metric, "level", "year", "point", "DESC",
                     "mean", pmf, "computable")
        yield _basis(f"{stem}_period_cagr", "trade", metric, "trade_cagr", "period", "ends",
                     "DESC", "mean", pmf, "positive_starts")
        yield _basis(f"{stem}_period_total", "trade", metric, "total", "period", "closed", "DESC",
                     "mean", pmf, "window")
        yield _basis(f"{stem}_period_average", "trade", metric, "average", "period", "closed",
                     "DESC", "mean", pmf, "window")
    yield _basis("fdi_annual_value", "capital", "fdi_inflows", "level", "year", "point", "DESC",
                 "mean", fmp, "computable")
    yield _basis("fdi_period_cumulative", "capital", "fdi_inflows", "total", "period",
                 "after_start", "DESC", "mean", fmp, "window")
    yield _basis("fdi_period_average", "capital", "fdi_inflows", "average", "period",
                 "after_start", "DESC", "mean", fmp, "window")
    yield _basis("fdigdp_annual_value", "capital", "fdi_inflows_pct_gdp", "level", "year",
                 "point", "DESC", "mean", fmp, "computable")
    yield _basis("fdigdp_period_average", "capital", "fdi_inflows_pct_gdp", "average", "period",
                 "after_start", "DESC", "mean", fmp, "window")
    yield _basis("fdigdp_period_cumulative_share", "capital", "fdi_inflows_pct_gdp", "share",
                 "period", "after_start", "DESC", "mean", fmp, "window",
                 "fdi_inflows", "total_current")
    yield _basis("fx_annual_rate", "fx", "fx_official", "level", "year", "point", None, None,
                 None, "computable")
    yield _basis("fx_annual_change", "fx", "fx_official", "annual_change", "year", "pair", "DESC",
                 "median", fmp, "computable")
    yield _basis("fx_period_change", "fx", "fx_official", "ends_change", "period", "ends", "DESC",
                 "median", fmp, "ends")
    yield _basis("ca_annual_gdp", "external", "current_account", "leg_ratio", "year", "point",
                 "DESC", "mean", fmp, "computable", "current_account", "total_current")
    yield _basis("ca_average_gdp", "external", "current_account", "mean_ratio", "period",
                 "after_start", "DESC", "mean", fmp, "window", "current_account", "total_current")
    yield _basis("ca_cumulative_share", "external", "current_account", "share", "period",
                 "after_start", "DESC", "mean", fmp, "window", "current_account", "total_current")
    yield _basis("res_annual_stock", "external", "reserves_ex_gold", "level", "year", "point",
                 "DESC", "median", fmp, "computable")
    yield _basis("res_period_change", "external", "reserves_ex_gold", "ends_change", "period",
                 "ends", "DESC", "median", fmp, "ends")
    yield _basis("res_import_coverage", "external", "reserves_ex_gold", "months", "year", "point",
                 "DESC", "mean", fmp, "computable", "reserves_ex_gold", "imports_current")
    yield _basis("remit_annual_value", "external", "remittances_received", "level", "year",
                 "point", "DESC", "median", fmp, "computable")
    yield _basis("remit_period_cumulative", "external", "remittances_received", "total", "period",
                 "after_start", "DESC", "median", fmp, "window")
    yield _basis("remit_period_average", "external", "remittances_received", "average", "period",
                 "after_start", "DESC", "median", fmp, "window")
    yield _basis("remit_cumulative_intensity", "external", "remittances_received", "share",
                 "period", "after_start", "DESC", "mean", fmp, "window",
                 "remittances_received", "total_current")
    yield _basis("pop_annual_value", "population", "population_total", "level", "year", "point",
                 "DESC", "mean", fmp, "computable")
    yield _basis("pop_period_change", "population", "population_total", "difference", "period",
                 "ends", "DESC", "mean", fmp, "ends")
    yield _basis("pop_period_growth", "population", "population_total", "ends_change", "period",
                 "ends", "DESC", "mean", fmp, "ends")


BASES: dict[str, Basis] = {b.key: b for b in _bases()}
FAMILIES = tuple(dict.fromkeys(b.family for b in BASES.values()))


def bases_of(family: str) -> list[Basis]:
    return [b for b in BASES.values() if b.family == family]


@dataclass(frozen=True)
class Operation:
    key: str
    kind: str
    transform: str | None


# --- fixed values: the compare operation catalogue --------------------------------------------
OPERATIONS: dict[str, Operation] = {
    o.key: o
    for o in (
        Operation("level", "point", None),
        Operation("absolute_change", "two_point", "ABSOLUTE"),
        Operation("percent_change", "two_point", "PERCENT"),
        Operation("pp_change", "two_point", "PP"),
        Operation("index_point_change", "two_point", "INDEX_POINT"),
        Operation("cagr", "two_point", "CAGR"),
        Operation("cross_rate", "single", "CROSS_RATE"),
        Operation("period_total", "period", "PERIOD_SUM"),
        Operation("period_average", "period", "PERIOD_AVG"),
        Operation("movement_period_total", "movement_period", "MOVEMENT_PERIOD_TOTAL"),
        Operation("movement_period_average", "movement_period", "MOVEMENT_PERIOD_AVERAGE"),
        Operation("movement_inflation_cumulative", "movement_period", "MOVEMENT_CUMULATIVE_INFLATION"),
        Operation("period_total_growth", "partitioned_period", "PERIOD_SUM_PERCENT_CHANGE"),
        Operation("segmented_growth", "partitioned", "PERCENT"),
    )
}
MOVEMENT_PERIOD_METRICS = {
    "movement_period_total": ("exports_current", "imports_current", "fdi_inflows", "remittances_received"),
    "movement_period_average": (
        "exports_current", "imports_current", "fdi_inflows", "fdi_inflows_pct_gdp",
        "remittances_received", "inflation_cpi", "inflation_deflator",
    ),
    "movement_inflation_cumulative": ("inflation_cpi", "inflation_deflator"),
}
TRADE_METRICS = ("exports_current", "imports_current")
# Compare bases built from several legs, with the analyses each one allows.
LEG_BASES = {
    "ca_annual_gdp": ("level", "pp_change"),
    "ca_average_gdp": ("level",),
    "ca_cumulative_share": ("level",),
    "res_import_coverage": ("level", "absolute_change"),
    "remit_cumulative_intensity": ("level",),
    "fdigdp_period_cumulative_share": ("level",),
}


# --- capability gates ---------------------------------------------------------------------------
def can_transform(metric: Metric | None, transform: str) -> tuple[bool, str | None]:
    """May ``transform`` be applied to ``metric``; the reason when it may not."""
    if metric is None:
        return False, "unknown_metric"
    allowed = {
        "GROUP_SUM": metric.aggregation == "SUM",
        "GROUP_RATIO_FROM_SUMS": metric.aggregation == "WEIGHTED_RATIO",
        "CROSS_RATE": metric.observation == "QUOTED_RATE" and metric.quotation == "LCU_PER_USD",
        "PERIOD_SUM": "SUM" in metric.period,
        "PERIOD_AVG": "AVG" in metric.period,
        "PERIOD_SUM_PERCENT_CHANGE": "SUM" in metric.period,
    }.get(transform, transform in metric.changes)
    return (True, None) if allowed else (False, "unsupported_transformation_for_metric")


def output_unit(metric: Metric, transform: str) -> str:
    if transform in ("PERCENT", "YOY", "CAGR", "PERIOD_SUM_PERCENT_CHANGE"):
        return "%"
    return {"PP": "percentage points", "INDEX_POINT": "index points"}.get(transform, metric.unit)


def gate_operation(operation: str, metric: Metric | None) -> tuple[bool, str | None]:
    """May a compare operation run on a metric."""
    definition = OPERATIONS.get(operation)
    if definition is None:
        return False, "INVALID_OPERATION"
    if metric is None:
        return False, "UNSUPPORTED_TRANSFORMATION"
    if operation == "level":
        return True, None
    if definition.kind == "movement_period":
        allowed = metric.key in MOVEMENT_PERIOD_METRICS[operation]
    else:
        allowed, _ = can_transform(metric, definition.transform)
    return (True, None) if allowed else (False, "UNSUPPORTED_TRANSFORMATION")


def can_compare(metric: Metric | None, kind_a: str, kind_b: str, operation: str,
                same_entity: bool = False) -> tuple[bool, str | None]:
    """Entity kinds x metric x operation."""
    if operation not in OPERATIONS:
        return False, "INVALID_OPERATION"
    if metric is None:
        return False, "UNSUPPORTED_TRANSFORMATION"
    kinds = (kind_a, kind_b)
    if any(k not in metric.kinds for k in kinds):
        return False, "UNSUPPORTED_ENTITY_COMBINATION"
    both_countries = kinds == ("COUNTRY", "COUNTRY")
    if operation == "cross_rate" and not both_countries:
        return False, "UNSUPPORTED_ENTITY_COMBINATION"
    if operation == "level" and metric.direction == "NEUTRAL" and both_countries and not same_entity:
        return False, "UNSUPPORTED_ENTITY_COMBINATION"
    groupable = metric.aggregation in ("SUM", "WEIGHTED_RATIO")
    if operation != "cross_rate" and "CUSTOM_GROUP" in kinds and not groupable:
        return False, "NOT_AGGREGATABLE"
    return gate_operation(operation, metric)


def rank_rule(metric: Metric, statistic: str = "level") -> tuple[str, str] | None:
    """(``ordinal`` | ``competition``, direction) of a compared value, or None when unranked.

    ``statistic`` is ``level`` for yearly values and ``derived`` for changes and period results.
    """
    derived = statistic == "derived"
    if metric.key in ("inflation_cpi", "inflation_deflator"):
        return "competition", "ASC"
    if metric.key == "fx_official":
        # A quoted rate has no level order; its changes rank high to low.
        return ("competition", "DESC") if derived else None
    if metric.key == "current_account":
        return ("competition", "DESC") if derived else None
    if metric.direction == "NEUTRAL":
        return None
    if metric.subject in ("gdp_per_capita", "gdp_total"):
        return "ordinal", "DESC"
    return "competition", "DESC"


def validate_registry(metrics: dict[str, Metric] | None = None) -> list[str]:
    """Problems found in the registry; an empty list means it is sound."""
    metrics = METRICS if metrics is None else metrics
    problems = []
    for key, m in metrics.items():
        checks = {
            "key": m.key == key,
            "subject": m.subject in SUBJECTS,
            "observation": m.observation in OBSERVATION_TYPES,
            "changes": bool(m.changes) and set(m.changes) <= set(CHANGE_TYPES),
            "aggregation": m.aggregation in AGGREGATIONS,
            "direction": m.direction in RANK_DIRECTIONS,
            "sign": m.sign in SIGN_DOMAINS,
            "period": set(m.period) <= {"SUM", "AVG"} and (not m.period or m.observation == "FLOW"),
            "kinds": bool(m.kinds) and set(m.kinds) <= set(ENTITY_KINDS),
            "quotation": (m.quotation is not None) == (m.observation == "QUOTED_RATE"),
            "legs": (m.denominator is None and m.numerator is None)
            or {m.numerator, m.denominator} <= set(metrics),
            "unit": bool(m.unit),
        }
        problems += [f"{key}.{name}" for name, sound in checks.items() if not sound]
    for b in BASES.values():
        problems += [f"{b.key}.legs" for leg in b.legs if leg not in metrics]
    return problems
