"""Registered family statistics and period queries, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from panelyst.operators import bases as ops, periods
from panelyst.plans import requests as R
from panelyst.plans.oracle_panels import CUST_DIM, PART, PART_DIM, with_
from panelyst.plans.shape import shaped
from panelyst.registry import BASES, FAMILIES, FOCUS_MINUS_PEER, bases_of
from panelyst.sources.tables import customer_dim, part_dim, part_panel

A, M, B = R.A, R.M, R.B


def _legs(bases):
    return tuple(sorted({leg for b in bases for leg in b.legs}))


def _movement(spark, sf_dir, family):
    bases = bases_of(family)
    p = part_panel(spark, sf_dir, _legs(bases), span=(A - 1, B))
    return ops.basis_movement(p.obs, bases, A, B, M, rows_bound=p.entities_bound)


def family_movement(spark, sf_dir, family):
    return shaped(_movement(spark, sf_dir, family))


def basis_group_restricted(spark, sf_dir):
    bases = [BASES["exp_period_total"], BASES["exp_annual_value"]]
    p = part_panel(spark, sf_dir, _legs(bases))
    brand = p.dim.where(~F.col("is_aggregate")).agg(F.min("income_level")).first()[0]
    only = ops.restrict_to_group(p.obs, p.dim, "income_level", brand)
    return shaped(ops.basis_movement(only, bases, A, B, M, rows_bound=p.entities_bound))


def group_catalogue(spark, sf_dir):
    parts = ops.group_catalogue(part_dim(spark, sf_dir)).withColumn("panel", F.lit("part"))
    customers = ops.group_catalogue(customer_dim(spark, sf_dir)).withColumn("panel", F.lit("customer"))
    return parts.unionByName(customers)


def basis_companions(spark, sf_dir):
    p = part_panel(spark, sf_dir, tuple(ops.COMPANIONS))
    return shaped(ops.companions(p.obs, A, B, M))


def basis_common(spark, sf_dir):
    out = ops.common_rows(_movement(spark, sf_dir, "trade"), 3)
    return shaped(out.select("basis", "entity", F.explode("by_period").alias("period", "cell")).select(
        "basis", "entity", "period", F.col("cell.value").alias("value"), F.col("cell.rank").alias("rank")))


def basis_outside(spark, sf_dir):
    out = ops.outside_rows(_movement(spark, sf_dir, "trade"), 3)
    return shaped(out, "basis", "period", "entity", "value", "rank")


def basis_relation(spark, sf_dir):
    bases = bases_of("population")
    rows = _movement(spark, sf_dir, "population")
    return ops.competition_relation(rows, [R.FOCUS_PART, "P000000011"], groups_bound=len(bases) * 6)


def period_summary(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current", "fdi_inflows", "total_current"))
    return shaped(periods.period_summary(p.obs, A, B).withColumn("missing_years", F.array_join("missing_years", ",")))


def period_total_growth(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current", "fdi_inflows"))
    return shaped(periods.period_total_growth(p.obs, A, M, B))


def transforms(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    names = ["ABSOLUTE", "PERCENT", "PP", "INDEX_POINT", "YOY", "CAGR"]
    return shaped(periods.transforms_between(p.obs, names, A, B))


# --- SQL: every basis written out from its definition, over a pivoted part panel -------------------
_YEARS = range(A - 1, B + 1)


def _col(leg, y):
    return f'"{leg}_{y}"'


def _pivot(legs):
    cells = ", ".join(
        f"max(CASE WHEN metric = '{leg}' AND year = {y} THEN value END) AS {_col(leg, y)}" for leg in legs for y in _YEARS
    )
    return f"wide AS (SELECT entity, {cells} FROM part_obs GROUP BY entity)"


def _windows(b, s, e):
    return {"point": [s], "pair": [s - 1, s], "ends": [s, e], "after_start": range(s + 1, e + 1), "closed": range(s, e + 1)}[b.window]


def _stat_sql(b, s, e):
    """(value, reason) of one basis and period."""
    ys = list(_windows(b, s, e))
    own = [_col(b.legs[0], y) for y in ys]
    x, y = own[0], own[-1]
    total = "(" + " + ".join(own) + ")"
    if b.stat == "level":
        return x, f"CASE WHEN {x} IS NULL THEN 'missing_value' END"
    if b.stat in ("ends_change", "annual_change", "index_change"):
        low = "zero_base" if b.stat == "index_change" else "non_positive_base"
        cond = f"{x} = 0" if b.stat == "index_change" else f"{x} <= 0"
        more = f" WHEN {x} < 0 THEN 'negative_base'" if b.stat == "index_change" else ""
        return f"({y} / {x} - 1) * 100", f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'missing_endpoint' WHEN {cond} THEN '{low}'{more} END"
    if b.stat == "difference":
        return f"{y} - {x}", f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'missing_endpoint' END"
    if b.stat == "trade_cagr":
        return (f"(pow({y} / {x}, 1.0 / {e - s}) - 1) * 100",
                f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'missing_endpoint' WHEN {x} = 0 THEN 'zero_base_for_cagr' "
                f"WHEN {x} < 0 THEN 'negative_base_for_cagr' WHEN {y} < 0 THEN 'negative_endpoint_for_cagr' END")
    incomplete = f"CASE WHEN {total} IS NULL THEN 'incomplete_period' END"
    if b.stat == "total":
        return total, incomplete
    if b.stat == "average":
        return f"{total} / {len(ys)}", incomplete
    if b.stat == "compound":
        return "(" + " * ".join(f"(1 + {c} / 100)" for c in own) + " - 1) * 100", incomplete
    den = [_col(b.legs[1], v) for v in ys]
    if b.stat in ("leg_ratio", "months"):
        factor, name = (100, "non_positive_gdp_base") if b.stat == "leg_ratio" else (12, "non_positive_imports_base")
        return f"{x} / {den[0]} * {factor}", f"CASE WHEN {x} IS NULL OR {den[0]} IS NULL THEN 'missing_leg' WHEN {den[0]} <= 0 THEN '{name}' END"
    if b.stat == "mean_ratio":
        ratios = " + ".join(f"{n} / {d} * 100" for n, d in zip(own, den))
        whens = " ".join(f"WHEN {n} IS NULL OR {d} IS NULL THEN 'missing_leg' WHEN {d} <= 0 THEN 'non_positive_gdp_base'" for n, d in zip(own, den))
        return f"({ratios}) / {len(ys)}", f"CASE {whens} END"
    base = "(" + " + ".join(den) + ")"
    low = (f"WHEN {base} = 0 THEN 'zero_gdp_base' WHEN {base} < 0 THEN 'negative_gdp_base'" if b.family == "capital"
           else f"WHEN {base} <= 0 THEN 'non_positive_gdp_base'")
    return f"{total} / {base} * 100", f"CASE WHEN {total} IS NULL OR {base} IS NULL THEN 'incomplete_period' {low} END"


def _candidates(b):
    whole = list(range(A, B + 1))
    if b.family == "external":
        legs, years = b.legs, whole
    elif b.scope == "year":
        legs, years = b.legs[:1], [y for c in (A, M, B) for y in ([c - 1, c] if b.window == "pair" else [c])]
    elif b.family == "fx":
        legs, years = b.legs[:1], [A, M, B]
    elif b.stat == "share" or (b.family == "prices" and b.window == "after_start"):
        legs, years = b.legs[:1], whole[1:]
    else:
        legs, years = b.legs[:1], whole
    return " OR ".join(f"{_col(leg, y)} IS NOT NULL" for leg in legs for y in years)


def _common_sql(b, spans):
    if b.common == "computable":
        return " AND ".join(f"({_stat_sql(b, s, e)[1]}) IS NULL" for _, s, e in spans)
    if b.common == "window":
        return " AND ".join(f"{_col(leg, y)} IS NOT NULL" for leg in b.legs for y in _windows(b, A, B))
    c = [_col(b.legs[0], y) for y in (A, M, B)]
    held = " AND ".join(f"{x} IS NOT NULL" for x in c)
    return held + (f" AND {c[0]} > 0 AND {c[1]} > 0" if b.common == "positive_starts" else "")


def _movement_ctes(bases, panel=PART):
    parts = []
    for b in bases:
        spans = [(str(y), y, y) for y in (A, M, B)] if b.scope == "year" else [("AM", A, M), ("MB", M, B), ("AB", A, B)]
        for name, s, e in spans:
            value, reason = _stat_sql(b, s, e)
            parts.append(
                f"SELECT '{b.key}' AS basis, '{name}' AS period, {s} AS start, {e} AS \"end\", entity, "
                f"CASE WHEN ({reason}) IS NULL THEN {value} END AS value, {reason} AS reason, {_common_sql(b, spans)} AS common "
                f"FROM wide WHERE {_candidates(b)}"
            )
    low = ", ".join(f"'{b.key}'" for b in bases if b.direction == "ASC") or "''"
    none = ", ".join(f"'{b.key}'" for b in bases if b.direction is None) or "''"
    median = ", ".join(f"'{b.key}'" for b in bases if b.benchmark == "median") or "''"
    focus_first = ", ".join(f"'{b.key}'" for b in bases if b.gap == FOCUS_MINUS_PEER) or "''"
    return with_(panel, _pivot(_legs(bases)), "cells AS (\n" + "\nUNION ALL ".join(parts) + ")", f"""
uni AS (SELECT *, 'observed' AS universe FROM cells UNION ALL SELECT *, 'like_for_like' FROM cells WHERE common),
agg AS (SELECT basis, period, universe, count(value) AS n, count(*) - count(value) AS incomplete,
    sum(CAST(value AS DECIMAL(38,10))) AS total, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS vs
  FROM uni GROUP BY ALL),
rk AS (
  SELECT u.*, a.n, a.incomplete, a.total, a.vs,
    CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY u.basis, u.period, u.universe, value IS NULL ORDER BY
      CASE WHEN u.basis IN ({low}) THEN value ELSE -value END) END AS r,
    -- 0-based place of a copy of this value in the sorted list; equal values are interchangeable
    CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY u.basis, u.period, u.universe, value IS NULL ORDER BY value) - 1 END AS k
  FROM uni u JOIN agg a ON a.basis = u.basis AND a.period = u.period AND a.universe = u.universe),
bm AS (
  SELECT *, basis NOT IN ({none}) AND value IS NOT NULL AS ranked,
    CASE WHEN value IS NULL OR basis IN ({none}) OR n = 1 THEN NULL
      WHEN basis IN ({median}) THEN
        CASE WHEN n % 2 = 0 THEN vs[CASE WHEN k < n // 2 THEN n // 2 + 1 ELSE n // 2 END]
        ELSE (vs[CASE WHEN k < n // 2 THEN n // 2 + 1 ELSE n // 2 END]
              + vs[CASE WHEN k < n // 2 + 1 THEN n // 2 + 2 ELSE n // 2 + 1 END]) / 2 END
      ELSE (CAST(total AS DOUBLE) - value) / (n - 1) END AS benchmark
  FROM rk),
mv AS (
  SELECT basis, period, universe, start, "end", entity, value, reason, CASE WHEN ranked THEN r END AS rank, n, incomplete,
    benchmark, CASE WHEN ranked THEN n - 1 END AS peers,
    CASE WHEN basis IN ({focus_first}) THEN value - benchmark ELSE benchmark - value END AS gap,
    CASE WHEN ranked AND n <= 1 THEN 'insufficient_comparison_universe' END AS benchmark_reason
  FROM bm)""")


_MV = """SELECT * REPLACE (round(value, 4) + 0.0 AS value, round(benchmark, 4) + 0.0 AS benchmark, round(gap, 4) + 0.0 AS gap) FROM mv"""
_GROUPED = [BASES["exp_period_total"], BASES["exp_annual_value"]]
_ONE_BRAND = PART.replace("part_obs AS (", "all_obs AS (") + ",\n" + """
part_obs AS (SELECT * FROM all_obs WHERE entity IN (
  SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)))"""


def _companion_sql():
    ends = {"inflation_cpi_index": "index_point_change", "fdi_inflows": "fdi_flow_change", "fdi_inflows_pct_gdp": "fdigdp_ratio_change"}
    parts = []
    for metric, kind in ops.COMPANIONS.items():
        for name, s, e in (("AM", A, M), ("MB", M, B), ("AB", A, B)):
            x, y = "x.value", "y.value"
            if metric in ends:
                value, more = f"{y} - {x}", ""
            elif kind == "endpoint_change":
                value, more = f"({y} / {x} - 1) * 100", f"WHEN {x} <= 0 THEN 'non_positive_base'"
            else:
                value = f"(pow({y} / {x}, 1.0 / {e - s}) - 1) * 100"
                more = f"WHEN {x} <= 0 THEN 'non_positive_base' WHEN {y} < 0 THEN 'negative_endpoint'"
            parts.append(f"""
SELECT k.entity, k.metric, '{kind}' AS kind, '{name}' AS period, {s} AS start, {e} AS "end", {value} AS v,
  CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'missing_endpoint' {more} END AS reason
FROM keyed k LEFT JOIN part_obs x ON x.entity = k.entity AND x.metric = k.metric AND x.year = {s}
LEFT JOIN part_obs y ON y.entity = k.entity AND y.metric = k.metric AND y.year = {e} WHERE k.metric = '{metric}'""")
    return with_(PART, f"keyed AS (SELECT DISTINCT entity, metric FROM part_obs WHERE year IN ({A}, {M}, {B}))",
                 "comp AS (" + " UNION ALL ".join(parts) + ")") + """
SELECT entity, metric, kind, period, start, "end", round(CASE WHEN reason IS NULL THEN v END, 4) + 0.0 AS value, reason,
  CASE WHEN metric = 'fx_official' AND reason IS NULL THEN CASE WHEN v > 0 THEN 'Nominal depreciation vs USD'
    WHEN v < 0 THEN 'Nominal appreciation vs USD' ELSE 'No nominal movement vs USD' END END AS polarity
FROM comp"""


def _sum_sql(years, alias="value"):
    return " + ".join(f"v{y}" for y in years)


_SERIES = ("series AS (SELECT entity, metric, "
           + ", ".join(f"max(CASE WHEN year = {y} THEN value END) AS v{y}" for y in range(A, B + 1))
           + " FROM part_obs WHERE metric IN ({metrics}) AND year BETWEEN " + f"{A} AND {B - 1}" + " GROUP BY entity, metric)")

_CHANGES = {
    "ABSOLUTE": ("e - s", "''", ""),
    "PP": ("e - s", "'inflation_cpi', 'inflation_deflator', 'fdi_inflows_pct_gdp'", ""),
    "INDEX_POINT": ("e - s", "'inflation_cpi_index'", ""),
    "PERCENT": ("(e / s - 1) * 100", "", "base"),
    "YOY": ("(e / s - 1) * 100", "", "base"),
    "CAGR": (f"(pow(e / s, 1.0 / {B - A}) - 1) * 100", "", "base"),
}
_GROWING = "'total_current', 'exports_current', 'imports_current', 'reserves_ex_gold', 'remittances_received', 'population_total', 'nominal_current'"


def _transform_sql():
    parts = []
    for name, (value, allowed, base) in _CHANGES.items():
        allowed = {
            "ABSOLUTE": "SELECT DISTINCT metric FROM part_obs",
            "PERCENT": _GROWING + ", 'inflation_cpi_index', 'fx_official'",
            "YOY": _GROWING + ", 'fdi_inflows', 'current_account', 'fx_official'",
            "CAGR": _GROWING,
        }.get(name, allowed)
        more = """WHEN s = 0 THEN 'zero_base_for_percent_change' WHEN s < 0 THEN 'negative_base_for_percent_change'
          WHEN e < 0 THEN 'sign_change_across_endpoints'""" if base else ""
        parts.append(f"""
SELECT entity, metric, '{name}' AS transform, {A} AS a, {B} AS b, s AS start_value, e AS end_value, {value} AS v,
  CASE WHEN metric NOT IN ({allowed}) THEN 'unsupported_transformation_for_metric'
    WHEN s IS NULL THEN 'missing_base_value' WHEN e IS NULL THEN 'missing_current_value' {more} END AS reason FROM pt""")
    return with_(PART, f"""
pt AS (SELECT entity, metric, max(CASE WHEN year = {A} THEN value END) AS s, max(CASE WHEN year = {B} THEN value END) AS e
  FROM part_obs WHERE year IN ({A}, {B}) GROUP BY entity, metric)""", "tr AS (" + " UNION ALL ".join(parts) + ")") + """
SELECT entity, metric, transform, a, b, round(start_value, 4) + 0.0 AS start_value, round(end_value, 4) + 0.0 AS end_value,
  round(CASE WHEN reason IS NULL THEN v END, 4) + 0.0 AS value, reason FROM tr"""


_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN v{y} IS NULL THEN '{y}' END" for y in range(A, B)) + ")"

QUERIES = {f"family_{f}": (partial(family_movement, family=f), _movement_ctes(bases_of(f)) + _MV) for f in FAMILIES}
QUERIES |= {
    "basis_group_restricted": (basis_group_restricted, _movement_ctes(_GROUPED, _ONE_BRAND) + _MV),
    "group_catalogue": (group_catalogue, with_(PART_DIM, CUST_DIM, """
rows AS (SELECT 'part' AS panel, income_level, region, lending_type FROM part_dim WHERE NOT is_aggregate
  UNION ALL SELECT 'customer', income_level, region, lending_type FROM cust_dim)""") + """
SELECT panel, 'income_level' AS group_type, income_level AS group_value, count(*) AS entities FROM rows GROUP BY 1, 3
UNION ALL SELECT panel, 'region', region, count(*) FROM rows GROUP BY 1, 3
UNION ALL SELECT panel, 'lending_type', lending_type, count(*) FROM rows GROUP BY 1, 3"""),
    "basis_companions": (basis_companions, _companion_sql()),
    "basis_common": (basis_common, _movement_ctes(bases_of("trade")) + """
SELECT basis, entity, period, round(value, 4) AS value, rank FROM (
  SELECT *, count(*) OVER (PARTITION BY basis, entity) AS held FROM mv WHERE universe = 'like_for_like' AND reason IS NULL) t
WHERE held = 3"""),
    "basis_outside": (basis_outside, _movement_ctes(bases_of("trade")) + """
SELECT basis, period, entity, round(value, 4) AS value, rank FROM mv m WHERE universe = 'observed' AND reason IS NULL
AND (SELECT count(*) FROM mv c WHERE c.basis = m.basis AND c.entity = m.entity AND c.universe = 'like_for_like' AND c.reason IS NULL) < 3"""),
    "basis_relation": (basis_relation, _movement_ctes(bases_of("population")) + f"""
SELECT m.basis, m.period, m.universe, f.entity AS focus, m.entity, m.rank, f.rank AS focus_rank,
  CASE WHEN m.rank < f.rank THEN 'above' WHEN m.rank > f.rank THEN 'below' ELSE 'tied' END AS relation
FROM mv m JOIN mv f ON f.basis = m.basis AND f.period = m.period AND f.universe = m.universe
WHERE f.entity IN ('{R.FOCUS_PART}', 'P000000011') AND m.rank IS NOT NULL AND f.rank IS NOT NULL"""),
    "period_summary": (period_summary, with_(PART, _SERIES.format(metrics="'exports_current', 'fdi_inflows'")) + f"""
SELECT entity, metric, {A} AS start, {B} AS "end", {B - A} AS size, round(({_sum_sql(range(A, B))}), 4) + 0.0 AS sum,
  round((({_sum_sql(range(A, B))}) / {B - A}), 4) + 0.0 AS average,
  CASE WHEN {_sum_sql(range(A, B))} IS NULL THEN 'incomplete_period' END AS reason, {_MISSING} AS missing_years FROM series"""),
    "period_total_growth": (period_total_growth, with_(PART, _SERIES.format(metrics="'exports_current', 'fdi_inflows'"), f"""
sums AS (SELECT entity, metric, {_sum_sql(range(A, M))} AS s1, {_sum_sql(range(M, B))} AS s2 FROM series)""") + f"""
SELECT entity, metric, {A} AS a, {M} AS b, {B} AS c, round(s1, 4) + 0.0 AS sum_ab, round(s2, 4) + 0.0 AS sum_bc,
  round(CASE WHEN s1 > 0 AND s2 >= 0 THEN (s2 / s1 - 1) * 100 END, 4) + 0.0 AS growth,
  CASE WHEN s1 IS NULL AND s2 IS NULL THEN 'both_values_missing' WHEN s1 IS NULL THEN 'missing_base_value'
    WHEN s2 IS NULL THEN 'missing_current_value' WHEN s1 = 0 THEN 'zero_base_for_percent_change'
    WHEN s1 < 0 THEN 'negative_base_for_percent_change' WHEN s2 < 0 THEN 'sign_change_across_endpoints' END AS reason
FROM sums"""),
    "transforms": (transforms, _transform_sql()),
}
