"""Registered universe, group and compare queries, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from panelyst.operators import compare as cmp, entities, groups, presence, universe as uni
from panelyst.operators.movement import year_pairs, year_triples
from panelyst.plans import requests as R
from panelyst.plans.oracle_panels import PART, PART_DIM, STORE, values_, with_
from panelyst.plans.shape import shaped
from panelyst.registry import METRICS, can_compare, rank_rule
from panelyst.sources.tables import PART_METRICS, part_panel, stored

A, M, B = R.A, R.M, R.B
P = [f"P{n:09d}" for n in range(200)]
GROUP_ONE = "group:" + ",".join(P[3:15])
GROUP_TWO = "group:" + ",".join(P[10:20])
GROUP_THREE = "group:" + ",".join(P[12:15])


def _requests(spark, sf_dir):
    return [
        cmp.Request("level", f"country:{P[1]}", f"country:{P[2]}", "total_current", "level", A, M, B),
        cmp.Request("level_lfl", f"country:{P[4]}", GROUP_ONE, "exports_current", "level", A, M, B, "like_for_like"),
        cmp.Request("level_obs", f"country:{P[5]}", GROUP_TWO, "exports_current", "level", A, M, B),
        cmp.Request("level_agg", f"country:{P[5]}", "aggregate:BRAND11", "exports_current", "level", A, B),
        cmp.Request("level_agg_lfl", f"country:{P[5]}", "aggregate:BRAND11", "total_current", "level", A, B, None, "like_for_like"),
        cmp.Request("level_rate", f"country:{P[6]}", f"country:{P[7]}", "inflation_cpi", "level", A, B),
        cmp.Request("abs", f"country:{P[8]}", GROUP_THREE, "fdi_inflows", "absolute_change", A, M, B),
        cmp.Request("pct", f"country:{P[9]}", f"country:{P[10]}", "imports_current", "percent_change", A, M, B),
        cmp.Request("pct_lfl", GROUP_ONE, GROUP_TWO, "imports_current", "percent_change", A, None, B, "like_for_like"),
        cmp.Request("pct_obs", GROUP_ONE, GROUP_TWO, "imports_current", "percent_change", A, None, B),
        cmp.Request("pp", f"country:{P[11]}", GROUP_ONE, "fdi_inflows_pct_gdp", "pp_change", A, B),
        cmp.Request("pp_lfl", f"country:{P[11]}", GROUP_ONE, "fdi_inflows_pct_gdp", "pp_change", A, M, B, "like_for_like"),
        cmp.Request("points", f"country:{P[12]}", f"country:{P[13]}", "inflation_cpi_index", "index_point_change", A, B),
        cmp.Request("cagr", f"country:{P[14]}", f"country:{P[15]}", "population_total", "cagr", A, M, B),
        cmp.Request("cross", f"country:{P[16]}", f"country:{P[17]}", "fx_official", "cross_rate", A),
        cmp.Request("fx_change", f"country:{P[16]}", f"country:{P[17]}", "fx_official", "percent_change", A, B),
        cmp.Request("fx_agg", f"country:{P[16]}", "aggregate:BRAND11", "fx_official", "percent_change", A, B),
        cmp.Request("total", f"country:{P[18]}", f"country:{P[19]}", "remittances_received", "period_total", A, M, B),
        cmp.Request("average", f"country:{P[18]}", GROUP_TWO, "remittances_received", "period_average", A, B),
        cmp.Request("mv_total", f"country:{P[20]}", f"country:{P[21]}", "exports_current", "movement_period_total", A, M, B),
        cmp.Request("mv_average", f"country:{P[22]}", f"country:{P[23]}", "inflation_cpi", "movement_period_average", A, B),
        cmp.Request("mv_compound", f"country:{P[24]}", f"country:{P[25]}", "inflation_deflator", "movement_inflation_cumulative", A, M, B),
        cmp.Request("growth", f"country:{P[26]}", f"country:{P[27]}", "current_account", "period_total_growth", A, M, B),
        cmp.Request("growth_no_mid", f"country:{P[26]}", f"country:{P[27]}", "current_account", "period_total_growth", A, None, B),
        cmp.Request("segmented", f"country:{P[28]}", "aggregate:BRAND11", "total_current", "segmented_growth", A, M, B),
        cmp.Request("per_capita_group", f"country:{P[28]}", GROUP_ONE, "nominal_current", "level", A, B),
    ]


_REFUSED = [
    cmp.Request("bad_operation", f"country:{P[1]}", f"country:{P[2]}", "total_current", "median", A),
    cmp.Request("bad_transform", f"country:{P[1]}", f"country:{P[2]}", "fdi_inflows", "cagr", A, B),
    cmp.Request("bad_order", f"country:{P[1]}", f"country:{P[2]}", "total_current", "percent_change", B, A),
    cmp.Request("same_year", f"country:{P[1]}", f"country:{P[2]}", "total_current", "percent_change", A, A),
    cmp.Request("no_year", f"country:{P[1]}", f"country:{P[2]}", "total_current", "percent_change", A),
    cmp.Request("unknown", "country:NOBODY", f"country:{P[2]}", "total_current", "level", A),
    cmp.Request("aggregate_as_country", f"country:{P[1]}", "country:BRAND11", "total_current", "level", A),
    cmp.Request("country_as_aggregate", f"aggregate:{P[1]}", f"country:{P[2]}", "total_current", "level", A),
    cmp.Request("no_aggregate", "aggregate:BRAND99", f"country:{P[2]}", "total_current", "level", A),
    cmp.Request("bad_member", f"group:{P[1]},BRAND11", f"country:{P[2]}", "total_current", "level", A),
]


def _panel(spark, sf_dir, metrics=PART_METRICS):
    return part_panel(spark, sf_dir, metrics, aggregates=True, span=(A - 1, B))


def compare_requests(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return shaped(cmp.compare(p.obs, p.dim, _requests(spark, sf_dir), rows_bound=p.entities_bound))


def compare_refused(spark, sf_dir):
    return cmp.refused_requests(_REFUSED, part_panel(spark, sf_dir, ("total_current",)).dim)


def compare_series(spark, sf_dir):
    p = _panel(spark, sf_dir, ("exports_current", "fdi_inflows_pct_gdp", "fdi_inflows", "total_current"))
    wanted = [r for r in _requests(spark, sf_dir) if r.key in ("level_obs", "level_agg", "level_lfl")]
    return shaped(cmp.slot_series(p.obs, p.dim, wanted))


_BASIS_PAIRS = [
    ("one", f"country:{P[1]}", f"country:{P[2]}"),
    ("two", f"country:{P[30]}", GROUP_ONE),
    ("three", GROUP_TWO, "aggregate:BRAND11"),
]


def compare_basis(spark, sf_dir, basis, operation, mode):
    p = _panel(spark, sf_dir)
    out = cmp.compare_basis(p.obs, p.dim, basis, _BASIS_PAIRS, A, B, M, operation=operation, mode=mode,
                            rows_bound=p.entities_bound)
    return shaped(out)


PLANS = [
    uni.UniversePlan("exports", "exports_current", (A, M, B)),
    uni.UniversePlan("imports", "imports_current", tuple(range(A, B + 1))),
    uni.UniversePlan("signed", "fdi_inflows", (A, B)),
]
_PARTICIPANTS = [
    (p.key, P[n], role) for p in PLANS for n, role in
    [(1, "entity"), (2, "entity"), (3, "group_member"), (4, "group_member"), (1, "group_member"), (199, "entity")]
]


def _universe(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current", "imports_current", "fdi_inflows"), span=(A, B))
    return uni.universe(p.obs, PLANS, uni.participants_frame(spark, _PARTICIPANTS))


def _flat(df):
    return df.withColumn("reasons", F.array_join("reasons", ",")).withColumn("missing_years", F.array_join("missing_years", ","))


def compare_universe(spark, sf_dir):
    return _flat(_universe(spark, sf_dir))


def universe_ledger(spark, sf_dir):
    return _flat(uni.ledger(_universe(spark, sf_dir)))


def universe_missing_pairs(spark, sf_dir):
    return uni.missing_pairs(_universe(spark, sf_dir))


def universe_counts(spark, sf_dir):
    return uni.universe_counts(_universe(spark, sf_dir))


def _years_of(obs):
    """The years a panel has: one small distinct."""
    return [r["year"] for r in obs.select("year").distinct().orderBy("year").collect()]


def universe_requests(spark, sf_dir):
    """The frozen universe of every metric, year pair and year triple of the panel."""
    p = part_panel(spark, sf_dir)
    years = _years_of(p.obs)
    plans = [
        uni.UniversePlan("-".join([metric, *map(str, asked)]), metric, asked)
        for metric in PART_METRICS for asked in year_pairs(years) + year_triples(years)
    ]
    people = uni.participants_frame(spark, [(plan.key, P[n], "entity") for plan in plans for n in (1, 2, 199)])
    return uni.universe_sizes(p.obs, plans, people)


def series_completeness(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    return presence.completeness(p.obs, list(PART_METRICS), _years_of(p.obs))


def complete_since(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    years = _years_of(p.obs)
    return presence.first_complete(presence.presence(p.obs, list(PART_METRICS), years), years)


def membership_hash(spark, sf_dir):
    return uni.membership_hashes(_universe(spark, sf_dir), "plan", F.col("reference"))


def _members(spark, sf_dir):
    """Every brand as a group of its parts."""
    dim = part_panel(spark, sf_dir, ("total_current",)).dim.where(~F.col("is_aggregate"))
    return dim.select(F.col("income_level").alias("group_key"), F.col("entity").alias("member"))


def group_series(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    return shaped(groups.group_series(_members(spark, sf_dir), p.obs, "exports_current", [A, M, B]))


def group_missing(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    return groups.missing_members(_members(spark, sf_dir), p.obs, "exports_current", [A, M, B])


def group_coverage(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    return groups.group_coverage(_members(spark, sf_dir), p.obs, "exports_current", [A, M, B])


def group_coverage_members(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    out = groups.member_coverage(_members(spark, sf_dir), p.obs, "exports_current", [A, M, B])
    return out.withColumn("missing_years", F.array_join("missing_years", ","))


def point_coverage(spark, sf_dir):
    """Every part and every brand against the years of a comparison."""
    p = part_panel(spark, sf_dir, ("exports_current",), aggregates=True)
    out = groups.point_coverage(p.dim.select("entity", "is_aggregate"), p.obs, "exports_current", [A, M, B])
    return out.withColumn("missing_years", F.array_join("missing_years", ","))


def group_membership_effect(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    series = groups.group_series(_members(spark, sf_dir), p.obs, "exports_current", [A, M, B])
    return shaped(groups.membership_effect(series, A, B))


def group_ratio(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("fdi_inflows_pct_gdp", "fdi_inflows", "total_current"))
    out = groups.group_ratio_series(_small_groups(spark, sf_dir), stored(p), "fdi_inflows_pct_gdp", [A, M, B])
    return shaped(out)


def _small_groups(spark, sf_dir):
    """Parts grouped by type and size: small enough for complete, mixed-vintage and missing cases."""
    dim = part_panel(spark, sf_dir, ("total_current",)).dim.where(~F.col("is_aggregate"))
    key = F.concat_ws("|", "region", "lending_type", "income_level")
    return dim.select(key.alias("group_key"), F.col("entity").alias("member"))


def group_evaluation(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("fdi_inflows_pct_gdp", "total_current", "inflation_cpi", "exports_current"))
    metrics = ["fdi_inflows_pct_gdp", "inflation_cpi", "exports_current"]
    return groups.group_evaluation(_members(spark, sf_dir), p.obs, metrics, [A, B])


def group_overlap(spark, sf_dir):
    """Parts sold in one year against parts sold in another, per brand."""
    p = part_panel(spark, sf_dir, ("exports_current",))
    dim = p.dim.where(~F.col("is_aggregate")).select("entity", "income_level")
    return uni.overlap(_brand_pairs(p, dim))


def _brand_pairs(p, dim):
    rows = p.obs.where(F.col("year").isin([A, B])).join(dim, "entity")
    slot = F.when(F.col("year") == A, "a").otherwise("b")
    return rows.select(F.col("income_level").alias("pair"), slot.alias("slot"), F.col("entity").alias("member"))


def group_overlap_members(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("exports_current",))
    return uni.overlap_members(_brand_pairs(p, p.dim.where(~F.col("is_aggregate")).select("entity", "income_level")))


def aligned_series(spark, sf_dir):
    """Three entities' series of every metric side by side."""
    p = part_panel(spark, sf_dir)
    return shaped(uni.align_series(p.obs, P[:3], ["metric"], "entity"))


_SPECS = [
    ("s1", "country:P000000001", None), ("s2", " Country : p000000002 ", None), ("s3", "aggregate:BRAND11", None),
    ("s4", "group:P000000003, P000000001 ,", "Mine"), ("s5", "custom_group:P000000001", None), ("s6", "group:", None),
    ("s7", "group:P000000001,P000000001", None), ("s8", "group:P000000001,???", None), ("s9", "planet:EARTH", None),
    ("s10", "country", None), ("s11", "", None), ("s12", None, None), ("s13", "country:P000000001", "label"),
    ("s14", "group:P000000001", "x" * 81), ("s15", "country:ZZZ", None), ("s16", "country:BRAND11", None),
    ("s17", "aggregate:ZZZ", None), ("s18", "aggregate:P000000001", None), ("s19", "group:P000000001,ZZZ", None),
    ("s20", "group:P000000001,BRAND11", None), ("s21", "group:" + ",".join(P[:51]), None),
]


def entity_specs(spark, sf_dir):
    dim = part_panel(spark, sf_dir, ("total_current",)).dim
    specs = spark.createDataFrame(_SPECS, "id string, spec string, label string")
    out = entities.resolve_specs(entities.parse_specs(specs, max_members=50), dim)
    return out.select("id", "kind", F.array_join("members", ",").alias("members"), "name", "error_code")


# --- SQL -----------------------------------------------------------------------------------------------
_FULL = STORE  # part_obs, brand_obs and store


def _kind(spec):
    return {"country": "COUNTRY", "aggregate": "OFFICIAL_AGGREGATE", "group": "CUSTOM_GROUP"}[spec.split(":")[0]]


def _eval_sql():
    whole = "CASE WHEN have = need THEN total END"
    later = "CASE WHEN later_have = later_need THEN later_total END"
    two = "CASE WHEN x IS NULL AND y IS NULL THEN 'both_values_missing' WHEN x IS NULL THEN 'missing_base_value' WHEN y IS NULL THEN 'missing_current_value'"
    sign = "WHEN {0} = 0 THEN 'zero_base_for_percent_change' WHEN {0} < 0 THEN 'negative_base_for_percent_change' WHEN {1} < 0 THEN 'sign_change_across_endpoints'"
    value = f"""CASE statistic WHEN 'level' THEN x WHEN 'CROSS_RATE' THEN x WHEN 'ABSOLUTE' THEN y - x WHEN 'PP' THEN y - x WHEN 'INDEX_POINT' THEN y - x
      WHEN 'PERCENT' THEN CASE WHEN x > 0 AND y >= 0 THEN (y / x - 1) * 100 END
      WHEN 'CAGR' THEN CASE WHEN x > 0 AND y >= 0 THEN (pow(y / x, 1.0 / ("end" - start)) - 1) * 100 END
      WHEN 'PERIOD_SUM' THEN {whole} WHEN 'MOVEMENT_PERIOD_TOTAL' THEN {whole}
      WHEN 'PERIOD_AVG' THEN ({whole}) / need WHEN 'MOVEMENT_PERIOD_AVERAGE' THEN ({whole}) / need
      WHEN 'MOVEMENT_CUMULATIVE_INFLATION' THEN CASE WHEN have = need THEN (prod - 1) * 100 END
      WHEN 'PERIOD_SUM_PERCENT_CHANGE' THEN CASE WHEN ({whole}) > 0 AND ({later}) >= 0 THEN (({later}) / ({whole}) - 1) * 100 END END"""
    reason = f"""CASE WHEN statistic IN ('level', 'CROSS_RATE') THEN CASE WHEN x IS NULL THEN 'MISSING_REQUIRED_DATA' END
      WHEN statistic IN ('ABSOLUTE', 'PP', 'INDEX_POINT') THEN {two} END
      WHEN statistic IN ('PERCENT', 'CAGR') THEN {two} {sign.format('x', 'y')} END
      WHEN statistic = 'PERIOD_SUM_PERCENT_CHANGE' THEN
        {two.replace('x IS NULL', '(' + whole + ') IS NULL').replace('y IS NULL', '(' + later + ') IS NULL')} {sign.format('(' + whole + ')', '(' + later + ')')} END
      WHEN statistic = 'MISSING_MIDDLE_YEAR' THEN 'MISSING_MIDDLE_YEAR'
      WHEN have < need THEN 'incomplete_period' END"""
    return value, reason


def _compare_sql():
    reqs = _requests(None, None)
    plans = {r.key: cmp.resolve_plan(r.operation, r.metric, r.year_a, r.year_b, r.year_c) for r in reqs}
    rq, mb, ry, iv, iy = [], [], [], [], []
    for r in reqs:
        plan, metric = plans[r.key], METRICS[r.metric]
        ka, kb = _kind(r.a), _kind(r.b)
        hard = can_compare(metric, ka, kb, r.operation, r.a == r.b)[1] or ""
        stat = "level" if r.operation == "level" else "derived"
        rule = rank_rule(metric, stat) or ("", "")
        if plan.intervals[0].statistic in ("PERIOD_SUM", "PERIOD_AVG", "CROSS_RATE", "MISSING_MIDDLE_YEAR") or r.operation in ("segmented_growth", "period_total_growth"):
            rule = ("", "")
        rq.append((r.key, r.metric, r.operation, r.mode, len(plan.required), hard, metric.gap_unit, rule[0], -1 if rule[1] == "ASC" else 1,
                   metric.numerator or "", metric.denominator or "", ka, kb))
        for slot, spec in (("a", r.a), ("b", r.b)):
            mb += [(r.key, slot, _kind(spec), m) for m in sorted(spec.split(":")[1].split(","))]
        ry += [(r.key, y) for y in plan.required]
        for n, i in enumerate(plan.intervals):
            iv.append((r.key, i.name, n, i.start, i.end, i.statistic))
            iy += [(r.key, i.name, 0, y) for y in i.years] + [(r.key, i.name, 1, y) for y in i.later]
    value, reason = _eval_sql()

    def figures(src, ids):
        return f"""
  SELECT {ids}, iv.interval, iv.position, iv.start, iv."end", iv.statistic,
    min_by(v.value, iy.year) FILTER (WHERE part = 0 AND iy.year = iv.start_year) AS x,
    max(CASE WHEN part = 0 AND iy.year = iv.last_year THEN v.value END) AS y,
    sum(CAST(v.value AS DECIMAL(38,10))) FILTER (WHERE part = 0)::DOUBLE AS total,
    count(v.value) FILTER (WHERE part = 0) AS have, count(*) FILTER (WHERE part = 0) AS need,
    sum(CAST(v.value AS DECIMAL(38,10))) FILTER (WHERE part = 1)::DOUBLE AS later_total,
    count(v.value) FILTER (WHERE part = 1) AS later_have, count(*) FILTER (WHERE part = 1) AS later_need,
    product(1 + v.value / 100) FILTER (WHERE part = 0) AS prod,
    bool_or(v.value IS NOT NULL AND NOT v.complete) AS partial
  FROM {src}
  JOIN iv ON iv.request = s.request JOIN iy ON iy.request = iv.request AND iy.interval = iv.interval
  LEFT JOIN sv v ON {{match}} AND v.year = iy.year
  GROUP BY {ids}, iv.interval, iv.position, iv.start, iv."end", iv.statistic"""

    slot_figs = figures("slots s", "s.request, s.slot, s.kind").replace("{match}", "v.request = s.request AND v.slot = s.slot")
    ent_figs = figures("ents s", "s.request, s.entity").replace("LEFT JOIN sv v ON {match} AND", "LEFT JOIN ev v ON v.request = s.request AND v.entity = s.entity AND")
    return with_(_FULL, PART_DIM, f"""
rq AS (SELECT * FROM (VALUES {values_(rq)}) t(request, metric, operation, mode, nreq, hard, gap_unit, rule, sgn, num, den, a_kind, b_kind)),
mb AS (SELECT * FROM (VALUES {values_(mb)}) t(request, slot, kind, member)),
ry AS (SELECT * FROM (VALUES {values_(ry)}) t(request, year)),
iy AS (SELECT * FROM (VALUES {values_(iy)}) t(request, interval, part, year)),
iv AS (SELECT t.*, (SELECT min(year) FROM iy WHERE iy.request = t.request AND iy.interval = t.interval AND part = 0) AS start_year,
    (SELECT max(year) FROM iy WHERE iy.request = t.request AND iy.interval = t.interval AND part = 0) AS last_year
  FROM (VALUES {values_(iv)}) t(request, interval, position, start, "end", statistic)),
cells AS (
  SELECT m.*, r.metric, r.mode, y.year, o.value AS own, n.value AS num, d.value AS den, r.num <> '' AND m.kind = 'CUSTOM_GROUP' AS weighted, r.nreq
  FROM mb m JOIN rq r ON r.request = m.request JOIN ry y ON y.request = m.request
  LEFT JOIN store o ON o.entity = m.member AND o.metric = r.metric AND o.year = y.year
  LEFT JOIN store n ON n.entity = m.member AND n.metric = r.num AND n.year = y.year
  LEFT JOIN store d ON d.entity = m.member AND d.metric = r.den AND d.year = y.year),
flagged AS (SELECT *, count(own) OVER (PARTITION BY request, slot, member) = nreq AS full_member FROM cells),
used AS (SELECT *, mode = 'observed' OR full_member AS used FROM flagged),
sv AS (
  SELECT request, slot, kind, year,
    CASE WHEN any_value(weighted) THEN
        CASE WHEN count(*) FILTER (WHERE used) > 0 AND count(*) FILTER (WHERE used AND num IS NOT NULL AND den IS NOT NULL) = count(*) FILTER (WHERE used)
          THEN sum(CAST(num AS DECIMAL(38,10))) FILTER (WHERE used)::DOUBLE / sum(CAST(den AS DECIMAL(38,10))) FILTER (WHERE used)::DOUBLE * 100 END
      ELSE sum(CAST(own AS DECIMAL(38,10))) FILTER (WHERE used)::DOUBLE END AS value,
    CASE WHEN any_value(weighted) OR any_value(mode) = 'like_for_like' THEN true ELSE count(own) = count(*) END AS complete
  FROM used GROUP BY request, slot, kind, year),
slots AS (SELECT DISTINCT request, slot, kind FROM mb),
sf AS ({slot_figs}),
sval AS (SELECT request, slot, kind, interval, position, start, "end", statistic,
    partial, {value} AS value, {reason} AS reason FROM sf),
sdone AS (SELECT * REPLACE (CASE WHEN partial AND statistic <> 'level' THEN NULL ELSE value END AS value,
    CASE WHEN partial AND statistic <> 'level' THEN 'COVERAGE_INCOMPLETE' ELSE reason END AS reason) FROM sval),
ev AS (SELECT r.request, o.entity, o.year, o.value, true AS complete FROM rq r JOIN ry y ON y.request = r.request
  JOIN part_obs o ON o.metric = r.metric AND o.year = y.year WHERE r.rule <> ''),
ents AS (SELECT request, entity FROM (
    SELECT e.request, e.entity, count(*) AS c, any_value(r.nreq) AS nreq, any_value(r.mode) AS mode
    FROM ev e JOIN rq r ON r.request = e.request GROUP BY e.request, e.entity) t WHERE mode = 'observed' OR c = nreq),
ef AS ({ent_figs}),
ranks AS (
  SELECT e.request, interval, entity,
    CASE WHEN r.rule = 'ordinal' THEN row_number() OVER (PARTITION BY e.request, interval ORDER BY value * sgn DESC, entity)
      ELSE rank() OVER (PARTITION BY e.request, interval ORDER BY value * sgn DESC) END AS rank,
    count(*) OVER (PARTITION BY e.request, interval) AS n
  FROM (SELECT *, {value} AS value, {reason} AS reason FROM ef) e JOIN rq r ON r.request = e.request WHERE reason IS NULL),
placed AS (SELECT s.*, k.rank, k.n FROM sdone s
  LEFT JOIN mb m ON m.request = s.request AND m.slot = s.slot AND m.kind = 'COUNTRY'
  LEFT JOIN ranks k ON k.request = s.request AND k.interval = s.interval AND k.entity = m.member AND s.value IS NOT NULL),
pl2 AS (SELECT s.*, k.n AS frame_n FROM placed s
  LEFT JOIN mb m ON m.request = s.request AND m.slot = s.slot AND m.kind = 'COUNTRY'
  LEFT JOIN ranks k ON k.request = s.request AND k.interval = s.interval AND k.entity = m.member),
both_sides AS (
  SELECT r.*, a.interval, a.position, a.start, a."end", a.statistic,
    a.value AS a_value, a.reason AS a_reason, a.rank AS a_rank, a.frame_n AS a_n, a.partial AS a_partial,
    b.value AS b_value, b.reason AS b_reason, b.rank AS b_rank, b.frame_n AS b_n, b.partial AS b_partial,
    r.mode = 'like_for_like' AND (a_kind = 'OFFICIAL_AGGREGATE' OR b_kind = 'OFFICIAL_AGGREGATE') AS agg_block
  FROM rq r JOIN pl2 a ON a.request = r.request AND a.slot = 'a' JOIN pl2 b ON b.request = r.request AND b.slot = 'b' AND b.interval = a.interval),
judged AS (
  SELECT *, CASE
      WHEN statistic = 'level' THEN CASE WHEN a_value IS NULL OR b_value IS NULL THEN 'MISSING_REQUIRED_DATA' WHEN hard <> '' THEN hard
        WHEN a_partial OR b_partial THEN 'COVERAGE_INCOMPLETE' WHEN agg_block THEN 'AGGREGATE_COVERAGE_NOT_COMPARABLE' END
      WHEN statistic = 'CROSS_RATE' THEN CASE WHEN hard <> '' THEN hard WHEN a_value IS NULL OR b_value IS NULL OR a_value <= 0 OR b_value <= 0 THEN 'MISSING_REQUIRED_DATA' END
      WHEN hard <> '' THEN hard WHEN agg_block THEN 'AGGREGATE_COVERAGE_NOT_COMPARABLE' ELSE coalesce(a_reason, b_reason) END AS gap_reason
  FROM both_sides)""") + """
SELECT request, metric, operation, mode, interval, position, start, "end", round(a_value, 4) + 0.0 AS a_value, a_reason, a_rank, a_n,
  round(b_value, 4) + 0.0 AS b_value, b_reason, b_rank, b_n,
  round(CASE WHEN gap_reason IS NULL THEN CASE WHEN statistic = 'CROSS_RATE' THEN a_value / b_value ELSE (a_value - b_value) END END, 4) + 0.0 AS gap, gap_reason,
  CASE WHEN statistic = 'MISSING_MIDDLE_YEAR' THEN 'MISSING_MIDDLE_YEAR' WHEN agg_block THEN 'AGGREGATE_COVERAGE_NOT_COMPARABLE'
    WHEN hard <> '' THEN hard WHEN a_partial OR b_partial THEN 'COVERAGE_INCOMPLETE' WHEN gap_reason IS NOT NULL THEN 'MISSING_REQUIRED_DATA' END AS block,
  CASE WHEN statistic = 'CROSS_RATE' THEN 'cross_rate'
    WHEN statistic IN ('PERCENT', 'CAGR', 'PERIOD_SUM_PERCENT_CHANGE', 'MOVEMENT_CUMULATIVE_INFLATION', 'PP', 'MISSING_MIDDLE_YEAR') THEN 'percentage points'
    WHEN statistic = 'INDEX_POINT' THEN 'index points' ELSE gap_unit END AS gap_unit
FROM judged"""


_UNIVERSE = with_(PART, f"""
plans AS (SELECT * FROM (VALUES {values_([(p.key, p.metric, y) for p in PLANS for y in p.years])}) t(plan, metric, year)),
part_in AS (SELECT plan, entity, CASE WHEN count(DISTINCT role) > 1 THEN 'entity_and_group_member' ELSE min(role) END AS role
  FROM (VALUES {values_(_PARTICIPANTS)}) t(plan, entity, role) GROUP BY plan, entity),
cand AS (SELECT DISTINCT p.plan, o.entity FROM plans p JOIN part_obs o ON o.metric = p.metric AND o.year = p.year),
miss AS (SELECT c.plan, c.entity, string_agg(CAST(p.year AS VARCHAR), ',' ORDER BY p.year) AS missing_years
  FROM cand c JOIN plans p ON p.plan = c.plan
  WHERE NOT EXISTS (SELECT 1 FROM part_obs o WHERE o.entity = c.entity AND o.metric = p.metric AND o.year = p.year) GROUP BY 1, 2),
members AS (
  SELECT coalesce(c.plan, i.plan) AS plan, coalesce(c.entity, i.entity) AS entity, c.entity IS NOT NULL AS candidate,
    c.entity IS NOT NULL AND m.entity IS NULL AS complete, c.entity IS NOT NULL AND m.entity IS NULL AND i.entity IS NULL AS reference, role,
    concat_ws(',', CASE WHEN i.entity IS NOT NULL THEN 'comparison_participant' END,
      CASE WHEN m.entity IS NOT NULL THEN 'missing_required_observation' END) AS reasons, coalesce(missing_years, '') AS missing_years
  FROM cand c FULL JOIN part_in i ON i.plan = c.plan AND i.entity = c.entity
  LEFT JOIN miss m ON m.plan = c.plan AND m.entity = c.entity)""")

_HELD = with_(PART, """
held AS MATERIALIZED (SELECT DISTINCT metric, entity, year FROM part_obs WHERE isfinite(value)),
years AS MATERIALIZED (SELECT DISTINCT year FROM part_obs)""")
_REQUESTED = _HELD + f""",
asked AS (
  SELECT concat_ws('-', a.year, b.year) AS years, [a.year, b.year] AS of FROM years a JOIN years b ON a.year < b.year
  UNION ALL SELECT concat_ws('-', a.year, m.year, b.year), [a.year, m.year, b.year] FROM years a JOIN years m ON a.year < m.year JOIN years b ON m.year < b.year),
requested AS (SELECT metric || '-' || years AS plan, metric, unnest(of) AS year, len(of) AS size
  FROM asked CROSS JOIN (VALUES {values_([(m,) for m in PART_METRICS])}) t(metric)),
sizes AS (SELECT DISTINCT plan, metric FROM requested),
seen AS (SELECT plan, entity, count(*) AS got, size, entity IN {tuple(P[n] for n in (1, 2, 199))} AS taking_part
  FROM requested JOIN held USING (metric, year) GROUP BY ALL)"""

_BRAND_MEMBERS = """
members AS (SELECT income_level AS group_key, entity AS member FROM part_dim WHERE NOT is_aggregate),
gcells AS (
  SELECT g.group_key, g.member, y.year, o.value, count(o.value) OVER (PARTITION BY g.group_key, g.member) = 3 AS full_member
  FROM members g CROSS JOIN (VALUES ({A}), ({M}), ({B})) y(year)
  LEFT JOIN part_obs o ON o.entity = g.member AND o.metric = 'exports_current' AND o.year = y.year),
gseries AS (
  SELECT group_key, 'exports_current' AS metric, year, sum(CAST(value AS DECIMAL(38,10)))::DOUBLE AS observed,
    count(value) = count(*) AS complete, count(value) AS valid, count(*) - count(value) AS missing,
    sum(CAST(value AS DECIMAL(38,10))) FILTER (WHERE full_member)::DOUBLE AS like_for_like, count(*) FILTER (WHERE full_member) AS common_members
  FROM gcells GROUP BY group_key, year)""".replace("{A}", str(A)).replace("{M}", str(M)).replace("{B}", str(B))
_GROUP_SQL = with_(PART, PART_DIM, _BRAND_MEMBERS)

_RATIO_SQL = with_(STORE, PART_DIM, f"""
members AS (SELECT concat_ws('|', region, lending_type, income_level) AS group_key, entity AS member FROM part_dim WHERE NOT is_aggregate),
rc AS (
  SELECT g.*, y.year, o.value AS own, n.value AS num, d.value AS den, n.vintage AS nv, d.vintage AS dv,
    count(o.value) OVER (PARTITION BY g.group_key, g.member) = 3 AS common
  FROM members g CROSS JOIN (VALUES ({A}), ({M}), ({B})) y(year)
  LEFT JOIN store o ON o.entity = g.member AND o.metric = 'fdi_inflows_pct_gdp' AND o.year = y.year
  LEFT JOIN store n ON n.entity = g.member AND n.metric = 'fdi_inflows' AND n.year = y.year
  LEFT JOIN store d ON d.entity = g.member AND d.metric = 'total_current' AND d.year = y.year),
rs AS (
  SELECT group_key, year, count(*) AS c1, count(num + den) AS v1, sum(num) FILTER (WHERE den IS NOT NULL) AS n1, sum(den) FILTER (WHERE num IS NOT NULL) AS d1,
    count(DISTINCT nv) FILTER (WHERE num + den IS NOT NULL) > 1 OR count(DISTINCT dv) FILTER (WHERE num + den IS NOT NULL) > 1 AS mix1,
    count(*) FILTER (WHERE common) AS c2, count(num + den) FILTER (WHERE common) AS v2, sum(num) FILTER (WHERE common) AS n2, sum(den) FILTER (WHERE common) AS d2,
    count(DISTINCT nv) FILTER (WHERE common AND num + den IS NOT NULL) > 1 OR count(DISTINCT dv) FILTER (WHERE common AND num + den IS NOT NULL) > 1 AS mix2,
    count(*) FILTER (WHERE num IS NULL) AS missing_numerators, count(*) FILTER (WHERE den IS NULL) AS missing_denominators
  FROM rc GROUP BY group_key, year),
rr AS (SELECT *,
    CASE WHEN v1 < c1 THEN 'MISSING_REQUIRED_DATA' WHEN mix1 THEN 'INCOMPATIBLE_LEGS' END AS r1,
    CASE WHEN v2 < c2 THEN 'MISSING_REQUIRED_DATA' WHEN mix2 THEN 'INCOMPATIBLE_LEGS' WHEN c2 = 0 THEN 'empty_input_set' END AS r2 FROM rs)""")


def _basis_sql(basis, operation, mode):
    from panelyst.plans.bases import _common_sql, _movement_ctes, _pivot, _stat_sql
    from panelyst.registry import BASES

    b = BASES[basis]
    spans = [(str(y), y, y) for y in (A, M, B)] if b.scope == "year" else [("AM", A, M), ("MB", M, B), ("AB", A, B)]
    like = mode == "like_for_like"
    mb = [(k, s, _kind(x), m) for k, x, y in _BASIS_PAIRS for s, x in (("a", x), ("b", y)) for m in sorted(x.split(":")[1].split(","))]
    legs = sorted(b.legs)
    cells = ", ".join(
        f'CASE WHEN count("{leg}_{y}") = count(*) THEN sum(CAST("{leg}_{y}" AS DECIMAL(38,10)))::DOUBLE END AS "{leg}_{y}"'
        for leg in legs for y in range(A - 1, B + 1)
    )
    computable = " AND ".join(f"({_stat_sql(b, s, e)[1]}) IS NULL" for _, s, e in spans)
    keep = f"WHERE m.kind <> 'CUSTOM_GROUP' OR ({_common_sql(b, spans)} AND {computable})" if like else ""
    head = _movement_ctes([b], PART)
    pivot = _pivot(legs).replace("wide AS", "store_wide AS").replace("part_obs", "store")
    rows = " UNION ALL ".join(
        f"SELECT request, slot, kind, '{n}' AS period, {s} AS start, {e} AS \"end\", CASE WHEN ({_stat_sql(b, s, e)[1]}) IS NULL THEN {_stat_sql(b, s, e)[0]} END AS value, {_stat_sql(b, s, e)[1]} AS reason FROM slot_wide"
        for n, s, e in spans
    )
    universe = "like_for_like" if like else "observed"
    tail = f""",
{STORE.split('part_obs AS (')[1].split('brand_wide AS')[0] and ''}brand_wide AS {STORE.split('brand_wide AS ')[1]},
{pivot},
smb AS (SELECT * FROM (VALUES {values_(mb)}) t(request, slot, kind, member)),
slot_wide AS (SELECT m.request, m.slot, m.kind, {cells} FROM smb m LEFT JOIN store_wide w ON w.entity = m.member {keep} GROUP BY 1, 2, 3),
sval AS ({rows}),
srank AS (SELECT s.*, k.rank, k.n FROM sval s LEFT JOIN smb m ON m.request = s.request AND m.slot = s.slot AND m.kind = 'COUNTRY'
  LEFT JOIN mv k ON k.entity = m.member AND k.period = s.period AND k.universe = '{universe}' AND k.rank IS NOT NULL)"""
    if operation != "level":
        tail += f""",
sdiff AS (
  SELECT x.request, x.slot, x.kind, x.start || '-' || y.start AS period, x.start, y.start AS "end", y.value - x.value AS value,
    coalesce(x.reason, y.reason) AS reason
  FROM srank x JOIN srank y ON y.request = x.request AND y.slot = x.slot AND x.start < y.start),
echange AS (
  SELECT x.entity, x.start || '-' || y.start AS period, y.value - x.value AS value FROM mv x JOIN mv y ON y.entity = x.entity AND x.start < y.start
  WHERE x.universe = '{universe}' AND y.universe = '{universe}' AND x.rank IS NOT NULL AND y.rank IS NOT NULL),
erank AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY period) AS n FROM echange),
sranked AS (SELECT d.*, CASE WHEN d.value IS NOT NULL THEN k.rank END AS rank, k.n FROM sdiff d
  LEFT JOIN smb m ON m.request = d.request AND m.slot = d.slot AND m.kind = 'COUNTRY'
  LEFT JOIN erank k ON k.entity = m.member AND k.period = d.period)"""
    final = "srank" if operation == "level" else "sranked"
    pairs = [(f"{s}-{e}", s, e) for s, e in ((A, M), (M, B), (A, B))] if operation != "level" else spans
    kinds = values_([(k, _kind(x), _kind(y)) for k, x, y in _BASIS_PAIRS])
    return head + tail + f""",
grid AS (SELECT * FROM (VALUES {kinds}) k(request, ak, bk) CROSS JOIN (VALUES {values_(pairs)}) p(period, start, "end")),
j AS (SELECT g.*, a.value AS av, a.reason AS ar, a.rank AS a_rank, a.n AS a_n, b.value AS bv, b.reason AS br, b.rank AS b_rank, b.n AS b_n,
    {str(like).lower()} AND 'OFFICIAL_AGGREGATE' IN (ak, bk) AS blocked
  FROM grid g LEFT JOIN {final} a ON a.request = g.request AND a.period = g.period AND a.slot = 'a'
  LEFT JOIN {final} b ON b.request = g.request AND b.period = g.period AND b.slot = 'b'),
jr AS (SELECT *, CASE WHEN blocked THEN 'AGGREGATE_COVERAGE_NOT_COMPARABLE' WHEN av IS NULL THEN coalesce(ar, 'MISSING_REQUIRED_DATA')
    WHEN bv IS NULL THEN coalesce(br, 'MISSING_REQUIRED_DATA') END AS gap_reason FROM j)
SELECT request, '{basis}' AS basis, '{operation}' AS operation, '{mode}' AS mode, period, start, "end",
  round(av, 4) + 0.0 AS a_value, a_rank, a_n, round(bv, 4) + 0.0 AS b_value, b_rank, b_n,
  round(CASE WHEN gap_reason IS NULL THEN (av - bv) END, 4) + 0.0 AS gap, gap_reason FROM jr"""


def _series_sql():
    wanted = [r for r in _requests(None, None) if r.key in ("level_obs", "level_agg", "level_lfl")]
    plans = {r.key: cmp.resolve_plan(r.operation, r.metric, r.year_a, r.year_b, r.year_c) for r in wanted}
    mb = [(r.key, s, _kind(x), m) for r in wanted for s, x in (("a", r.a), ("b", r.b)) for m in sorted(x.split(":")[1].split(","))]
    ys = [(r.key, y, y in plans[r.key].required) for r in wanted for y in plans[r.key].series]
    modes = [(r.key, r.metric, r.mode) for r in wanted]
    return with_(_FULL, f"""
sc AS (
  SELECT m.*, q.mode, y.year, o.value, count(o.value) FILTER (WHERE y.needed) OVER w = count(*) FILTER (WHERE y.needed) OVER w AS full_member
  FROM (VALUES {values_(mb)}) m(request, slot, kind, member) JOIN (VALUES {values_(modes)}) q(request, metric, mode) ON q.request = m.request
  JOIN (VALUES {values_(ys)}) y(request, year, needed) ON y.request = m.request
  LEFT JOIN store o ON o.entity = m.member AND o.metric = q.metric AND o.year = y.year
  WINDOW w AS (PARTITION BY m.request, m.slot, m.member)),
su AS (SELECT *, mode = 'observed' OR full_member OR kind <> 'CUSTOM_GROUP' AS used FROM sc),
sg AS (SELECT request, slot, kind, year, sum(CAST(value AS DECIMAL(38,10))) FILTER (WHERE used)::DOUBLE AS total,
    count(value) FILTER (WHERE used) AS valid, count(*) AS members, any_value(mode) = 'like_for_like' AS lfl FROM su GROUP BY request, slot, kind, year),
sd AS (SELECT *, total IS NOT NULL AND (lfl OR valid = members) AS complete FROM sg)""") + """
SELECT request, slot, kind, year, round(CASE WHEN complete THEN total END, 4) AS value, complete, valid, members - valid AS missing FROM sd"""


_BASIS_RUNS = [
    ("ca_annual_gdp", "level", "observed"), ("ca_annual_gdp", "pp_change", "observed"),
    ("ca_average_gdp", "level", "like_for_like"), ("ca_cumulative_share", "level", "observed"),
    ("res_import_coverage", "level", "like_for_like"), ("res_import_coverage", "absolute_change", "observed"),
    ("remit_cumulative_intensity", "level", "observed"), ("fdigdp_period_cumulative_share", "level", "like_for_like"),
]

_SPEC_ANSWERS = [
    ("s1", "COUNTRY", "P000000001", ""), ("s2", "COUNTRY", "P000000002", ""), ("s3", "OFFICIAL_AGGREGATE", "BRAND11", ""),
    ("s4", "CUSTOM_GROUP", "P000000001,P000000003", ""), ("s5", "CUSTOM_GROUP", "P000000001", ""), ("s6", "CUSTOM_GROUP", "", "EMPTY_GROUP"),
    ("s7", "CUSTOM_GROUP", "", "INVALID_GROUP"), ("s8", "CUSTOM_GROUP", "", "INVALID_GROUP_MEMBER"), ("s9", "", "", "INVALID_ENTITY"),
    ("s10", "", "", "INVALID_ENTITY"), ("s11", "", "", "INVALID_ENTITY"), ("s12", "", "", "INVALID_ENTITY"),
    ("s13", "COUNTRY", "", "INVALID_ENTITY"), ("s14", "CUSTOM_GROUP", "", "INVALID_GROUP"), ("s15", "COUNTRY", "ZZZ", "INVALID_COUNTRY"),
    ("s16", "COUNTRY", "BRAND11", "INVALID_COUNTRY"), ("s17", "OFFICIAL_AGGREGATE", "ZZZ", "NO_OFFICIAL_AGGREGATE"),
    ("s18", "OFFICIAL_AGGREGATE", "P000000001", "INVALID_ENTITY"), ("s19", "CUSTOM_GROUP", "P000000001,ZZZ", "INVALID_GROUP_MEMBER"),
    ("s20", "CUSTOM_GROUP", "BRAND11,P000000001", "INVALID_GROUP_MEMBER"), ("s21", "CUSTOM_GROUP", "", "INVALID_GROUP"),
]
_LABELS = {i: label for i, _, label in _SPECS if label}


def _specs_sql():
    rows = [(*row, _LABELS.get(row[0], "")) for row in _SPEC_ANSWERS]
    return with_(PART_DIM) + f"""
SELECT id, nullif(kind, '') AS kind, nullif(members, '') AS members,
  CASE WHEN kind = 'CUSTOM_GROUP' THEN coalesce(nullif(label, ''), 'Own group of ' || nullif(len(string_split(nullif(members, ''), ',')), 0))
    ELSE (SELECT name FROM part_dim d WHERE d.entity = t.members) END AS name, nullif(error_code, '') AS error_code
FROM (VALUES {values_(rows)}) t(id, kind, members, error_code, label)"""


_REFUSED_SQL = [
    ("bad_operation", "INVALID_OPERATION"), ("bad_transform", "UNSUPPORTED_TRANSFORMATION"), ("bad_order", "INVALID_YEAR_ORDER"),
    ("same_year", "SAME_YEAR_SELECTED"), ("no_year", "MISSING_YEAR"), ("unknown", "INVALID_COUNTRY"),
    ("aggregate_as_country", "INVALID_COUNTRY"), ("country_as_aggregate", "INVALID_ENTITY"),
    ("no_aggregate", "NO_OFFICIAL_AGGREGATE"), ("bad_member", "INVALID_GROUP_MEMBER"),
]

QUERIES = {
    "compare_requests": (compare_requests, _compare_sql()),
    "compare_refused": (compare_refused, f"SELECT * FROM (VALUES {values_(_REFUSED_SQL)}) t(request, error)"),
    "compare_series": (compare_series, _series_sql()),
    "compare_universe": (compare_universe, _UNIVERSE + "SELECT * FROM members"),
    "universe_ledger": (universe_ledger, _UNIVERSE + "SELECT plan, entity, role, complete, reasons, missing_years FROM members WHERE reasons <> ''"),
    "universe_missing_pairs": (universe_missing_pairs, _UNIVERSE + """
SELECT plan, entity, CAST(y AS INTEGER) AS year FROM (SELECT plan, entity, unnest(string_split(missing_years, ',')) AS y FROM members WHERE missing_years <> '') t"""),
    "universe_counts": (universe_counts, _UNIVERSE + """
SELECT plan, count(*) FILTER (WHERE candidate) AS candidates, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE reference) AS reference,
  count(*) FILTER (WHERE reasons <> '') AS excluded, count(role) AS participants, count(*) FILTER (WHERE candidate AND NOT complete) AS incomplete,
  CAST(sum(CASE WHEN missing_years = '' THEN 0 ELSE len(string_split(missing_years, ',')) END) AS BIGINT) AS missing_observations
FROM members GROUP BY plan"""),
    "universe_requests": (universe_requests, _REQUESTED + """
SELECT r.plan, r.metric, coalesce(n, 0) AS candidates, coalesce(c, 0) AS complete, coalesce(c - pc, 0) AS reference,
  coalesce(n - c - pi, 0) + 3 AS excluded, CAST(3 AS BIGINT) AS participants, coalesce(n - c, 0) AS incomplete, coalesce(lacking, 0) AS missing_observations
FROM sizes r LEFT JOIN (
  SELECT plan, count(*) AS n, count(*) FILTER (WHERE got = size) AS c, CAST(sum(size - got) AS BIGINT) AS lacking,
    count(*) FILTER (WHERE got = size AND taking_part) AS pc, count(*) FILTER (WHERE got < size AND taking_part) AS pi
  FROM seen GROUP BY plan) t ON t.plan = r.plan"""),
    "series_completeness": (series_completeness, _HELD + """
SELECT metric, entity, CAST(count(*) AS INTEGER) AS years_held, count(*) = (SELECT count(*) FROM years) AS complete, min(year) AS first_year, max(year) AS last_year,
  CAST(coalesce(max(gap), 0) AS INTEGER) AS longest_gap
FROM (SELECT metric, entity, year, year - lag(year) OVER (PARTITION BY metric, entity ORDER BY year) - 1 AS gap FROM held) t GROUP BY metric, entity"""),
    "complete_since": (complete_since, _HELD + """
SELECT metric, start, count(*) FILTER (WHERE got = wanted) AS entities FROM (
  SELECT h.metric, h.entity, y.year AS start, count(*) FILTER (WHERE h.year >= y.year) AS got, any_value(y.wanted) AS wanted
  FROM held h CROSS JOIN (SELECT year, row_number() OVER (ORDER BY year DESC) AS wanted FROM years) y GROUP BY h.metric, h.entity, y.year) t
GROUP BY metric, start"""),
    "membership_hash": (membership_hash, _UNIVERSE + """
SELECT plan, 'fnv1a32:' || lpad(lower(hex(h)), 8, '0') AS membership_hash FROM (
  SELECT plan, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(string_agg(entity || ',', '' ORDER BY entity), ''), lambda c: ascii(c)::BIGINT)),
    lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM members WHERE reference GROUP BY plan) t"""),
    "group_series": (group_series, _GROUP_SQL + """
SELECT group_key, metric, year, round(observed, 4) AS observed, complete, CASE WHEN missing > 0 THEN 'missing_member_observations' END AS partial_reason,
  valid, missing, round(like_for_like, 4) AS like_for_like, common_members, CASE WHEN valid = 0 THEN 'empty_input_set' END AS reason FROM gseries"""),
    "group_missing": (group_missing, _GROUP_SQL + """
SELECT group_key, 'exports_current' AS metric, year, member FROM gcells WHERE value IS NULL"""),
    "group_coverage": (group_coverage, _GROUP_SQL + """,
gm AS (SELECT group_key, member, count(value) = count(*) AS whole FROM gcells GROUP BY ALL),
gu AS (SELECT group_key, count(*) AS members, count(*) FILTER (WHERE whole) AS used FROM gm GROUP BY 1)
SELECT group_key, 'exports_current' AS metric, year, members, used, used = members AS complete,
  count(value) AS valid, count(*) - count(value) AS missing FROM gcells JOIN gu USING (group_key) GROUP BY ALL"""),
    "group_coverage_members": (group_coverage_members, _GROUP_SQL + """
SELECT group_key, 'exports_current' AS metric, member, CASE WHEN count(value) = count(*) THEN 'used' ELSE 'missing' END AS role,
  coalesce(string_agg(CASE WHEN value IS NULL THEN CAST(year AS VARCHAR) END, ',' ORDER BY year), '') AS missing_years
FROM gcells GROUP BY group_key, member"""),
    "point_coverage": (point_coverage, with_(STORE, PART_DIM) + f"""
SELECT d.entity, 'exports_current' AS metric, CASE WHEN is_aggregate THEN 'published_aggregate' ELSE 'own_observation' END AS basis,
  count(value) = count(*) AS complete, count(value) AS years_held,
  coalesce(string_agg(CASE WHEN value IS NULL THEN CAST(y.year AS VARCHAR) END, ',' ORDER BY y.year), '') AS missing_years
FROM part_dim d CROSS JOIN (VALUES ({A}), ({M}), ({B})) y(year)
LEFT JOIN store o ON o.entity = d.entity AND o.metric = 'exports_current' AND o.year = y.year GROUP BY d.entity, is_aggregate"""),
    "group_membership_effect": (group_membership_effect, _GROUP_SQL + f"""
SELECT a.group_key, a.metric, round(a.observed, 4) AS obs_a, round(b.observed, 4) AS obs_b, round(a.like_for_like, 4) AS lfl_a,
  round(b.like_for_like, 4) AS lfl_b,
  round(((b.observed - a.observed) - (b.like_for_like - a.like_for_like)), 4) + 0.0 AS membership_effect
FROM gseries a JOIN gseries b ON b.group_key = a.group_key AND b.year = {B} WHERE a.year = {A}"""),
    "group_ratio": (group_ratio, _RATIO_SQL + """
SELECT group_key, 'fdi_inflows_pct_gdp' AS metric, year, round(CASE WHEN r1 IS NULL THEN n1 / d1 * 100 END, 4) + 0.0 AS observed, r1 AS observed_reason, v1 AS observed_members,
  round(CASE WHEN r2 IS NULL THEN n2 / d2 * 100 END, 4) + 0.0 AS like_for_like, r2 AS like_for_like_reason, v2 AS like_for_like_members,
  missing_numerators, missing_denominators FROM rr"""),
    "group_evaluation": (group_evaluation, with_(PART, PART_DIM, f"""
members AS (SELECT income_level AS group_key, entity AS member FROM part_dim WHERE NOT is_aggregate),
ge AS (SELECT g.group_key, m.metric, y.year, count(o.value) AS valid, count(*) AS members FROM members g
  CROSS JOIN (VALUES ('fdi_inflows_pct_gdp'), ('inflation_cpi'), ('exports_current'), ('total_current')) m(metric)
  CROSS JOIN (VALUES ({A}), ({B})) y(year)
  LEFT JOIN part_obs o ON o.entity = g.member AND o.metric = m.metric AND o.year = y.year GROUP BY 1, 2, 3)""") + """
SELECT a.group_key, a.metric, a.year, a.valid, a.members - a.valid AS missing, CASE WHEN a.metric = 'fdi_inflows_pct_gdp' THEN 'total_current' END AS denominator,
  d.valid AS denominator_valid, a.metric <> 'inflation_cpi' AS can_compute, CASE WHEN a.metric = 'inflation_cpi' THEN 'NOT_AGGREGATABLE' END AS reason
FROM ge a LEFT JOIN ge d ON a.metric = 'fdi_inflows_pct_gdp' AND d.metric = 'total_current' AND d.group_key = a.group_key AND d.year = a.year
WHERE a.metric <> 'total_current'"""),
    "group_overlap": (group_overlap, with_(PART, PART_DIM, f"""
ov AS (SELECT d.income_level AS pair, o.entity, bool_or(year = {A}) AS in_a, bool_or(year = {B}) AS in_b
  FROM part_obs o JOIN part_dim d ON d.entity = o.entity WHERE metric = 'exports_current' AND year IN ({A}, {B}) GROUP BY 1, 2),
oc AS (SELECT pair, count(*) FILTER (WHERE in_a AND in_b) AS shared, count(*) FILTER (WHERE in_a AND NOT in_b) AS only_a,
  count(*) FILTER (WHERE in_b AND NOT in_a) AS only_b FROM ov GROUP BY pair)""") + """
SELECT *, CASE WHEN shared = 0 THEN NULL WHEN only_b = 0 AND only_a > 0 THEN 'a_contains_b' WHEN only_a = 0 AND only_b > 0 THEN 'b_contains_a'
  WHEN only_a = 0 AND only_b = 0 THEN 'identical' END AS nested FROM oc"""),
    "group_overlap_members": (group_overlap_members, with_(PART, PART_DIM, f"""
ov AS (SELECT d.income_level AS pair, o.entity AS member, bool_or(year = {A}) AS in_a, bool_or(year = {B}) AS in_b
  FROM part_obs o JOIN part_dim d ON d.entity = o.entity WHERE metric = 'exports_current' AND year IN ({A}, {B}) GROUP BY 1, 2)""") + """
SELECT pair, member, CASE WHEN in_a AND in_b THEN 'shared' WHEN in_a THEN 'only_a' ELSE 'only_b' END AS side FROM ov"""),
    "aligned_series": (aligned_series, with_(PART) + "SELECT metric, year, " + ", ".join(
        f"round(max(CASE WHEN entity = '{e}' THEN value END), 4) + 0.0 AS s{i}" for i, e in enumerate(P[:3])
    ) + f" FROM part_obs WHERE entity IN {tuple(P[:3])} GROUP BY metric, year"),
    "entity_specs": (entity_specs, _specs_sql()),
}
QUERIES |= {
    f"basis_compare_{basis}_{operation}{suffix}": (
        partial(compare_basis, basis=basis, operation=operation, mode=mode), _basis_sql(basis, operation, mode)
    )
    for basis, operation, usual in _BASIS_RUNS
    for mode, suffix in ((usual, ""), *((m, f"_{m}") for m in ("observed", "like_for_like") if m != usual))
}
