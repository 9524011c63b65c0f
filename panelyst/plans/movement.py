"""Registered movement queries, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from panelyst.operators import growth, movement as mv, rank, verify, yoy
from panelyst.plans import requests as R
from panelyst.plans.oracle_panels import CUST, RANKED, YOY, YOY_RANKED, values_, with_
from panelyst.plans.shape import shaped
from panelyst.sources.tables import CUSTOMER_METRICS, customer_panel

METRICS = len(CUSTOMER_METRICS)
GROWTH = [(R.A, None, R.B), (R.A, R.M, R.B), (1995, 1997, 2001)]


def _ranked(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return p, rank.level_rank(p.obs, p.rows_bound)


def _two(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    return p, ranked, mv.two_year(ranked, R.PAIRS, rows_bound=p.rows_bound, metrics=METRICS)


def movement_two_year(spark, sf_dir):
    return shaped(_two(spark, sf_dir)[2])


def movement_yoy(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    ranked = yoy.yoy_rank(p.obs, p.rows_bound)
    pairs = [(a, b) for a, b in R.PAIRS if a > 1995]
    return shaped(mv.two_year_yoy(ranked, pairs, rows_bound=p.rows_bound, metrics=METRICS))


def movement_three_year(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    return shaped(mv.three_year(ranked, R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS))


def _relations(spark, sf_dir):
    _, _, rows = _two(spark, sf_dir)
    return mv.relations(rows, R.FOCUSES, groups_bound=len(R.PAIRS) * METRICS)


def movement_relations(spark, sf_dir):
    return _relations(spark, sf_dir)


def movement_relation_filters(spark, sf_dir):
    rows = _relations(spark, sf_dir).where((F.col("a") == R.A) & (F.col("b") == R.B))
    return mv.relation_filters(rows, list(_FILTERS)).select("filter", "metric", "a", "b", "focus", "entity", "status")


def movement_outside_filters(spark, sf_dir):
    """Rows outside the common set of a triple, by their relation in each of its years."""
    rows = mv.relation_filters(movement_three_relations(spark, sf_dir), list(_OUTSIDE_FILTERS), mv.SIDES_THREE)
    return rows.select("filter", "metric", "a", "m", "b", "focus", "entity")


def movement_status_positions(spark, sf_dir):
    p, _, rows = _two(spark, sf_dir)
    return mv.status_positions(rows, rows_bound=p.entities_bound)


def movement_verified(spark, sf_dir):
    """Two-year movement behind its own checks."""
    p, ranked = _ranked(spark, sf_dir)
    return shaped(verify.verified_two_year(ranked, R.PAIRS, rows_bound=p.rows_bound, metrics=METRICS))


def movement_three_year_verified(spark, sf_dir):
    """Three-year movement behind its own checks."""
    p, ranked = _ranked(spark, sf_dir)
    return shaped(verify.verified_three_year(ranked, R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS))


def movement_growth_verified(spark, sf_dir):
    """Growth movement behind its own checks."""
    p = customer_panel(spark, sf_dir)
    return shaped(verify.verified_growth(p.obs, GROWTH, rows_bound=p.entities_bound, metrics=METRICS))


def verify_tampered(spark, sf_dir):
    """Requests that each check refuses after one entity's results were changed."""
    p, ranked, rows = _two(spark, sf_dir)
    cases = {"common_rank": "common_rank_a", "set_effect": "set_effect", "entered_above": "entered_above"}
    check = partial(verify.verify_two_year, ranked=ranked, pairs=R.PAIRS, rows_bound=p.rows_bound, metrics=METRICS)
    return _refused(rows, cases, check)


def verify_three_tampered(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    rows = mv.three_year(ranked, R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS)
    cases = {"common_rank": "common_rank_m", "outside_above": "outside_above_b", "set_effect": "set_effect_am"}
    check = partial(verify.verify_three_year, ranked=ranked, triples=R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS)
    return _refused(rows, cases, check)


def verify_growth_tampered(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    rows = growth.growth_movement(p.obs, GROWTH, rows_bound=p.entities_bound, metrics=METRICS)
    cases = {"common_rank": "common_rank", "peer_mean": "peer_mean", "outside_above": "outside_above"}
    check = partial(verify.verify_growth, obs=p.obs, requests=GROWTH, rows_bound=p.entities_bound, metrics=METRICS)
    return _refused(rows, cases, check)


def _refused(rows, cases, check):
    """Requests that each check refuses when one column of the focus's common rows is one too high."""
    mine = (F.col("entity") == R.FOCUS) & (F.col("status") == "common")
    out = None
    for case, column in cases.items():
        wrong = rows.withColumn(column, F.when(mine, F.col(column) + 1).otherwise(F.col(column)))
        part = verify.failures(check(wrong)).groupBy("check").agg(F.count(F.lit(1)).alias("requests"))
        part = part.select(F.lit(case).alias("case"), "check", "requests")
        out = part if out is None else out.unionByName(part)
    return out


def movement_summary(spark, sf_dir):
    return mv.summary_rows(_relations(spark, sf_dir))


def movement_relation_counts(spark, sf_dir):
    return mv.relation_counts(_relations(spark, sf_dir))


def movement_sorted(spark, sf_dir):
    _, _, rows = _two(spark, sf_dir)
    wanted = rows.where((F.col("a") == R.A) & (F.col("b") == R.B)).select("metric", "entity", "rank_a", "key_b")
    return shaped(mv.sort_movement(wanted, "key_b", descending=True))


def movement_three_relations(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    rows = mv.three_year(ranked, [(R.A, R.M, R.B)], rows_bound=p.rows_bound, metrics=METRICS)
    return mv.relations(rows, R.FOCUSES, mv.SIDES_THREE, groups_bound=METRICS)


def movement_growth(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    out = growth.growth_movement(p.obs, GROWTH, rows_bound=p.entities_bound)
    return shaped(out)


def verify_two_year(spark, sf_dir):
    p, ranked, rows = _two(spark, sf_dir)
    report = verify.verify_two_year(rows, ranked, R.PAIRS, rows_bound=p.rows_bound, metrics=METRICS)
    return report.groupBy("check", "passed").agg(F.count(F.lit(1)).alias("requests"))


def verify_three_year(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    rows = mv.three_year(ranked, R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS)
    report = verify.verify_three_year(rows, ranked, R.TRIPLES, rows_bound=p.rows_bound, metrics=METRICS)
    return report.groupBy("check", "passed").agg(F.count(F.lit(1)).alias("requests"))


def verify_growth(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    rows = growth.growth_movement(p.obs, GROWTH, rows_bound=p.entities_bound)
    report = verify.verify_growth(rows, p.obs, GROWTH, rows_bound=p.entities_bound, metrics=METRICS)
    return report.groupBy("check", "passed").agg(F.count(F.lit(1)).alias("requests"))


def ranked_outside_universe(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    bad = verify.ranked_outside_universe(ranked, p.dim)
    return bad.agg(F.count(F.lit(1)).alias("rows"))


# The SQL ranks the common entities afresh and counts entered and exited rows by position.
_TWO = """
pairs AS (SELECT * FROM (VALUES {pairs}) t(a, b)),
sa AS (SELECT p.a, p.b, r.* FROM {src} r JOIN pairs p ON r.year = p.a),
sb AS (SELECT p.a, p.b, r.* FROM {src} r JOIN pairs p ON r.year = p.b),
both_sides AS (
  SELECT coalesce(x.metric, y.metric) AS metric, coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b,
    coalesce(x.entity, y.entity) AS entity, x.{key} AS key_a, y.{key} AS key_b, x.rank AS rank_a, y.rank AS rank_b,
    CASE WHEN x.entity IS NOT NULL AND y.entity IS NOT NULL THEN 'common'
         WHEN y.entity IS NULL THEN 'exited' ELSE 'entered' END AS status
  FROM sa x FULL JOIN sb y ON x.metric = y.metric AND x.a = y.a AND x.b = y.b AND x.entity = y.entity),
counted AS (
  SELECT *,
    count(rank_a) OVER g AS n_a, count(rank_b) OVER g AS n_b,
    count(*) FILTER (WHERE status = 'common') OVER g AS n_common,
    count(*) FILTER (WHERE status = 'exited') OVER g AS n_exited,
    count(*) FILTER (WHERE status = 'entered') OVER g AS n_entered,
    CASE WHEN status = 'common' THEN row_number() OVER (PARTITION BY metric, a, b, status ORDER BY key_a DESC, entity) END AS common_rank_a,
    CASE WHEN status = 'common' THEN row_number() OVER (PARTITION BY metric, a, b, status ORDER BY key_b DESC, entity) END AS common_rank_b,
    count(*) FILTER (WHERE status = 'exited') OVER (PARTITION BY metric, a, b ORDER BY rank_a NULLS LAST) AS ex,
    count(*) FILTER (WHERE status = 'entered') OVER (PARTITION BY metric, a, b ORDER BY rank_b NULLS LAST) AS en
  FROM both_sides WINDOW g AS (PARTITION BY metric, a, b)),
moved AS (
  SELECT metric, a, b, entity, status, key_a, key_b, rank_a, rank_b, n_a, n_b, n_common, n_exited, n_entered,
    common_rank_a, common_rank_b,
    CASE WHEN status = 'common' THEN ex END AS exited_above,
    CASE WHEN status = 'common' THEN n_exited - ex END AS exited_below,
    CASE WHEN status = 'common' THEN en END AS entered_above,
    CASE WHEN status = 'common' THEN n_entered - en END AS entered_below,
    rank_b - rank_a AS position_change, common_rank_b - common_rank_a AS common_effect,
    (rank_b - rank_a) - (common_rank_b - common_rank_a) AS set_effect, rank_a - rank_b AS places_gained,
    CASE status WHEN 'entered' THEN '{no_a}' WHEN 'exited' THEN '{no_b}' END AS reason
  FROM counted)"""
_TWO_LEVEL = _TWO.format(pairs=values_(R.PAIRS), src="ranked", key="value", no_a="focus_missing_in_yearA", no_b="focus_missing_in_yearB")
_TWO_YOY = _TWO.format(
    pairs=values_([p for p in R.PAIRS if p[0] > 1995]), src="yranked", key="yoy",
    no_a="no_valid_yoy_pair_in_period_A", no_b="no_valid_yoy_pair_in_period_B",
)
_MOVED = """
SELECT * REPLACE (round(key_a, 4) AS key_a, round(key_b, 4) AS key_b) FROM moved"""

_THREE = """
triples AS (SELECT * FROM (VALUES {triples}) t(a, m, b)),
wide AS (
  SELECT r.metric, t.a, t.m, t.b, r.entity,
    max(CASE WHEN r.year = t.a THEN value END) AS key_a, max(CASE WHEN r.year = t.m THEN value END) AS key_m,
    max(CASE WHEN r.year = t.b THEN value END) AS key_b,
    max(CASE WHEN r.year = t.a THEN rank END) AS rank_a, max(CASE WHEN r.year = t.m THEN rank END) AS rank_m,
    max(CASE WHEN r.year = t.b THEN rank END) AS rank_b
  FROM ranked r JOIN triples t ON r.year IN (t.a, t.m, t.b) GROUP BY ALL),
flagged AS (
  SELECT *, CASE WHEN rank_a IS NOT NULL AND rank_m IS NOT NULL AND rank_b IS NOT NULL THEN 'common' ELSE 'outside' END AS status
  FROM wide),
counted AS (
  SELECT *, count(rank_a) OVER g AS n_a, count(rank_m) OVER g AS n_m, count(rank_b) OVER g AS n_b,
    count(*) FILTER (WHERE status = 'common') OVER g AS n_common,
    count(*) FILTER (WHERE status = 'outside') OVER g AS n_outside,
    count(rank_a) FILTER (WHERE status = 'outside') OVER g AS n_outside_a,
    count(rank_m) FILTER (WHERE status = 'outside') OVER g AS n_outside_m,
    count(rank_b) FILTER (WHERE status = 'outside') OVER g AS n_outside_b,
    row_number() OVER (PARTITION BY metric, a, m, b, status ORDER BY key_a DESC, entity) AS ca,
    row_number() OVER (PARTITION BY metric, a, m, b, status ORDER BY key_m DESC, entity) AS cm,
    row_number() OVER (PARTITION BY metric, a, m, b, status ORDER BY key_b DESC, entity) AS cb,
    count(*) FILTER (WHERE status = 'outside' AND rank_a IS NOT NULL) OVER (PARTITION BY metric, a, m, b ORDER BY rank_a NULLS LAST) AS oa,
    count(*) FILTER (WHERE status = 'outside' AND rank_m IS NOT NULL) OVER (PARTITION BY metric, a, m, b ORDER BY rank_m NULLS LAST) AS om,
    count(*) FILTER (WHERE status = 'outside' AND rank_b IS NOT NULL) OVER (PARTITION BY metric, a, m, b ORDER BY rank_b NULLS LAST) AS ob
  FROM flagged WINDOW g AS (PARTITION BY metric, a, m, b)),
c AS (SELECT *, status = 'common' AS ok FROM counted)"""


def _three_sql(triples):
    parts = [
        "metric, a, m, b, entity, status, round(key_a, 4) AS key_a, round(key_m, 4) AS key_m, round(key_b, 4) AS key_b",
        "rank_a, rank_m, rank_b, n_a, n_m, n_b, n_common, n_outside, n_outside_a, n_outside_m, n_outside_b",
    ]
    for s in "amb":
        parts.append(f"CASE WHEN ok THEN c{s} END AS common_rank_{s}")
        parts.append(f"CASE WHEN ok THEN o{s} END AS outside_above_{s}")
        parts.append(f"CASE WHEN ok THEN n_outside_{s} - o{s} END AS outside_below_{s}")
    for seg, s, e in (("am", "a", "m"), ("mb", "m", "b"), ("ab", "a", "b")):
        parts.append(f"CASE WHEN ok THEN rank_{e} - rank_{s} END AS position_change_{seg}")
        parts.append(f"CASE WHEN ok THEN c{e} - c{s} END AS common_effect_{seg}")
        parts.append(f"CASE WHEN ok THEN (rank_{e} - rank_{s}) - (c{e} - c{s}) END AS set_effect_{seg}")
        parts.append(f"CASE WHEN ok THEN rank_{s} - rank_{e} END AS places_gained_{seg}")
    parts.append("""CASE WHEN ok THEN NULL
      WHEN (rank_a IS NULL)::INT + (rank_m IS NULL)::INT + (rank_b IS NULL)::INT > 1 THEN 'focus_missing_in_multiple_years'
      WHEN rank_a IS NULL THEN 'focus_missing_in_yearA' WHEN rank_m IS NULL THEN 'focus_missing_in_yearMid'
      ELSE 'focus_missing_in_yearB' END AS reason""")
    return with_(CUST, RANKED, _THREE.format(triples=values_(triples))) + "SELECT " + ",\n  ".join(parts) + " FROM c"


_FOCUS_LIST = ", ".join(f"'{f}'" for f in R.FOCUSES)


def _relation_sql(s):
    return f"""CASE WHEN x.rank_{s} IS NULL OR f.rank_{s} IS NULL THEN 'unknown' WHEN x.entity = f.entity THEN 'focus'
      WHEN x.rank_{s} < f.rank_{s} THEN 'above' ELSE 'below' END"""


_REL = f"""
rel AS (
  SELECT x.metric, x.a, x.b, f.entity AS focus, x.entity, x.status, x.rank_a, x.rank_b,
    {_relation_sql('a')} AS relation_a, {_relation_sql('b')} AS relation_b,
    coalesce(x.entity <> f.entity AND x.key_a = f.key_a, false) AS tied_a,
    coalesce(x.entity <> f.entity AND x.key_b = f.key_b, false) AS tied_b
  FROM moved x JOIN moved f ON f.metric = x.metric AND f.a = x.a AND f.b = x.b AND f.entity IN ({_FOCUS_LIST})),
rel2 AS (
  SELECT *, CASE WHEN status = 'exited' THEN relation_a ELSE relation_b END AS relation,
    CASE status WHEN 'exited' THEN relation_a = 'above' WHEN 'entered' THEN relation_b = 'above' ELSE false END AS affects_position,
    relation_a IN ('above', 'below') AND relation_b IN ('above', 'below') AND relation_a <> relation_b AS crossed
  FROM rel),
relations AS (
  SELECT *, CASE WHEN status = 'common' THEN 'not_applicable' WHEN affects_position THEN 'affects_position'
    ELSE 'denominator_only' END AS effect FROM rel2)"""
_REL_SQL = with_(CUST, RANKED, _TWO_LEVEL, _REL)

_FILTERS = {
    "above_a": "relation_a = 'above'",
    "below_b": "relation_b = 'below'",
    "above_all": "relation_a = 'above' AND relation_b = 'above'",
    "below_all": "relation_a = 'below' AND relation_b = 'below'",
    "crossed": "crossed",
    "affects": "affects_position",
}
_OUTSIDE_FILTERS = {
    f"outside_{kind}_{s}": f"status = 'outside' AND relation_{s} = '{kind}'" for s in "amb" for kind in ("above", "below")
} | {"outside_affects": "status = 'outside' AND affects_position"}
# What each tampered column must trip, over the focus's common requests.
_TAMPERED = [
    ("common_rank", "common-A.ranking_matches_engine_order"), ("common_rank", "decomposition.identity"),
    ("common_rank", "classification.position_based"), ("set_effect", "decomposition.identity"),
    ("set_effect", "decomposition.observed_set_effect_matches_counts"),
    ("entered_above", "entered.above_below_reconciles"), ("entered_above", "partial_identity_B"),
    ("entered_above", "decomposition.identity"), ("entered_above", "decomposition.observed_set_effect_matches_counts"),
]


_THREE_TAMPERED = [
    ("common_rank", "common-MID.ranking_matches_engine_order", "true"), ("common_rank", "ranks.within_bounds", "common_rank_m = n_common"),
    ("outside_above", "outside.above_below_reconciles_B", "true"), ("outside_above", "partial_identity_B", "true"),
    ("outside_above", "decomposition.identity_MB", "true"), ("outside_above", "decomposition.identity_AB", "true"),
    ("set_effect", "decomposition.identity_AM", "true"), ("set_effect", "decomposition.segments_add_up", "true"),
]
_GROWTH_TAMPERED = [
    ("common_rank", "common.ranking_matches_engine_order", "true"), ("common_rank", "partial_identity", "true"),
    ("common_rank", "ranks_within_bounds", "common_rank = n_common"),
    ("peer_mean", "peer_mean_recomputed", "peer_mean IS NOT NULL"), ("peer_mean", "difference_is_plain_subtraction", "peer_mean IS NOT NULL"),
    ("outside_above", "partial_identity", "true"), ("outside_above", "outside_counts_reconcile", "true"),
]


def _refused_sql(rows, cases):
    """How many requests of the focus meet each case's condition."""
    parts = [f"SELECT '{c}' AS \"case\", '{k}' AS \"check\" FROM mine WHERE {cond}" for c, k, cond in cases]
    return f"""WITH mine AS (SELECT * FROM ({rows}) x WHERE entity = '{R.FOCUS}' AND status = 'common')
SELECT "case", "check", count(*) AS requests FROM ({" UNION ALL ".join(parts)}) y GROUP BY 1, 2"""


def _growth_spans():
    out = []
    for a, m, b in GROWTH:
        spans = [("AB", a, b)] if m is None else [("AM", a, m), ("MB", m, b), ("AB", a, b)]
        out += [(a, m or -1, b, name, s, e) for name, s, e in spans]
    return out


_GROWTH_SQL = with_(CUST, f"""
spans AS (SELECT a, CASE WHEN m > 0 THEN m END AS m, b, m AS mk, iv AS interval, s AS start, e AS "end"
  FROM (VALUES {values_(_growth_spans())}) t(a, m, b, iv, s, e)),
seen AS (SELECT DISTINCT c.metric, c.entity, s.a, s.mk, s.b FROM cust c
  JOIN (SELECT DISTINCT a, mk, b FROM spans) s ON c.year IN (s.a, s.mk, s.b)),
pair AS (
  SELECT z.metric, z.entity, s.*, x.value AS start_value, y.value AS end_value,
    CASE WHEN x.value > 0 AND y.value >= 0 THEN (y.value / x.value - 1) * 100 END AS growth,
    CASE WHEN x.value IS NULL AND y.value IS NULL THEN 'both_years_missing'
      WHEN x.value IS NULL THEN 'previous_year_value_missing' WHEN y.value IS NULL THEN 'current_year_value_missing'
      WHEN x.value = 0 AND y.value = 0 THEN 'both_years_zero' WHEN x.value <= 0 THEN 'previous_year_value_not_positive'
      WHEN y.value < 0 THEN 'sign_change_across_endpoints' END AS growth_reason
  FROM seen z JOIN spans s ON s.a = z.a AND s.mk = z.mk AND s.b = z.b
  LEFT JOIN cust x ON x.metric = z.metric AND x.entity = z.entity AND x.year = s.start
  LEFT JOIN cust y ON y.metric = z.metric AND y.entity = z.entity AND y.year = s."end"),
flag AS (SELECT *, growth IS NOT NULL AS valid,
    bool_and(growth IS NOT NULL) OVER (PARTITION BY metric, entity, a, mk, b) AS common FROM pair),
rk AS (
  SELECT *,
    CASE WHEN valid THEN row_number() OVER (PARTITION BY metric, a, mk, b, interval, valid ORDER BY growth DESC, entity) END AS full_rank,
    CASE WHEN common THEN row_number() OVER (PARTITION BY metric, a, mk, b, interval, common ORDER BY growth DESC, entity) END AS common_rank,
    count(*) FILTER (WHERE valid) OVER g AS n_observed, count(*) FILTER (WHERE common) OVER g AS n_common,
    sum(CAST(growth AS DECIMAL(38,10))) OVER g AS total,
    sum(CASE WHEN common THEN CAST(growth AS DECIMAL(38,10)) END) OVER g AS total_common,
    count(*) FILTER (WHERE valid AND NOT common) OVER (PARTITION BY metric, a, mk, b, interval, valid ORDER BY growth DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM flag WINDOW g AS (PARTITION BY metric, a, mk, b, interval)),
pm AS (
  SELECT *, n_observed - valid::INT AS peer_count, n_common - common::INT AS peer_count_common,
    CASE WHEN n_observed - valid::INT > 0 THEN (CAST(total AS DOUBLE) - coalesce(growth, 0)) / (n_observed - valid::INT) END AS peer_mean,
    CASE WHEN n_common - common::INT > 0 THEN (CAST(total_common AS DOUBLE) - CASE WHEN common THEN growth ELSE 0 END) / (n_common - common::INT) END AS peer_mean_common
  FROM rk)""") + """
SELECT metric, a, m, b, interval, start, "end", entity, CASE WHEN common THEN 'common' ELSE 'outside' END AS status,
  round(start_value, 4) AS start_value, round(end_value, 4) AS end_value, round(growth, 4) + 0.0 AS growth, growth_reason,
  round(CASE WHEN valid THEN (end_value - start_value) END, 4) + 0.0 AS absolute_change, full_rank, common_rank, n_observed, n_common,
  CASE WHEN valid THEN above END AS outside_above, CASE WHEN valid THEN n_observed - n_common - above END AS outside_below,
  round(peer_mean, 4) AS peer_mean, peer_count,
  CASE WHEN peer_count = 0 THEN 'no_peer_economies_after_excluding_focus' END AS peer_reason,
  round(peer_mean_common, 4) AS peer_mean_common, peer_count_common,
  CASE WHEN peer_count_common = 0 THEN 'no_peer_economies_after_excluding_focus' END AS peer_reason_common,
  round((growth - peer_mean), 4) AS vs_peer,
  CASE WHEN growth - peer_mean IS NULL THEN CASE WHEN peer_mean IS NULL THEN 'peer_average_unavailable'
    ELSE 'no_calculable_growth_for_focus_in_interval' END END AS vs_peer_reason,
  round(CASE WHEN common THEN (growth - peer_mean_common) END, 4) AS vs_peer_common,
  CASE WHEN NOT common OR peer_mean_common IS NULL THEN CASE WHEN valid OR peer_mean_common IS NULL THEN 'peer_average_unavailable'
    ELSE 'no_calculable_growth_for_focus_in_interval' END END AS vs_peer_common_reason,
  CASE WHEN NOT valid THEN 'no_calculable_growth_for_focus_in_interval' END AS reason
FROM pm"""

# Names of the checks.
_TWO_CHECKS = (
    "A.set_partition", "B.set_partition", "A.ranking_matches_engine_order", "B.ranking_matches_engine_order",
    "common-A.ranking_matches_engine_order", "common-B.ranking_matches_engine_order",
    "common.is_exact_intersection", "exited.is_exact_difference", "entered.is_exact_difference", "members.disjoint",
    "members.unique_and_partitioned", "members.missing_has_reason", "exited.above_below_reconciles",
    "entered.above_below_reconciles", "partial_identity_A", "partial_identity_B", "decomposition.identity",
    "decomposition.observed_set_effect_matches_counts", "classification.position_based", "ranks.within_bounds",
    "outputs.integers_only",
)
_THREE_CHECKS = [
    f"{stem}{name}{tail}"
    for stem, tail in (("", ".set_partition"), ("", ".ranking_matches_engine_order"), ("common-", ".ranking_matches_engine_order"),
                       ("outsideIn", ".is_exact_difference"), ("outside.above_below_reconciles_", ""), ("partial_identity_", ""))
    for name in ("A", "MID", "B")
] + ["decomposition.identity_AM", "decomposition.identity_MB", "decomposition.identity_AB"] + list((
    "members.unique_and_partitioned", "ranks.within_bounds", "common.is_exact_intersection",
    "outside.is_union_minus_common", "common.universe_consistent_across_years", "decomposition.segments_add_up",
    "outputs.integers_only",
))
_GROWTH_CHECKS = (
    "set_partition", "outside_matches_members", "common_subset_of_observed",
    "observed.ranking_matches_engine_order", "common.ranking_matches_engine_order",
    "denominators_equal_population_sizes", "partial_identity", "outside_counts_reconcile", "peer_mean_recomputed",
    "peer_mean_common_recomputed", "difference_is_plain_subtraction", "null_coherence", "ranks_within_bounds",
    "ranked_rows_hold_finite_growth", "common.members_valid_in_every_interval",
)


def _all_pass(checks, requests, per_request):
    """Every check holds for every metric and request that has data."""
    groups = " UNION ALL ".join(
        f"SELECT DISTINCT metric, {n} AS request FROM cust WHERE year IN ({', '.join(str(y) for y in years if y)})"
        for n, years in enumerate(requests)
    )
    weights = values_([(n, per_request(years)) for n, years in enumerate(requests)])
    return with_(CUST, f"grp AS ({groups})") + f"""
SELECT "check", true AS passed, (SELECT CAST(sum(w) AS BIGINT) FROM grp JOIN (VALUES {weights}) k(request, w) ON k.request = grp.request) AS requests
FROM (VALUES {values_([(c,) for c in checks])}) t("check")"""


def _three_relation_sql():
    sides = "amb"
    rel = ", ".join(
        f"""CASE WHEN x.rank_{s} IS NULL OR f.rank_{s} IS NULL THEN 'unknown' WHEN x.entity = f.entity THEN 'focus'
      WHEN x.rank_{s} < f.rank_{s} THEN 'above' ELSE 'below' END AS relation_{s},
      coalesce(x.entity <> f.entity AND x.key_{s} = f.key_{s}, false) AS tied_{s}""" for s in sides
    )
    return with_(CUST, RANKED, _THREE.format(triples=values_([(R.A, R.M, R.B)])), f"""
rel AS (SELECT x.metric, x.a, x.m, x.b, f.entity AS focus, x.entity, x.status, x.rank_a, x.rank_m, x.rank_b, {rel}
  FROM c x JOIN c f ON f.metric = x.metric AND f.entity IN ({_FOCUS_LIST})),
rel2 AS (SELECT *, CASE WHEN rank_b IS NOT NULL THEN relation_b WHEN rank_m IS NOT NULL THEN relation_m ELSE relation_a END AS relation,
    status = 'outside' AND 'above' IN (relation_a, relation_m, relation_b) AS affects_position,
    'above' IN (relation_a, relation_m, relation_b) AND 'below' IN (relation_a, relation_m, relation_b) AS crossed FROM rel)""") + """
SELECT *, CASE WHEN status = 'common' THEN 'not_applicable' WHEN affects_position THEN 'affects_position' ELSE 'denominator_only' END AS effect FROM rel2"""


QUERIES = {
    "movement_two_year": (movement_two_year, with_(CUST, RANKED, _TWO_LEVEL) + _MOVED),
    "movement_yoy": (movement_yoy, with_(CUST, YOY.format(panel="cust"), YOY_RANKED, _TWO_YOY) + _MOVED),
    "movement_three_year": (movement_three_year, _three_sql(R.TRIPLES)),
    "movement_relations": (movement_relations, _REL_SQL + "SELECT * FROM relations"),
    "movement_relation_filters": (movement_relation_filters, _REL_SQL + " UNION ALL ".join(
        f"SELECT '{n}' AS filter, metric, a, b, focus, entity, status FROM relations WHERE a = {R.A} AND b = {R.B} AND {c}"
        for n, c in _FILTERS.items())),
    "movement_outside_filters": (movement_outside_filters, "WITH three AS (" + _three_relation_sql() + ") " + " UNION ALL ".join(
        f"SELECT '{n}' AS filter, metric, a, m, b, focus, entity FROM three WHERE {c}" for n, c in _OUTSIDE_FILTERS.items())),
    "movement_status_positions": (movement_status_positions, with_(CUST, RANKED, _TWO_LEVEL) + """
SELECT metric, a, b, status, entity, row_number() OVER (PARTITION BY metric, a, b, status ORDER BY entity) AS position_in_status,
  row_number() OVER (PARTITION BY metric, a, b, status ORDER BY coalesce(rank_b, rank_a), entity) AS position_by_rank,
  count(*) OVER (PARTITION BY metric, a, b, status) AS n_status FROM moved"""),
    "movement_verified": (movement_verified, with_(CUST, RANKED, _TWO_LEVEL) + _MOVED),
    "verify_tampered": (verify_tampered, with_(CUST, RANKED, _TWO_LEVEL) + f"""
SELECT "case", "check", count(*) AS requests FROM moved, (VALUES {values_(_TAMPERED)}) t("case", "check")
WHERE entity = '{R.FOCUS}' AND status = 'common' GROUP BY 1, 2"""),
    "movement_three_year_verified": (movement_three_year_verified, _three_sql(R.TRIPLES)),
    "movement_growth_verified": (movement_growth_verified, _GROWTH_SQL),
    "verify_three_tampered": (verify_three_tampered, _refused_sql(_three_sql(R.TRIPLES), _THREE_TAMPERED)),
    "verify_growth_tampered": (verify_growth_tampered, _refused_sql(_GROWTH_SQL, _GROWTH_TAMPERED)),
    "movement_summary": (movement_summary, _REL_SQL + "SELECT * FROM relations WHERE status <> 'common' OR entity = focus"),
    "movement_relation_counts": (movement_relation_counts, _REL_SQL + """
SELECT metric, a, b, focus, count(*) FILTER (WHERE status = 'common') AS common,
  count(*) FILTER (WHERE effect = 'affects_position') AS affecting,
  count(*) FILTER (WHERE effect = 'denominator_only') AS denominator_only, count(*) FILTER (WHERE crossed) AS crossed,
  count(*) FILTER (WHERE relation_a = 'above') AS above_a, count(*) FILTER (WHERE relation_b = 'above') AS above_b,
  count(*) FILTER (WHERE tied_a) AS tied_a, count(*) FILTER (WHERE tied_b) AS tied_b
FROM relations GROUP BY metric, a, b, focus"""),
    "movement_sorted": (movement_sorted, with_(CUST, RANKED, _TWO_LEVEL) + f"""
SELECT metric, entity, rank_a, round(key_b, 4) AS key_b FROM moved WHERE a = {R.A} AND b = {R.B}
ORDER BY key_b DESC NULLS LAST, entity"""),
    "movement_three_relations": (movement_three_relations, _three_relation_sql()),
    "movement_growth": (movement_growth, _GROWTH_SQL),
    "verify_two_year": (verify_two_year, _all_pass(_TWO_CHECKS, R.PAIRS, lambda years: 1)),
    "verify_three_year": (verify_three_year, _all_pass(_THREE_CHECKS, R.TRIPLES, lambda years: 1)),
    "verify_growth": (verify_growth, _all_pass(_GROWTH_CHECKS, GROWTH, lambda years: 1 if years[1] is None else 3)),
    "ranked_outside_universe": (ranked_outside_universe, "SELECT 0::BIGINT AS rows"),
}
