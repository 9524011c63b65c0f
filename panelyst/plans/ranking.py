"""Registered ranking and growth queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import rank, yoy
from panelyst.operators.ordered import rank_rows
from panelyst.plans import requests as R
from panelyst.plans.oracle_panels import CUST, CUST_DIM, PART, RANKED, YOY, YOY_RANKED, with_
from panelyst.plans.shape import shaped
from panelyst.sources.tables import customer_panel, part_panel

CUST_SQL = with_(CUST, RANKED)
YOY_SQL = with_(CUST, YOY.format(panel="cust"), YOY_RANKED)


def _ranked(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return p, rank.level_rank(p.obs, p.rows_bound)


def rank_level(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir)
    return shaped(ranked, "entity", "metric", "year", "value", "rank", "n")


def rank_directions(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    return shaped(rank.level_rank(p.obs, p.rows_bound), "entity", "metric", "year", "value", "rank", "n")


def rank_refused(spark, sf_dir):
    return rank.refused_metrics(part_panel(spark, sf_dir).obs)


def rank_competition(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    both = rank_rows(p.obs, rank.GROUP, "value", competition="rank_desc", rows_bound=p.rows_bound)
    both = rank_rows(both.drop("rank", "n"), rank.GROUP, "value", direction="ASC", competition="rank_asc",
                     rows_bound=p.rows_bound)
    return shaped(both, "entity", "metric", "year", "value", "rank_desc", "rank_asc", "n")


def rank_locate(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return shaped(rank.locate(p.obs, [R.FOCUS], p.rows_bound), "entity", "metric", "year", "value", "rank", "n")


def rank_neighbours(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    near = rank.verification_window(ranked, R.FOCUS, 3, p.rows_bound)
    return shaped(near, "entity", "metric", "year", "value", "rank", "n", "focus_rank", "rows_above",
                  "rows_below", "position")


def rank_change(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir)
    return shaped(rank.rank_change(ranked), "entity", "metric", "year", "rank", "previous_rank", "delta", "text")


def rank_page(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir)
    return shaped(rank.page(ranked, 2, 25), "entity", "metric", "year", "value", "rank", "n", "page", "pages")


def rank_page_clamped(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir)
    return shaped(rank.page(ranked, 10**6, 500), "entity", "metric", "year", "rank", "page", "pages")


def rank_search(spark, sf_dir):
    p, ranked = _ranked(spark, sf_dir)
    named = ranked.join(p.dim.select("entity", "name"), "entity")
    text = rank.search(named, F.lit("R#00000001")).withColumn("query", F.lit("text"))
    number = rank.search(named, F.lit(" #12 ")).withColumn("query", F.lit("#12"))
    return shaped(text.unionByName(number), "query", "entity", "name", "metric", "year", "rank", "n")


def full_ranking(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    out = rank.full_ranking(p.obs, p.dim, number=1, size=10, focus=R.FOCUS, rows_bound=p.rows_bound)
    return shaped(out, "entity", "name", "metric", "year", "value", "rank", "n", "is_focus")


def denominators(spark, sf_dir):
    return rank.denominators(customer_panel(spark, sf_dir).obs)


def yoy_rows(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return shaped(yoy.yoy_rows(p.obs), "entity", "metric", "year", "value", "previous", "yoy", "reason")


def yoy_signed(spark, sf_dir):
    p = part_panel(spark, sf_dir, ("fdi_inflows", "current_account"))
    return shaped(yoy.yoy_rows(p.obs), "entity", "metric", "year", "value", "previous", "yoy", "reason")


def _yoy_ranked(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return p, yoy.yoy_rank(p.obs, p.rows_bound)


def yoy_rank(spark, sf_dir):
    _, ranked = _yoy_ranked(spark, sf_dir)
    return shaped(ranked, "entity", "metric", "year", "value", "previous", "yoy", "rank", "n")


def yoy_full_ranking(spark, sf_dir):
    p, ranked = _yoy_ranked(spark, sf_dir)
    named = rank.page(ranked, 1, 20).join(p.dim.select("entity", "name"), "entity")
    return shaped(named, "entity", "name", "metric", "year", "yoy", "rank", "n", "pages")


def yoy_neighbours(spark, sf_dir):
    p, ranked = _yoy_ranked(spark, sf_dir)
    return shaped(rank.verification_window(ranked, R.FOCUS, 2, p.rows_bound), "entity", "metric", "year", "yoy", "rank",
                  "n", "focus_rank", "rows_above", "rows_below", "position")


def yoy_series(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return shaped(yoy.yoy_series(p.obs, 1996, 2001))


def yoy_coverage(spark, sf_dir):
    return yoy.yoy_coverage(customer_panel(spark, sf_dir).obs)


def focus_yearly(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    places = rank.locate(p.obs, [R.FOCUS_PART], p.rows_bound)
    return shaped(yoy.focus_yearly(p.obs, places, R.FOCUS_PART, 1995, 2002))


_DIRECTED = with_(PART, """
directed AS (
  SELECT *, row_number() OVER (PARTITION BY metric, year ORDER BY
      CASE WHEN metric IN ('inflation_cpi', 'inflation_deflator') THEN -value ELSE value END DESC, entity) AS rank,
    count(*) OVER (PARTITION BY metric, year) AS n
  FROM part_obs WHERE metric NOT IN ('inflation_cpi_index', 'fx_official'))""")

_WINDOW_SQL = """
SELECT r.entity, r.metric, r.year, {value}, r.rank, r.n, f.rank AS focus_rank, r.rank - 1 AS rows_above,
  r.n - r.rank AS rows_below,
  round(CASE WHEN r.n > 1 THEN (r.rank - 1) / (r.n - 1) END, 4) AS position
FROM {src} r JOIN {src} f ON f.metric = r.metric AND f.year = r.year AND f.entity = '{focus}'
WHERE abs(r.rank - f.rank) <= {near}"""

QUERIES = {
    "rank_level": (rank_level, CUST_SQL + "SELECT entity, metric, year, round(value, 4) AS value, rank, n FROM ranked"),
    "rank_directions": (rank_directions, _DIRECTED + "SELECT entity, metric, year, round(value, 4) AS value, rank, n FROM directed"),
    "rank_refused": (rank_refused, with_(PART) + """
SELECT metric, year, count(*) AS rows, 'RANK_UNSUPPORTED' AS reason FROM part_obs
WHERE metric IN ('inflation_cpi_index', 'fx_official') GROUP BY metric, year"""),
    "rank_competition": (rank_competition, with_(CUST) + """
SELECT entity, metric, year, round(value, 4) AS value,
  rank() OVER (PARTITION BY metric, year ORDER BY value DESC) AS rank_desc,
  rank() OVER (PARTITION BY metric, year ORDER BY value) AS rank_asc,
  count(*) OVER (PARTITION BY metric, year) AS n FROM cust"""),
    "rank_locate": (rank_locate, CUST_SQL + f"""
SELECT entity, metric, year, round(value, 4) AS value, rank, n FROM ranked WHERE entity = '{R.FOCUS}'"""),
    "rank_neighbours": (rank_neighbours, CUST_SQL + _WINDOW_SQL.format(
        value="round(r.value, 4) AS value", src="ranked", focus=R.FOCUS, near=3)),
    "rank_change": (rank_change, CUST_SQL + """
SELECT c.entity, c.metric, c.year, c.rank, p.rank AS previous_rank, c.rank - p.rank AS delta,
  CASE WHEN p.rank IS NOT NULL THEN 'rank ' || CAST(c.rank AS VARCHAR) || ', before ' || CAST(p.rank AS VARCHAR)
    || ' (' || CASE WHEN c.rank >= p.rank THEN '+' ELSE '' END || CAST(c.rank - p.rank AS VARCHAR) || ')' END AS text
FROM ranked c LEFT JOIN ranked p ON p.entity = c.entity AND p.metric = c.metric AND p.year = c.year - 1"""),
    "rank_page": (rank_page, CUST_SQL + """, paged AS (
  SELECT *, greatest(1, CAST(ceil(n / 25) AS BIGINT)) AS pages FROM ranked)
SELECT entity, metric, year, round(value, 4) AS value, rank, n, least(2, pages) AS page, pages FROM paged
WHERE rank BETWEEN (least(2, pages) - 1) * 25 + 1 AND least(2, pages) * 25"""),
    "rank_page_clamped": (rank_page_clamped, CUST_SQL + """, paged AS (
  SELECT *, greatest(1, CAST(ceil(n / 500) AS BIGINT)) AS pages FROM ranked)
SELECT entity, metric, year, rank, pages AS page, pages FROM paged WHERE rank > (pages - 1) * 500"""),
    "rank_search": (rank_search, with_(CUST, CUST_DIM, RANKED, """
named AS (SELECT r.*, d.name FROM ranked r JOIN cust_dim d ON d.entity = r.entity)""") + """
SELECT 'text' AS query, entity, name, metric, year, rank, n FROM named
WHERE lower(entity) LIKE '%r#00000001%' OR lower(name) LIKE '%r#00000001%'
UNION ALL SELECT '#12', entity, name, metric, year, rank, n FROM named WHERE rank = 12"""),
    "full_ranking": (full_ranking, with_(CUST, CUST_DIM, RANKED) + f"""
SELECT r.entity, name, metric, year, round(value, 4) AS value, rank, n, r.entity = '{R.FOCUS}' AS is_focus
FROM ranked r JOIN cust_dim d ON d.entity = r.entity WHERE rank <= 10 OR r.entity = '{R.FOCUS}'"""),
    "denominators": (denominators, with_(CUST) + "SELECT metric, year, count(*) AS n FROM cust GROUP BY metric, year"),
    "yoy_rows": (yoy_rows, YOY_SQL + """
SELECT entity, metric, year, round(value, 4) AS value, round(previous, 4) AS previous, round(yoy, 4) AS yoy, reason FROM yoy"""),
    "yoy_signed": (yoy_signed, with_(PART, YOY.format(panel="part_obs")) + """
SELECT entity, metric, year, round(value, 4) AS value, round(previous, 4) AS previous, round(yoy, 4) + 0.0 AS yoy, reason
FROM yoy WHERE metric IN ('fdi_inflows', 'current_account')"""),
    "yoy_rank": (yoy_rank, YOY_SQL + """
SELECT entity, metric, year, round(value, 4) AS value, round(previous, 4) AS previous, round(yoy, 4) AS yoy, rank, n FROM yranked"""),
    "yoy_full_ranking": (yoy_full_ranking, with_(CUST, CUST_DIM, YOY.format(panel="cust"), YOY_RANKED) + """
SELECT y.entity, name, metric, year, round(yoy, 4) AS yoy, rank, n, greatest(1, CAST(ceil(n / 20) AS BIGINT)) AS pages
FROM yranked y JOIN cust_dim d ON d.entity = y.entity WHERE rank <= 20"""),
    "yoy_neighbours": (yoy_neighbours, YOY_SQL + _WINDOW_SQL.format(
        value="round(r.yoy, 4) AS yoy", src="yranked", focus=R.FOCUS, near=2)),
    "yoy_series": (yoy_series, with_(CUST, """
series AS (SELECT DISTINCT entity, metric FROM cust),
cells AS (
  SELECT s.entity, s.metric, CAST(y.year AS INTEGER) AS year, c.value, p.value AS previous
  FROM series s CROSS JOIN (SELECT unnest(range(1996, 2002)) AS year) y
  LEFT JOIN cust c ON c.entity = s.entity AND c.metric = s.metric AND c.year = y.year
  LEFT JOIN cust p ON p.entity = s.entity AND p.metric = s.metric AND p.year = y.year - 1)""") + """
SELECT entity, metric, year, round(value, 4) AS value, round(previous, 4) AS previous,
  round(CASE WHEN previous > 0 AND value >= 0 THEN (value / previous - 1) * 100 END, 4) AS yoy,
  CASE WHEN value IS NULL AND previous IS NULL THEN 'both_years_missing'
       WHEN previous IS NULL THEN 'previous_year_value_missing'
       WHEN value IS NULL THEN 'current_year_value_missing'
       WHEN previous = 0 AND value = 0 THEN 'both_years_zero'
       WHEN previous <= 0 THEN 'previous_year_value_not_positive'
       WHEN value < 0 THEN 'sign_change_across_endpoints' END AS reason
FROM cells"""),
    "yoy_coverage": (yoy_coverage, YOY_SQL + """, per AS (
  SELECT metric, year, count(*) AS current_valid, count(*) FILTER (WHERE reason IS NULL) AS valid_pairs,
    count(previous) AS with_previous FROM yoy GROUP BY metric, year)
SELECT a.*, coalesce(b.current_valid, 0) AS previous_valid
FROM per a LEFT JOIN per b ON b.metric = a.metric AND b.year = a.year - 1"""),
    "focus_yearly": (focus_yearly, _DIRECTED + f""", grid AS (
  SELECT metric, CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT metric FROM part_obs) m
  CROSS JOIN (SELECT unnest(range(1995, 2003)) AS year) y),
tot AS (SELECT metric, year, count(*) AS n FROM part_obs GROUP BY metric, year),
cell AS (
  SELECT g.metric, g.year, c.value, p.value AS previous, d.rank, coalesce(t.n, 0) AS n,
    g.metric IN ('inflation_cpi_index', 'fx_official') AS unranked,
    g.metric IN ('inflation_cpi', 'inflation_cpi_index', 'inflation_deflator', 'fdi_inflows_pct_gdp') AS no_yoy
  FROM grid g
  LEFT JOIN part_obs c ON c.entity = '{R.FOCUS_PART}' AND c.metric = g.metric AND c.year = g.year
  LEFT JOIN part_obs p ON p.entity = '{R.FOCUS_PART}' AND p.metric = g.metric AND p.year = g.year - 1
  LEFT JOIN directed d ON d.entity = '{R.FOCUS_PART}' AND d.metric = g.metric AND d.year = g.year
  LEFT JOIN tot t ON t.metric = g.metric AND t.year = g.year)
SELECT metric, year, round(value, 4) AS value,
  CASE WHEN value IS NULL THEN 'no_valid_observation_for_focus_in_this_metric_year' END AS reason, rank,
  CASE WHEN unranked THEN 'RANK_UNSUPPORTED' END AS rank_reason, n, CAST(NULL AS BIGINT) AS missing,
  round(previous, 4) AS previous,
  round(CASE WHEN NOT no_yoy AND previous > 0 AND value >= 0 THEN (value / previous - 1) * 100 END, 4) AS yoy,
  CASE WHEN no_yoy THEN 'unsupported_transformation_for_metric'
       WHEN value IS NULL AND previous IS NULL THEN 'both_years_missing'
       WHEN previous IS NULL THEN 'previous_year_value_missing'
       WHEN value IS NULL THEN 'current_year_value_missing'
       WHEN previous = 0 AND value = 0 THEN 'both_years_zero'
       WHEN previous <= 0 THEN 'previous_year_value_not_positive'
       WHEN value < 0 THEN 'sign_change_across_endpoints' END AS yoy_reason
FROM cell"""),
}
