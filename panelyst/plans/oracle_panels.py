"""Panels and shared steps in plain SQL, written apart from the Spark code."""

CUST = """
cust_wide AS (
  SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS entity, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS order_value,
         CAST(count(*) AS DOUBLE) AS order_count
  FROM orders GROUP BY 1, 2),
cust AS (
  SELECT entity, 'total_current' AS metric, year, order_value AS value FROM cust_wide
  UNION ALL SELECT entity, 'population_total', year, order_count FROM cust_wide)"""

CUST_DIM = """
cust_dim AS (
  SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS entity, c_name AS name, r_name AS region,
         c_mktsegment AS income_level, n_name AS lending_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_SUMS = """
  SELECT {key} AS entity, CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(sum(cents) AS DOUBLE) AS gross,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN -cents ELSE cents END) AS DOUBLE) AS net,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN cents END) AS DOUBLE) AS accepted,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN cents END) AS DOUBLE) AS kept,
    CAST(sum(cents * disc) AS DOUBLE) AS disc, CAST(sum(cents * tax) AS DOUBLE) AS tax,
    CAST(sum(qty) AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS lines
  FROM (SELECT l.*, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
          CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
          CAST(l_quantity AS BIGINT) AS qty FROM lineitem l) q {join}
  GROUP BY 1, 2"""

_FORMULAS = {
    "total_current": "gross / 100",
    "exports_current": "accepted / 100",
    "imports_current": "kept / 100",
    "fdi_inflows": "net / 100",
    "fdi_inflows_pct_gdp": "net / gross * 100",
    "current_account": "(coalesce(accepted, 0) - coalesce(kept, 0)) / 100",
    "reserves_ex_gold": "tax / 10000",
    "remittances_received": "disc / 10000",
    "population_total": "quantity",
    "fx_official": "gross / 100 / quantity",
    "inflation_cpi_index": "gross / 1000 / quantity",
    "inflation_cpi": "(tax - disc) / gross",
    "inflation_deflator": "disc / gross",
    "nominal_current": "gross / 100 / lines",
}
_ADDITIVE = (
    "total_current", "exports_current", "imports_current", "fdi_inflows", "current_account",
    "reserves_ex_gold", "remittances_received", "population_total",
)


def _stack(source, metrics):
    parts = [
        f"SELECT entity, '{m}' AS metric, year, {_FORMULAS[m]} AS value FROM {source} WHERE ({_FORMULAS[m]}) IS NOT NULL"
        for m in metrics
    ]
    return "\n  UNION ALL ".join(parts)


PART_KEY = "'P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')"
BRAND = "upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))"
PART = (
    "part_wide AS (" + _SUMS.format(key=PART_KEY, join="") + "),\npart_obs AS (" + _stack("part_wide", _FORMULAS) + ")"
)
BRAND_OBS = (
    "brand_wide AS (" + _SUMS.format(key=BRAND, join="JOIN part ON p_partkey = l_partkey")
    + "),\nbrand_obs AS (" + _stack("brand_wide", _ADDITIVE) + ")"
)
PART_DIM = f"""
part_dim AS (
  SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS entity, p_name AS name, p_type AS region,
         p_brand AS income_level, 'size_' || CAST(p_size AS VARCHAR) AS lending_type, false AS is_aggregate
  FROM part
  UNION ALL SELECT DISTINCT {BRAND}, p_brand, 'Aggregates', NULL, NULL, true FROM part)"""
STORE = PART + ",\n" + BRAND_OBS + """,
store AS (
  SELECT entity, metric, year, value, CAST(CAST(value AS DECIMAL(28,4)) AS VARCHAR) AS value_raw,
    CASE WHEN TRY_CAST(right(entity, 1) AS INTEGER) % 5 = 0 THEN '2024-07-01' ELSE '2024-01-01' END AS vintage
  FROM (SELECT * FROM part_obs UNION ALL SELECT * FROM brand_obs) s)"""
USERS = """
users AS (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS entity, 'remittances_received' AS metric,
         CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS year,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
  FROM events GROUP BY 1, 3)"""

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric, year ORDER BY value DESC, entity) AS rank,
         count(*) OVER (PARTITION BY metric, year) AS n
  FROM cust)"""

YOY = """
yoy AS (
  SELECT c.entity, c.metric, c.year, c.value, p.value AS previous,
    CASE WHEN p.value > 0 AND c.value >= 0 THEN (c.value / p.value - 1) * 100 END AS yoy,
    CASE WHEN p.value IS NULL THEN 'previous_year_value_missing'
         WHEN p.value = 0 AND c.value = 0 THEN 'both_years_zero'
         WHEN p.value <= 0 THEN 'previous_year_value_not_positive'
         WHEN c.value < 0 THEN 'sign_change_across_endpoints' END AS reason
  FROM {panel} c LEFT JOIN {panel} p ON p.entity = c.entity AND p.metric = c.metric AND p.year = c.year - 1)"""
YOY_RANKED = """
yranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric, year ORDER BY yoy DESC, entity) AS rank,
         count(*) OVER (PARTITION BY metric, year) AS n
  FROM yoy WHERE reason IS NULL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def values_(rows) -> str:
    """A literal table body."""
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
