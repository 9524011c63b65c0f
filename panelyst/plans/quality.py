"""Registered scan, ingest, coverage and integrity queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import classify, coverage, integrity, rank
from panelyst.plans import requests as R
from panelyst.plans.oracle_panels import CUST, CUST_DIM, PART, PART_DIM, RANKED, STORE, YOY, YOY_RANKED, values_, with_
from panelyst.plans.shape import shaped
from panelyst.registry import METRICS
from panelyst.session import table_folder, written
from panelyst.sources import payloads, publish, scans
from panelyst.sources.tables import code, customer_panel, part_dim, part_panel, published, stored, user_day_panel
from panelyst.streaming import waiting

A, M, B = R.A, R.M, R.B
RAW_METRICS = ("total_current", "exports_current")
STORE_COLUMNS = ("entity", "metric", "year", "value", "value_raw", "vintage")


def _store(spark, sf_dir, metrics=RAW_METRICS):
    p = part_panel(spark, sf_dir, metrics, aggregates=True)
    return p, stored(p)


def _number():
    """The part number inside an entity code, 1 for brands."""
    return F.coalesce(F.when(F.col("entity").startswith("P"), F.substring("entity", 2, 9).try_cast("int")), F.lit(1))


# --- scans ---------------------------------------------------------------------------------------------
def _published(spark, sf_dir):
    """The panel and its published table."""
    p, obs = _store(spark, sf_dir)
    return p, published(obs)


def scan_eligible_year(spark, sf_dir):
    p, obs = _published(spark, sf_dir)
    return shaped(scans.eligible(obs, p.dim, "exports_current", years=[B]), "entity", "name", "year", "value", "value_raw", "vintage")


def scan_eligible_range(spark, sf_dir):
    p, obs = _published(spark, sf_dir)
    return shaped(scans.eligible(obs, p.dim, "exports_current", between=(A, M)), "entity", "name", "year", "value")


def scan_eligible_years(spark, sf_dir):
    p, obs = _published(spark, sf_dir)
    return shaped(scans.eligible(obs, p.dim, "exports_current", years=[A, B, A]), "entity", "name", "year", "value", "vintage")


def scan_entity_list(spark, sf_dir):
    _, obs = _published(spark, sf_dir)
    rows = scans.entity_list(obs, "total_current", [R.FOCUS_PART, "BRAND11", "BRAND12"], [A, B])
    return shaped(rows, "entity", "year", "value")


def scan_entity_series(spark, sf_dir):
    _, obs = _published(spark, sf_dir)
    return shaped(scans.entity_series(obs, "total_current", R.FOCUS_PART, A, B), "entity", "year", "value")


def scan_point(spark, sf_dir):
    _, obs = _published(spark, sf_dir)
    return shaped(scans.point(obs, "total_current", R.FOCUS_PART, B), *STORE_COLUMNS)


def scan_comparison_columns(spark, sf_dir):
    _, obs = _published(spark, sf_dir)
    return shaped(scans.comparison_columns(obs, "exports_current", A, B))


def scan_dimension(spark, sf_dir):
    dim = part_dim(spark, sf_dir)
    parts = [
        scans.eligible_dim(dim).select(F.lit("eligible").alias("scan"), "entity", "name"),
        scans.aggregate_dim(dim).select(F.lit("aggregates").alias("scan"), "entity", "name"),
        scans.dim_entries(dim, [R.FOCUS_PART, "BRAND11"]).select(F.lit("codes").alias("scan"), "entity", "name"),
        scans.dim_entries(dim, ["size_7"], "lending_type").select(F.lit("other_code").alias("scan"), "entity", "name"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _metric_dim(spark):
    rows = [(m.key, m.subject, m.unit) for m in METRICS.values()]
    return spark.createDataFrame(rows, "metric string, subject string, unit string")


def browse_observations(spark, sf_dir):
    p, obs = _published(spark, sf_dir)
    rows = scans.with_provenance(obs, p.dim, _metric_dim(spark), F.col("year") == B)
    return shaped(rows, "entity", "name", "metric", "subject", "unit", "year", "value", "value_raw", "vintage")


def entity_listing(spark, sf_dir):
    p, obs = _published(spark, sf_dir)
    out = classify.list_entities(p.dim, obs, kind="country", search="00", metric="exports_current", year=B)
    return out.select("entity", "name", "has_data")


def observed_entities(spark, sf_dir):
    _, obs = _published(spark, sf_dir)
    return classify.observed_entities(obs, "exports_current", B)


# --- source rows and classification ---------------------------------------------------------------------
def raw_rows(spark, sf_dir):
    """Source rows with faults that follow from the part number."""
    _, obs = _store(spark, sf_dir)
    k = _number()
    code = (
        F.when(k % 11 == 0, F.lit("  "))
        .when(k % 13 == 0, F.concat(F.lit("X"), F.col("entity")))
        .when(k % 3 == 0, F.concat(F.lit(" "), F.lower("entity"), F.lit(" ")))
        .otherwise(F.col("entity"))
    )
    date = F.when(k % 23 == 0, F.lit("n/a")).otherwise(F.col("year").cast("string"))
    text = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit("NaN")).otherwise(F.col("value_raw"))
    return obs.select("metric", code.alias("code"), date.alias("date"), text.alias("value_text"), "vintage")


def _classified(spark, sf_dir):
    return classify.classify_observations(raw_rows(spark, sf_dir), part_dim(spark, sf_dir))


def ingest_classified(spark, sf_dir):
    return shaped(_classified(spark, sf_dir))


def ingest_counters(spark, sf_dir):
    return classify.rejection_counters(_classified(spark, sf_dir))


def ingest_staged(spark, sf_dir):
    return shaped(classify.staged(_classified(spark, sf_dir)))


PAGE_ROWS = 200


def _payload_text(spark, sf_dir):
    """The panel as landed page files: per metric, pages of one year's rows in the source's envelope."""
    _, obs = _store(spark, sf_dir)
    k = _number()
    at = F.when(F.col("entity").startswith("P"), F.floor(k / PAGE_ROWS)).otherwise(-1).alias("at")
    totals = obs.groupBy("metric").agg(F.count(F.lit(1)).alias("total"))  # a few metrics
    item = F.struct(
        F.struct(F.col("metric").alias("id"), F.col("metric").alias("value")).alias("indicator"),
        F.col("entity").alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.col("value_raw").alias("value"),
    )
    pages = obs.select("metric", "year", at, item.alias("item")).groupBy("metric", "year", "at").agg(F.collect_list("item").alias("items"))
    number = ((F.col("year") - 1900) * 1_000_000 + F.col("at") + 2).cast("int")
    meta = F.struct(number.alias("page"), F.col("total"), F.lit("2024-07-01").alias("lastupdated"))
    body = F.concat(F.lit("["), F.to_json(meta), F.lit(","), F.to_json("items"), F.lit("]"))
    # One page of every eleventh part block is broken off, so its payload stays short.
    broken = (F.col("metric") == "exports_current") & (F.col("at") >= 0) & (F.col("at") % 11 == 0) & (F.col("year") == B)
    file = F.concat_ws("/", "metric", F.col("year").cast("string"), F.col("at").cast("string"))
    return pages.join(totals, "metric").select(file.alias("file"), F.when(broken, F.substring(body, 1, 40)).otherwise(body).alias("body"))


def payload_pages(spark, sf_dir):
    """Status of every page."""
    pages = payloads.parse_pages(_payload_text(spark, sf_dir))
    return pages.select("file", "status", F.when(F.col("status") == "ok", F.size("rows").cast("long")).alias("rows"))


def payload_rows(spark, sf_dir):
    codes = spark.createDataFrame([(m, m) for m in RAW_METRICS], "indicator string, metric string")
    return payloads.payload_rows(payloads.parse_pages(_payload_text(spark, sf_dir)), codes).select(
        "metric", "code", "date", "value_text", "vintage"
    )


def payload_completeness(spark, sf_dir):
    out = payloads.page_completeness(payloads.parse_pages(_payload_text(spark, sf_dir)))
    return out.select("indicator", "vintage", "declared", "received", "pages", "status", "missing_rows")


def _landed_twice(spark, sf_dir):
    """All pages, every third one a second time."""
    pages = _payload_text(spark, sf_dir)
    again = pages.where(F.pmod(F.xxhash64("file"), F.lit(3)) == 0)
    return pages.unionByName(again.withColumn("file", F.concat("file", F.lit("-again"))))


def payload_landed_twice(spark, sf_dir):
    out = payloads.page_completeness(payloads.parse_pages(_landed_twice(spark, sf_dir)))
    return out.select("indicator", "vintage", "declared", "received", "pages", "status", "missing_rows")


def payload_waiting(spark, sf_dir):
    """The same pages as a stream: payloads that became whole, held in state until then."""
    root = table_folder(spark)
    _landed_twice(spark, sf_dir).repartition(6, "file").write.parquet(f"{root}/landed")
    landed = spark.readStream.schema("file string, body string").option("maxFilesPerTrigger", 3).parquet(f"{root}/landed")
    waiting.append_whole(landed, f"{root}/whole", f"{root}/progress").awaitTermination()
    pages = spark.read.schema(waiting.OUT).parquet(f"{root}/whole")
    return pages.groupBy("indicator", "vintage", "declared", "status").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("received")
    )


def _meta(spark, sf_dir):
    """Metadata records: repeated, blank, malformed and aggregate ones among them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")

    def pair(identifier, value):
        return F.struct(identifier.cast("string").alias("id"), value.alias("value"))

    code = F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0"))
    record = F.struct(
        F.when(key % 31 == 0, F.lit(" ")).when(key % 37 == 0, F.lit("P000000001")).otherwise(F.lower(code)).alias("id"),
        F.col("p_brand").alias("iso2Code"),
        F.concat(F.lit(" "), F.col("p_name")).alias("name"),
        pair(F.when(F.col("p_size") % 7 == 0, "NA").otherwise("R1"), F.when(F.col("p_size") % 5 == 0, "Aggregates").otherwise(F.col("p_type"))).alias("region"),
        pair(F.lit("I"), F.col("p_brand")).alias("incomeLevel"),
        pair(F.lit("L"), F.col("p_type")).alias("lendingType"),
    )
    return part.select(F.when(key % 41 != 0, record).alias("record"), key.alias("ingest_order"))


def entity_classes(spark, sf_dir):
    return classify.classify_entities(_meta(spark, sf_dir))


def entity_universe(spark, sf_dir):
    return classify.build_universe(_meta(spark, sf_dir))


def entity_universe_sizes(spark, sf_dir):
    return classify.universe_sizes(classify.build_universe(_meta(spark, sf_dir)))


# --- diff and publish --------------------------------------------------------------------------------
def _next_payload(spark, sf_dir):
    """A later payload: one metric as it was, one with altered, vanished and new rows."""
    _, obs = _store(spark, sf_dir, (*RAW_METRICS, "population_total"))
    k = _number()
    later = obs.where(~((F.col("metric") == "exports_current") & (k % 10 == 3)))
    touched = (F.col("metric") == "exports_current") & (k % 10 == 4)
    return later.select(
        "entity", "metric", "year",
        F.when(touched, F.col("value") + 1).otherwise(F.col("value")).alias("value"),
        "value_raw", F.lit("2024-09-01").alias("vintage"), "fetched_at",
    )


def _stored_before(spark, sf_dir):
    _, obs = _store(spark, sf_dir, (*RAW_METRICS, "population_total"))
    return obs.where(~((F.col("metric") == "exports_current") & (_number() % 10 == 5)))


def _doubled_payload(spark, sf_dir):
    """The later payload with some keys twice: the second row, with another value, is the one that counts."""
    once = _next_payload(spark, sf_dir).withColumn("ingest_order", F.lit(1))
    again = once.where((F.col("metric") == "exports_current") & (_number() % 10 == 6))
    return once.unionByName(again.withColumns({"value": F.col("value") - 2, "ingest_order": F.lit(2)}))


def payload_verdicts(spark, sf_dir):
    return publish.metric_verdicts(_stored_before(spark, sf_dir), _next_payload(spark, sf_dir))


def content_equivalence(spark, sf_dir):
    return publish.content_equivalence(_stored_before(spark, sf_dir), _next_payload(spark, sf_dir))


def dimension_verdicts(spark, sf_dir):
    dim = part_dim(spark, sf_dir)
    changed = dim.withColumn("name", F.when(_number() % 9 == 2, F.upper("name")).otherwise(F.col("name")))
    parts = [
        publish.dimension_unchanged(dim, dim.where("NOT is_aggregate")).withColumn("case", F.lit("subset")),
        publish.dimension_unchanged(dim, changed).withColumn("case", F.lit("changed")),
    ]
    return parts[0].unionByName(parts[1])


def vintage_state(spark, sf_dir):
    return publish.vintage_state(_store(spark, sf_dir)[1], "2024-07-01")


def advance_vintage(spark, sf_dir):
    _, obs = _store(spark, sf_dir)
    return shaped(publish.advance_vintage(obs, ["total_current"], A, B, "2024-09-01"), *STORE_COLUMNS)


def upsert(spark, sf_dir):
    out = publish.upsert(_stored_before(spark, sf_dir), _doubled_payload(spark, sf_dir), order="ingest_order")
    return shaped(out, *STORE_COLUMNS)


def replace_range(spark, sf_dir):
    staged = _doubled_payload(spark, sf_dir)
    out = publish.replace_range(_stored_before(spark, sf_dir), staged, ["exports_current"], A, B, order="ingest_order")
    return shaped(out, *STORE_COLUMNS)


def upsert_dimension(spark, sf_dir):
    dim = part_dim(spark, sf_dir)
    old = dim.where(_number() % 4 != 0)
    new = dim.where(_number() % 3 == 0).withColumn("name", F.upper("name"))
    return publish.upsert_dimension(old, new)


# --- derived state -------------------------------------------------------------------------------------
def metric_years(spark, sf_dir):
    out = publish.metric_years(_store(spark, sf_dir)[1])
    return out.withColumn("years", F.array_join("years", ","))


def all_years(spark, sf_dir):
    return publish.all_years(_store(spark, sf_dir)[1]).select(F.array_join("years", ",").alias("years"))


def dataset_state(spark, sf_dir):
    state = publish.dataset_state(_store(spark, sf_dir)[1])
    flat = F.array_join(F.transform(F.map_entries("years"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return state.select("observation_count", F.col("max_fetched_at").cast("string").alias("max_fetched_at"), "max_vintage", flat.alias("years"))


def vintage_summary(spark, sf_dir):
    out = publish.vintage_summary(_store(spark, sf_dir)[1])
    return out.select("metric", "vintage", "rows", F.col("first_fetched").cast("string").alias("first_fetched"),
                      F.col("last_fetched").cast("string").alias("last_fetched"), "mixed")


def year_signature(spark, sf_dir):
    return publish.year_signature(_store(spark, sf_dir)[1], [A, B])


def _runs(spark):
    rows = [
        (1, "success", "2024-07-01 00:00:00", 12, 12, True), (2, "success", "2024-07-02 06:00:00", 9, 11, True),
        (3, "failed", "2024-07-03 00:00:00", 0, 4, False),
    ]
    df = spark.createDataFrame(rows, "run_id long, status string, completed string, pages_fetched int, requests int, has_snapshot boolean")
    return df.withColumn("completed_at", F.col("completed").cast("timestamp")).drop("completed")


def _snapshots(spark, sf_dir):
    """Eligible entities as two runs saw them."""
    dim = part_dim(spark, sf_dir).select("entity", "is_aggregate")
    first = dim.where(_number() % 29 != 0).withColumn("run_id", F.lit(1).cast("long"))
    return first.unionByName(dim.withColumn("run_id", F.lit(2).cast("long")))


def _stats(spark, sf_dir):
    """Counters of run 1 for all years but the last, of run 2 for the later ones, of run 3 (failed)."""
    counters = ingest_counters(spark, sf_dir).where(F.col("year").isNotNull())
    one, two, three = (F.lit(n).cast("long") for n in (1, 2, 3))
    runs = F.when(F.col("year") >= 1999, F.array(one, two, three)).when(F.col("year") > 1995, F.array(one, three))
    return counters.select(F.explode(runs).alias("run_id"), "*")


def fingerprint(spark, sf_dir):
    out = publish.fingerprint(_store(spark, sf_dir)[1], _runs(spark))
    return out.select("observation_count", F.col("max_fetched_at").cast("string").alias("max_fetched_at"),
                      F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "run_id")


def freshness(spark, sf_dir):
    now = F.lit("2024-07-03 00:00:00").cast("timestamp")
    out = publish.freshness(_store(spark, sf_dir)[1], _runs(spark), now, 12.0)
    return out.select("has_data", "age_hours", "fresh")


# --- coverage --------------------------------------------------------------------------------------------
def coverage_panel(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return coverage.coverage_panel(p.obs, p.dim, R.FOCUS, p.rows_bound)


def yoy_coverage_panel(spark, sf_dir):
    p = customer_panel(spark, sf_dir)
    return shaped(coverage.yoy_coverage_panel(p.obs, p.dim, R.FOCUS, p.rows_bound))


def latest_counters(spark, sf_dir):
    return coverage.latest_counters(_stats(spark, sf_dir), _runs(spark))


def _order_runs(spark, sf_dir):
    """A run for each month of the orders; it failed if more than a third of them are pending or open."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    late = F.count_if(F.col("o_orderstatus") == "O") * 3 > F.count(F.lit(1))
    return orders.groupBy(month.alias("run_id")).agg(
        F.when(late, "failed").otherwise("success").alias("status"), F.count(F.lit(1)).alias("requests")
    )


def latest_runs(spark, sf_dir):
    runs = written(_order_runs(spark, sf_dir))
    both = scans.latest_runs(runs, 20).withColumn("which", F.lit("all"))
    return both.unionByName(scans.latest_runs(runs, 5, "success").withColumn("which", F.lit("success")))


def have_data(spark, sf_dir):
    p, obs = _store(spark, sf_dir)
    return scans.have_data(obs, p.dim, _metric_dim(spark))


def dimensions_equal(spark, sf_dir):
    dim = part_dim(spark, sf_dir)
    fewer = dim.where(_number() % 9 != 2)
    changed = dim.withColumn("name", F.when(_number() % 9 == 2, F.upper("name")).otherwise(F.col("name")))
    cases = {"same": dim, "fewer": fewer, "changed": changed}
    parts = [publish.dimensions_equal(dim, other).withColumn("case", F.lit(n)) for n, other in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def universe_changes(spark, sf_dir):
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "from_run long, to_run long")
    return coverage.universe_changes(_snapshots(spark, sf_dir), pairs)


def _quarter_snapshots(spark, sf_dir):
    """A run for each quarter of the shipments; the universe it saw are the parts shipped in it or the one before."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate")
    quarter = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("long")
    seen = lines.select(code("P", "l_partkey").alias("entity"), F.explode(F.array(quarter, quarter + 1)).alias("run_id"))
    return seen.distinct().withColumn("is_aggregate", F.lit(False))


def universe_intervals(spark, sf_dir):
    return coverage.universe_intervals(_quarter_snapshots(spark, sf_dir))


def universe_change_counts(spark, sf_dir):
    """All pairs of runs: what entered and left between any two of them."""
    snapshots = written(_quarter_snapshots(spark, sf_dir))
    runs = snapshots.agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    pairs = runs.select("runs", F.explode("runs").alias("from_run")).select(
        "from_run", F.explode(F.filter("runs", lambda r: r > F.col("from_run"))).alias("to_run")
    )
    return coverage.universe_change_counts(snapshots, pairs)


def total_changes(spark, sf_dir):
    p = part_panel(spark, sf_dir, RAW_METRICS)
    return coverage.total_changes(
        p.obs, p.dim, _stats(spark, sf_dir), _runs(spark), _snapshots(spark, sf_dir), R.PAIRS
    )


# --- integrity ---------------------------------------------------------------------------------------------
def _faulty(obs):
    k = _number()
    rows = obs.select(
        F.when(k % 107 == 0, F.concat(F.lit("Z"), F.col("entity"))).otherwise(F.col("entity")).alias("entity"),
        "metric",
        F.when(k % 103 == 0, F.lit(1900)).otherwise(F.col("year")).alias("year"),
        F.when(k % 101 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(k % 113 == 0, F.lit("bad")).otherwise(F.col("value_raw")).alias("value_raw"),
        "vintage", "fetched_at",
    )
    return rows.unionByName(rows.where((_number() % 109 == 0) & (F.col("metric") == "total_current")))


def _report(spark, sf_dir, obs, dim, state):
    return integrity.integrity_report(
        obs, dim, _runs(spark), _snapshots(spark, sf_dir), state,
        expected=list(RAW_METRICS), focus=R.FOCUS_PART, last_year=2001,
    )


def integrity_clean(spark, sf_dir):
    p, obs = _store(spark, sf_dir)
    obs = written(obs)  # the published table, which the report and the state read
    return _report(spark, sf_dir, obs, p.dim, publish.dataset_state(obs))


def integrity_faulty(spark, sf_dir):
    dim = part_dim(spark, sf_dir)
    flipped = dim.withColumn("is_aggregate", F.when(_number() % 97 == 3, True).otherwise(F.col("is_aggregate")))
    obs = written(_store(spark, sf_dir)[1])
    return _report(spark, sf_dir, _faulty(obs), flipped, publish.dataset_state(obs))


def acceptance_audit(spark, sf_dir):
    """Ranks recomputed from source rows against ranks of the panel."""
    p = part_panel(spark, sf_dir, ("total_current",))
    expected = rank.level_rank(p.obs, p.rows_bound).select("metric", "year", "entity", "rank", "n")
    rows = classify.staged(_classified(spark, sf_dir))
    rows = rows.join(scans.eligible_dim(p.dim).select("entity"), "entity", "left_semi")
    audit = integrity.acceptance_audit(rank.level_rank(rows, p.rows_bound), expected)
    return audit.groupBy("metric", "year", "matches").agg(F.count(F.lit(1)).alias("rows"))


def user_day_rank(spark, sf_dir):
    p = user_day_panel(spark, sf_dir)
    return shaped(rank.level_rank(p.obs, p.rows_bound), "entity", "metric", "year", "value", "rank", "n")


# --- SQL -------------------------------------------------------------------------------------------------
def _pick(names):
    return "'" + "', '".join(names) + "'"


_K = "CASE WHEN entity LIKE 'P%' THEN coalesce(TRY_CAST(substr(entity, 2, 9) AS INTEGER), 1) ELSE 1 END"
_S = with_(STORE, PART_DIM, f"st AS (SELECT *, {_K} AS k FROM store WHERE metric IN ({_pick(RAW_METRICS)}))")
_RAW = """
raw AS (SELECT metric, CASE WHEN k % 11 = 0 THEN '  ' WHEN k % 13 = 0 THEN 'X' || entity WHEN k % 3 = 0 THEN ' ' || lower(entity) || ' ' ELSE entity END AS code,
    CASE WHEN k % 23 = 0 THEN 'n/a' ELSE CAST(year AS VARCHAR) END AS date,
    CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'NaN' ELSE value_raw END AS value_text, vintage FROM st),
norm AS (SELECT *, nullif(upper(trim(code)), '') AS entity, TRY_CAST(date AS INTEGER) AS year, TRY_CAST(value_text AS DOUBLE) AS value FROM raw),
cls AS (SELECT n.*, CASE WHEN value_text IS NULL THEN 'missing_value' WHEN value IS NULL OR isnan(value) THEN 'non_finite_value' WHEN year IS NULL THEN 'invalid_year'
    WHEN n.entity IS NULL THEN 'blank_iso3' WHEN d.is_aggregate THEN 'aggregate_entity' WHEN d.entity IS NULL THEN 'unknown_country' END AS reject_reason
  FROM norm n LEFT JOIN part_dim d ON d.entity = n.entity),
cl AS (SELECT *, reject_reason IS NULL OR reject_reason = 'aggregate_entity' AS stored,
    CASE WHEN isnan(value) THEN NULL ELSE value_text END AS value_raw FROM cls)"""
_C = _S.rstrip() + ",\n" + _RAW.strip() + "\n"
_COUNTERS = """
SELECT metric, year, count(*) AS rows_received, count(*) FILTER (WHERE value IS NOT NULL AND NOT isnan(value) AND year IS NOT NULL) AS rows_with_value,
  count(*) FILTER (WHERE stored) AS rows_written, count(*) FILTER (WHERE reject_reason = 'missing_value') AS rows_null_skipped,
  count(*) FILTER (WHERE reject_reason = 'non_finite_value') AS rows_non_finite_skipped, count(*) FILTER (WHERE reject_reason = 'invalid_year') AS rows_invalid_year,
  count(*) FILTER (WHERE reject_reason = 'blank_iso3') AS rows_blank_skipped, 0::BIGINT AS rows_aggregate_excluded,
  count(*) FILTER (WHERE reject_reason = 'aggregate_entity') AS rows_aggregate_stored, count(*) FILTER (WHERE reject_reason = 'unknown_country') AS rows_unknown
FROM cl GROUP BY metric, year"""
_ST = _C.rstrip() + f""",
counters AS ({_COUNTERS}),
stats AS (SELECT r.run_id, c.* FROM counters c JOIN (VALUES (1), (2), (3)) r(run_id) ON c.year > 1995 AND (r.run_id <> 2 OR c.year >= 1999)),
latest AS (SELECT * FROM stats WHERE run_id < 3 QUALIFY row_number() OVER (PARTITION BY metric, year ORDER BY run_id DESC) = 1),
snap AS (SELECT 1 AS run_id, entity, is_aggregate FROM part_dim WHERE ({_K}) % 29 <> 0 UNION ALL SELECT 2, entity, is_aggregate FROM part_dim)
"""
_PAGES = _S.rstrip() + f""",
paged AS (SELECT *, CASE WHEN entity LIKE 'P%' THEN k // {PAGE_ROWS} ELSE -1 END AS blk FROM st),
pages AS (SELECT metric, year, blk, metric || '/' || year || '/' || blk AS file, count(*) AS n,
    CASE WHEN metric = 'exports_current' AND blk >= 0 AND blk % 11 = 0 AND year = {B} THEN 'malformed' ELSE 'ok' END AS status FROM paged GROUP BY 1, 2, 3)
"""
_COMPLETENESS = """
SELECT metric AS indicator, '2024-07-01' AS vintage, total AS declared, CAST(sum(n) AS BIGINT) AS received, count(*) AS pages,
  CASE WHEN total = sum(n) THEN 'complete' ELSE 'mismatch' END AS status, CAST(total - sum(n) AS BIGINT) AS missing_rows
FROM pages JOIN (SELECT metric AS m, count(*) AS total FROM st GROUP BY 1) t ON m = metric WHERE status = 'ok' GROUP BY metric, total"""
_META = """
WITH meta AS (SELECT p_partkey AS ingest_order, p_partkey % 41 = 0 AS broken,
    CASE WHEN p_partkey % 31 = 0 THEN ' ' WHEN p_partkey % 37 = 0 THEN 'P000000001' ELSE 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS id,
    p_brand, p_name, p_type, p_size FROM part),
cm AS (SELECT ingest_order, CASE WHEN NOT broken THEN nullif(upper(trim(id)), '') END AS entity, CASE WHEN NOT broken THEN p_brand END AS iso2,
    CASE WHEN broken THEN '' ELSE trim(p_name) END AS name, CASE WHEN broken THEN NULL WHEN p_size % 5 = 0 THEN 'Aggregates' ELSE p_type END AS region,
    CASE WHEN broken THEN NULL WHEN p_size % 7 = 0 THEN 'NA' ELSE 'R1' END AS region_id, CASE WHEN NOT broken THEN p_brand END AS income_level,
    CASE WHEN NOT broken THEN p_type END AS lending_type,
    CASE WHEN broken THEN 'country metadata was missing or malformed' WHEN p_size % 7 = 0 THEN 'region.id is "NA"' WHEN p_size % 5 = 0 THEN 'region.value is "Aggregates"'
      WHEN trim(id) = '' THEN 'blank or missing ISO3 code' END AS aggregate_reason FROM meta),
cc AS (SELECT *, aggregate_reason IS NOT NULL AS is_aggregate FROM cm),
un AS (SELECT * EXCLUDE (ingest_order) FROM cc WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ingest_order) = 1)
"""
_D = with_(STORE, PART_DIM, f"""
st AS (SELECT *, {_K} AS k FROM store WHERE metric IN ({_pick((*RAW_METRICS, 'population_total'))})),
before AS (SELECT entity, metric, year, value, value_raw, vintage FROM st WHERE NOT (metric = 'exports_current' AND k % 10 = 5)),
after AS (SELECT entity, metric, year, CASE WHEN metric = 'exports_current' AND k % 10 = 4 THEN value + 1 ELSE value END AS value, value_raw, '2024-09-01' AS vintage, k
  FROM st WHERE NOT (metric = 'exports_current' AND k % 10 = 3)),
last AS (SELECT * REPLACE (CASE WHEN metric = 'exports_current' AND k % 10 = 6 THEN value - 2 ELSE value END AS value) FROM after),
diff AS (SELECT coalesce(b.metric, a.metric) AS metric, b.entity IS NULL AS is_new, a.entity IS NULL AS is_gone, b.value = a.value AND b.value_raw = a.value_raw AS same
  FROM before b FULL JOIN after a ON a.metric = b.metric AND a.entity = b.entity AND a.year = b.year)""")
_FOUR = "entity, metric, year, round(value, 4) + 0.0 AS value, value_raw, vintage"
_FETCHED = "CASE WHEN year >= 2000 THEN '2024-07-02 00:00:00' ELSE '2024-01-02 00:00:00' END"


def _integrity_sql(faulty):
    k = _K
    source = """SELECT CASE WHEN k % 107 = 0 THEN 'Z' || entity ELSE entity END AS entity, metric, CASE WHEN k % 103 = 0 THEN 1900 ELSE year END AS year,
      CASE WHEN k % 101 = 0 THEN NULL ELSE value END AS value, CASE WHEN k % 113 = 0 THEN 'bad' ELSE value_raw END AS value_raw, vintage FROM st""" if faulty else "SELECT entity, metric, year, value, value_raw, vintage FROM st"
    again = f"UNION ALL SELECT * FROM base WHERE ({k}) % 109 = 0 AND metric = 'total_current'" if faulty else ""
    flip = f"CASE WHEN ({k}) % 97 = 3 THEN true ELSE is_aggregate END" if faulty else "is_aggregate"
    return _S.rstrip() + f""",
base AS ({source}), o AS (SELECT * FROM base {again}),
d AS (SELECT entity, {flip} AS is_aggregate FROM part_dim), snap AS (SELECT entity, is_aggregate FROM part_dim),
checks AS (
  SELECT 1 AS position, 'A.null_value' AS "check", count(*) FILTER (WHERE value IS NULL) AS failing FROM o
  UNION ALL SELECT 2, 'B.aggregate_typing', count(*) FROM d JOIN snap s ON s.entity = d.entity WHERE d.is_aggregate <> s.is_aggregate
  UNION ALL SELECT 3, 'C.unknown_iso3', count(*) FROM o WHERE entity NOT IN (SELECT entity FROM d)
  UNION ALL SELECT 4, 'D.duplicate_observation', count(*) FROM (SELECT 1 FROM o GROUP BY entity, metric, year HAVING count(*) > 1) t
  UNION ALL SELECT 5, 'E.invalid_year', count(*) FROM o WHERE year IS NULL OR year < 1960 OR year > 2003
  UNION ALL SELECT 6, 'F.non_finite_value', count(*) FROM o WHERE value IS NULL OR isnan(value)
  UNION ALL SELECT 7, 'F.raw_round_trip', count(*) FROM o WHERE value IS NOT NULL AND coalesce(TRY_CAST(value_raw AS DOUBLE) <> value, true)
  UNION ALL SELECT 8, 'G.pagination_provenance', 0
  UNION ALL SELECT 9, 'H.registry_indicators', 2 - count(DISTINCT metric) FROM o
  UNION ALL SELECT 10, 'I.focus_observations', count(*) FROM (SELECT metric FROM o GROUP BY metric HAVING count(*) FILTER (WHERE entity = '{R.FOCUS_PART}') = 0) t
  UNION ALL SELECT 11, 'J.metadata_consistency', count(*) FROM d WHERE trim(coalesce(entity, '')) = ''
  UNION ALL SELECT 12, 'K.registry_consistency', 0
  UNION ALL SELECT 13, 'L.vintage_provenance', CASE WHEN (SELECT max(vintage) FROM o) = (SELECT max(vintage) FROM st) THEN 0 ELSE 1 END)
SELECT CAST(position AS BIGINT) AS position, "check", CASE WHEN failing = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(failing AS BIGINT) AS failing FROM checks"""


_SUBJECTS = values_([(m.key, m.subject, m.unit) for m in METRICS.values()])

_QUARTERS = """WITH seen AS MATERIALIZED (
  SELECT DISTINCT 'P' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS entity, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 + k AS BIGINT) AS run_id
  FROM lineitem CROSS JOIN (VALUES (0), (1)) t(k)),
runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS place FROM (SELECT DISTINCT run_id FROM seen) t)"""

QUERIES = {
    "scan_eligible_year": (scan_eligible_year, _S + f"SELECT s.entity, name, year, round(value, 4) AS value, value_raw, vintage FROM st s JOIN part_dim d ON d.entity = s.entity WHERE NOT is_aggregate AND metric = 'exports_current' AND year = {B}"),
    "scan_eligible_range": (scan_eligible_range, _S + f"SELECT s.entity, name, year, round(value, 4) AS value FROM st s JOIN part_dim d ON d.entity = s.entity WHERE NOT is_aggregate AND metric = 'exports_current' AND year BETWEEN {A} AND {M}"),
    "scan_eligible_years": (scan_eligible_years, _S + f"SELECT s.entity, name, year, round(value, 4) AS value, vintage FROM st s JOIN part_dim d ON d.entity = s.entity WHERE NOT is_aggregate AND metric = 'exports_current' AND year IN ({A}, {B})"),
    "scan_entity_list": (scan_entity_list, _S + f"SELECT entity, year, round(value, 4) AS value FROM st WHERE metric = 'total_current' AND entity IN ('{R.FOCUS_PART}', 'BRAND11', 'BRAND12') AND year IN ({A}, {B})"),
    "scan_entity_series": (scan_entity_series, _S + f"SELECT entity, year, round(value, 4) AS value FROM st WHERE metric = 'total_current' AND entity = '{R.FOCUS_PART}' AND year BETWEEN {A} AND {B}"),
    "scan_point": (scan_point, _S + f"SELECT {_FOUR} FROM st WHERE metric = 'total_current' AND entity = '{R.FOCUS_PART}' AND year = {B}"),
    "scan_comparison_columns": (scan_comparison_columns, _S + f"SELECT entity, year, round(value, 4) AS value, value_raw, vintage FROM st WHERE metric = 'exports_current' AND year BETWEEN {A} AND {B}"),
    "scan_dimension": (scan_dimension, with_(PART_DIM) + f"""
SELECT 'eligible' AS scan, entity, name FROM part_dim WHERE NOT is_aggregate UNION ALL SELECT 'aggregates', entity, name FROM part_dim WHERE is_aggregate
UNION ALL SELECT 'codes', entity, name FROM part_dim WHERE entity IN ('{R.FOCUS_PART}', 'BRAND11')
UNION ALL SELECT 'other_code', entity, name FROM part_dim WHERE lending_type = 'size_7'"""),
    "browse_observations": (browse_observations, _S + f"""
SELECT s.entity, name, s.metric, subject, unit, year, round(value, 4) AS value, value_raw, vintage FROM st s JOIN part_dim d ON d.entity = s.entity
JOIN (VALUES {_SUBJECTS}) m(metric, subject, unit) ON m.metric = s.metric WHERE year = {B}"""),
    "entity_listing": (entity_listing, _S + f"""
SELECT d.entity, name, EXISTS (SELECT 1 FROM st s WHERE s.entity = d.entity AND metric = 'exports_current' AND year = {B}) AS has_data
FROM part_dim d WHERE NOT is_aggregate AND (lower(d.entity) LIKE '%00%' OR lower(name) LIKE '%00%')"""),
    "observed_entities": (observed_entities, _S + f"SELECT DISTINCT entity FROM st WHERE metric = 'exports_current' AND year = {B}"),
    "payload_pages": (payload_pages, _PAGES + "SELECT file, status, CASE WHEN status = 'ok' THEN n END AS rows FROM pages"),
    "payload_rows": (payload_rows, _PAGES + """
SELECT o.metric, o.entity AS code, CAST(o.year AS VARCHAR) AS date, o.value_raw AS value_text, '2024-07-01' AS vintage
FROM paged o JOIN pages p ON p.metric = o.metric AND p.year = o.year AND p.blk = o.blk WHERE status = 'ok'"""),
    "payload_completeness": (payload_completeness, _PAGES + _COMPLETENESS),
    "payload_landed_twice": (payload_landed_twice, _PAGES + _COMPLETENESS),
    "payload_waiting": (payload_waiting, _PAGES + f"""
SELECT indicator, vintage, declared, status, pages, received FROM ({_COMPLETENESS}) WHERE status = 'complete'"""),
    "ingest_classified": (ingest_classified, _C + "SELECT metric, code, date, value_text, vintage, entity, year, round(value, 4) AS value, value_raw, reject_reason, stored FROM cl"),
    "ingest_counters": (ingest_counters, _C + _COUNTERS),
    "ingest_staged": (ingest_staged, _C + f"SELECT {_FOUR} FROM cl WHERE stored"),
    "entity_classes": (entity_classes, _META + "SELECT * FROM cc"),
    "entity_universe": (entity_universe, _META + "SELECT * FROM un"),
    "entity_universe_sizes": (entity_universe_sizes, _META + "SELECT count(*) AS entities, count(*) FILTER (WHERE NOT is_aggregate) AS eligible, count(*) FILTER (WHERE is_aggregate) AS aggregates FROM un"),
    "payload_verdicts": (payload_verdicts, _D + """
SELECT metric, bool_and(coalesce(same, false)) AS unchanged, count(*) FILTER (WHERE is_new) AS added, count(*) FILTER (WHERE is_gone) AS removed,
  count(*) FILTER (WHERE NOT is_new AND NOT is_gone AND NOT same) AS altered FROM diff GROUP BY metric"""),
    "content_equivalence": (content_equivalence, _D + "SELECT metric, bool_and(coalesce(same, false)) AS identical FROM diff GROUP BY metric"),
    "dimension_verdicts": (dimension_verdicts, with_(PART_DIM) + f"""
SELECT true AS unchanged, 0::BIGINT AS differing, 'subset' AS "case"
UNION ALL SELECT count(*) = 0, count(*), 'changed' FROM part_dim WHERE ({_K}) % 9 = 2 AND upper(name) <> name"""),
    "vintage_state": (vintage_state, _S + """
SELECT metric, count(*) AS rows, 0::BIGINT AS unstamped, min(vintage) AS first_stamp, max(vintage) AS last_stamp,
  min(vintage) <> max(vintage) OR max(vintage) <> '2024-07-01' AS needs_advance FROM st GROUP BY metric"""),
    "advance_vintage": (advance_vintage, _S + f"""
SELECT entity, metric, year, round(value, 4) + 0.0 AS value, value_raw, CASE WHEN metric = 'total_current' AND year BETWEEN {A} AND {B} THEN '2024-09-01' ELSE vintage END AS vintage FROM st"""),
    "upsert": (upsert, _D + f"""
SELECT {_FOUR} FROM last UNION ALL SELECT {_FOUR} FROM before b
WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.entity = b.entity AND a.metric = b.metric AND a.year = b.year)"""),
    "replace_range": (replace_range, _D + f"""
SELECT {_FOUR} FROM before WHERE NOT (metric = 'exports_current' AND year BETWEEN {A} AND {B})
UNION ALL SELECT {_FOUR} FROM last WHERE metric = 'exports_current' AND year BETWEEN {A} AND {B}"""),
    "upsert_dimension": (upsert_dimension, with_(PART_DIM, f"k AS (SELECT *, {_K} AS k FROM part_dim)") + """
SELECT entity, upper(name) AS name, region, income_level, lending_type, is_aggregate FROM k WHERE k % 3 = 0
UNION ALL SELECT entity, name, region, income_level, lending_type, is_aggregate FROM k WHERE k % 3 <> 0 AND k % 4 <> 0"""),
    "metric_years": (metric_years, _S + """
SELECT metric, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years, min(year) AS min_year, max(year) AS max_year FROM (SELECT DISTINCT metric, year FROM st) t GROUP BY metric"""),
    "all_years": (all_years, _S + "SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM (SELECT DISTINCT year FROM st) t"),
    "dataset_state": (dataset_state, _S + f"""
SELECT (SELECT count(*) FROM st) AS observation_count, (SELECT max({_FETCHED}) FROM st) AS max_fetched_at, (SELECT max(vintage) FROM st) AS max_vintage,
  (SELECT string_agg(metric || '=' || years, ';' ORDER BY metric) FROM (
    SELECT metric, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM (SELECT DISTINCT metric, year FROM st) t GROUP BY metric) u) AS years"""),
    "vintage_summary": (vintage_summary, _S + f"""
SELECT metric, vintage, count(*) AS rows, min({_FETCHED}) AS first_fetched, max({_FETCHED}) AS last_fetched, count(*) OVER (PARTITION BY metric) > 1 AS mixed
FROM st GROUP BY metric, vintage"""),
    "year_signature": (year_signature, _S + f"SELECT metric, count(*) AS rows, min(vintage) AS min_vintage, max(vintage) AS max_vintage FROM st WHERE year IN ({A}, {B}) GROUP BY metric"),
    "fingerprint": (fingerprint, _S + f"SELECT count(*) AS observation_count, max({_FETCHED}) AS max_fetched_at, '2024-07-02 06:00:00' AS last_success, 2::BIGINT AS run_id FROM st"),
    "freshness": (freshness, _S + "SELECT count(*) > 0 AS has_data, 18.0::DOUBLE AS age_hours, false AS fresh FROM st"),
    "coverage_panel": (coverage_panel, with_(CUST, CUST_DIM, RANKED) + f"""
SELECT c.metric, c.year, (SELECT count(*) FROM cust_dim) AS eligible, c.n AS valid, (SELECT count(*) FROM cust_dim) - c.n AS missing, r.rank AS focus_rank
FROM (SELECT metric, year, count(*) AS n FROM cust GROUP BY 1, 2) c LEFT JOIN ranked r ON r.metric = c.metric AND r.year = c.year AND r.entity = '{R.FOCUS}'"""),
    "yoy_coverage_panel": (yoy_coverage_panel, with_(CUST, CUST_DIM, YOY.format(panel="cust"), YOY_RANKED, """
per AS (SELECT metric, year, count(*) AS current_valid, count(*) FILTER (WHERE reason IS NULL) AS valid_pairs FROM yoy GROUP BY metric, year)""") + f"""
SELECT a.metric, a.year, (SELECT count(*) FROM cust_dim) AS eligible, a.current_valid, coalesce(b.current_valid, 0) AS previous_valid, a.valid_pairs,
  round(f.yoy, 4) + 0.0 AS focus_yoy, CASE WHEN f.yoy IS NULL THEN coalesce(f.reason, 'current_year_value_missing') END AS focus_reason, k.rank AS focus_rank
FROM per a LEFT JOIN per b ON b.metric = a.metric AND b.year = a.year - 1
LEFT JOIN yoy f ON f.entity = '{R.FOCUS}' AND f.metric = a.metric AND f.year = a.year
LEFT JOIN yranked k ON k.entity = '{R.FOCUS}' AND k.metric = a.metric AND k.year = a.year"""),
    "latest_counters": (latest_counters, _ST + "SELECT * FROM latest"),
    "latest_runs": (latest_runs, """
WITH runs AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS run_id,
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') * 3 > count(*) THEN 'failed' ELSE 'success' END AS status, count(*) AS requests FROM orders GROUP BY 1)
(SELECT *, 'all' AS which FROM runs ORDER BY run_id DESC LIMIT 20)
UNION ALL (SELECT *, 'success' FROM runs WHERE status = 'success' ORDER BY run_id DESC LIMIT 5)"""),
    "have_data": (have_data, _S + f"""
SELECT m.metric, EXISTS (SELECT 1 FROM st s JOIN part_dim d ON d.entity = s.entity AND NOT is_aggregate WHERE s.metric = m.metric) AS has_data
FROM (VALUES {_SUBJECTS}) m(metric, subject, unit)"""),
    "dimensions_equal": (dimensions_equal, with_(PART_DIM) + f"""
SELECT 'same' AS "case", true AS identical UNION ALL SELECT 'fewer', count(*) = 0 FROM part_dim WHERE ({_K}) % 9 = 2
UNION ALL SELECT 'changed', count(*) = 0 FROM part_dim WHERE ({_K}) % 9 = 2 AND upper(name) <> name"""),
    "universe_changes": (universe_changes, with_(PART_DIM) + f"""
SELECT 1::BIGINT AS from_run, 2::BIGINT AS to_run, entity, 'added' AS change FROM part_dim WHERE NOT is_aggregate AND ({_K}) % 29 = 0
UNION ALL SELECT 2, 1, entity, 'removed' FROM part_dim WHERE NOT is_aggregate AND ({_K}) % 29 = 0"""),
    "universe_intervals": (universe_intervals, _QUARTERS + """
SELECT entity, min(run_id) AS first_run, max(run_id) AS last_run FROM (
  SELECT entity, run_id, place - row_number() OVER (PARTITION BY entity ORDER BY run_id) AS island
  FROM seen JOIN runs USING (run_id) WHERE entity IN (SELECT entity FROM seen GROUP BY entity HAVING count(*) < (SELECT count(*) FROM runs))) t
GROUP BY entity, island"""),
    "universe_change_counts": (universe_change_counts, _QUARTERS + """,
size AS (SELECT run_id, count(*) AS n FROM seen GROUP BY run_id),
same AS (SELECT a.run_id AS x, b.run_id AS y, count(*) AS n FROM seen a JOIN seen b ON a.entity = b.entity AND a.run_id < b.run_id GROUP BY 1, 2)
SELECT a.run_id AS from_run, b.run_id AS to_run, b.n - coalesce(s.n, 0) AS added, a.n - coalesce(s.n, 0) AS removed
FROM size a JOIN size b ON a.run_id < b.run_id LEFT JOIN same s ON s.x = a.run_id AND s.y = b.run_id"""),
    "total_changes": (total_changes, _ST.rstrip() + f""",
size AS (SELECT run_id, count(*) FILTER (WHERE NOT is_aggregate) AS s FROM snap GROUP BY run_id),
fact AS (SELECT n.metric, n.year, n.n, l.run_id, l.rows_received, l.rows_aggregate_excluded + l.rows_blank_skipped + l.rows_unknown AS gone,
    coalesce(z.s, (SELECT count(*) FROM part_dim WHERE NOT is_aggregate)) AS universe, z.s IS NOT NULL AS has_snap
  FROM (SELECT metric, year, count(*) AS n FROM part_obs WHERE metric IN ({_pick(RAW_METRICS)}) GROUP BY 1, 2) n
  LEFT JOIN latest l ON l.metric = n.metric AND l.year = n.year LEFT JOIN size z ON z.run_id = l.run_id),
pr AS (SELECT * FROM (VALUES {values_(R.PAIRS)}) t(a, b)),
jn AS (SELECT x.metric, p.a AS from_year, p.b AS to_year, x.n AS from_valid, y.n AS to_valid, x.universe AS from_universe, y.universe AS to_universe,
    y.universe - x.universe AS universe_delta, y.n - x.n AS valid_delta, y.rows_received - x.rows_received AS received_delta, y.gone - x.gone AS removed_rows_delta,
    coalesce(x.run_id = y.run_id, false) OR (x.has_snap AND y.has_snap) AS comparable, coalesce(x.run_id <> y.run_id, false) AS differ,
    CASE WHEN x.run_id = 1 AND y.run_id = 2 THEN 1 WHEN x.run_id = 2 AND y.run_id = 1 THEN 2 END AS turn
  FROM pr p JOIN fact x ON x.year = p.a JOIN fact y ON y.year = p.b AND y.metric = x.metric),
chg AS (SELECT count(*) AS c FROM part_dim WHERE NOT is_aggregate AND ({_K}) % 29 = 0),
jc AS (SELECT jn.*, CASE WHEN turn = 1 THEN c ELSE 0 END AS added, CASE WHEN turn = 2 THEN c ELSE 0 END AS removed FROM jn, chg)
SELECT metric, from_year, to_year, "case", CASE "case" WHEN 'NONE' THEN 'The totals, the universe and the rows received are the same.'
    WHEN 'B' THEN 'The eligible universe changed: ' || added || ' added, ' || removed || ' removed.'
    WHEN 'C' THEN 'The source sent ' || printf('%+d', coalesce(received_delta, 0)) || ' rows and the universe rule removed another number of them.'
    WHEN 'A' THEN 'Entities with a valid value: ' || printf('%+d', coalesce(valid_delta, 0)) || '.'
    ELSE 'The stored counters do not tell what changed.' END AS explanation,
  from_valid, to_valid, from_universe, to_universe, universe_delta, valid_delta, received_delta, removed_rows_delta, comparable, added, removed
FROM (SELECT *, CASE
    WHEN universe_delta = 0 AND valid_delta = 0 AND coalesce(received_delta = 0, false) THEN 'NONE'
    WHEN comparable AND (added > 0 OR removed > 0) THEN 'B'
    WHEN coalesce(removed_rows_delta <> 0, false) AND coalesce(received_delta <> 0, false) THEN 'C'
    WHEN valid_delta <> 0 AND NOT (NOT comparable AND differ) THEN 'A' ELSE 'D' END AS "case" FROM jc) j"""),
    "integrity_clean": (integrity_clean, _integrity_sql(False)),
    "integrity_faulty": (integrity_faulty, _integrity_sql(True)),
    "acceptance_audit": (acceptance_audit, _C.rstrip() + """,
ex AS (SELECT metric, year, entity, row_number() OVER (PARTITION BY year ORDER BY value DESC, entity) AS rank, count(*) OVER (PARTITION BY year) AS n
  FROM part_obs WHERE metric = 'total_current'),
gt AS (SELECT c.metric, c.year, c.entity, row_number() OVER (PARTITION BY c.metric, c.year ORDER BY value DESC, c.entity) AS rank, count(*) OVER (PARTITION BY c.metric, c.year) AS n
  FROM cl c JOIN part_dim d ON d.entity = c.entity AND NOT d.is_aggregate WHERE stored)
SELECT ex.metric, ex.year, gt.rank IS NOT DISTINCT FROM ex.rank AND gt.n IS NOT DISTINCT FROM ex.n AS matches, count(*) AS rows
FROM ex LEFT JOIN gt ON gt.metric = ex.metric AND gt.year = ex.year AND gt.entity = ex.entity GROUP BY 1, 2, 3"""),
    "user_day_rank": (user_day_rank, """WITH users AS (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS entity, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS year,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM events GROUP BY 1, 2)
SELECT entity, 'remittances_received' AS metric, year, round(value, 4) AS value, row_number() OVER (PARTITION BY year ORDER BY value DESC, entity) AS rank,
  count(*) OVER (PARTITION BY year) AS n FROM users"""),
}
