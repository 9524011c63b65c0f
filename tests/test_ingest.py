"""Payload files, classification, versioned publishing and the incremental stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from panelyst.operators import classify, coverage, integrity
from panelyst.sources import payloads, publish
from panelyst.sources.publish import PanelStore
from panelyst.streaming.ingest import ingest_batch, start_ingest


def row(code, year, value, indicator="IND.X"):
    return {"indicator": {"id": indicator, "value": "x"}, "country": {"id": code, "value": code}, "countryiso3code": code,
            "date": str(year), "value": value, "unit": "", "obs_status": "", "decimal": 1}


def page(rows, total, stamp="2024-01-01", number=1, pages=1):
    return json.dumps([{"page": number, "pages": pages, "per_page": 50, "total": total, "sourceid": "2", "lastupdated": stamp}, rows])


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("USA", False), ("IND", False), ("WLD", True)], "entity string, is_aggregate boolean")


@pytest.fixture
def codes(spark):
    return spark.createDataFrame([("IND.X", "total_current"), ("IND.Y", "exports_current")], "indicator string, metric string")


def pages_of(spark, *bodies):
    return payloads.parse_pages(spark.createDataFrame([(f"f{i}", b) for i, b in enumerate(bodies)], "file string, body string"))


def pages_at(spark, prefix, *bodies):
    files = [(f"{prefix}{i}", b) for i, b in enumerate(bodies)]
    return payloads.parse_pages(spark.createDataFrame(files, "file string, body string"))


def test_envelopes(spark):
    pages = pages_of(
        spark, page([row("USA", 2000, 1.5), row("IND", 2000, None)], 3, pages=2), page([row("WLD", 2000, "7")], 3, number=2, pages=2),
        json.dumps([{"message": [{"id": "120", "key": "Invalid", "value": "bad"}]}]), "{\"a\": 1}", "not json", json.dumps([{"page": 1}]),
    ).cache()
    assert [r.status for r in pages.orderBy("file").collect()] == ["ok", "ok", "api_error", "malformed", "malformed", "malformed"]
    done = payloads.page_completeness(pages).first()
    assert (done.status, done.declared, done.received, done.pages) == ("complete", 3, 3, 2)
    short = payloads.page_completeness(pages_of(spark, page([row("USA", 2000, 1)], 2))).first()
    assert short.status == "mismatch" and short.missing_rows == 1
    unknown = payloads.page_completeness(pages_of(spark, page([row("USA", 2000, 1)], None))).first()
    assert unknown.status == "unknown"


def test_rejections_have_one_reason_each(spark, dim):
    raw = spark.createDataFrame(
        [("m", " usa ", "2000", "1.50", "v"), ("m", "USA", "2001", None, "v"), ("m", "", "x", None, "v"), ("m", "USA", "2000", "abc", "v"),
         ("m", "USA", "n/a", "1", "v"), ("m", "  ", "2000", "1", "v"), ("m", "WLD", "2000", "9", "v"), ("m", "ZZZ", "2000", "1", "v")],
        "metric string, code string, date string, value_text string, vintage string",
    )
    out = classify.classify_observations(raw, dim).cache()
    reasons = sorted(str(r.reject_reason) for r in out.collect())
    assert reasons == sorted(["None", "missing_value", "missing_value", "non_finite_value", "invalid_year", "blank_iso3", "aggregate_entity", "unknown_country"])
    kept = {r.entity: (r.value, r.value_raw) for r in classify.staged(out).collect()}
    assert kept == {"USA": (1.5, "1.50"), "WLD": (9.0, "9")}
    counted = classify.rejection_counters(out).where("year = 2000").first()
    assert (counted.rows_received, counted.rows_written, counted.rows_aggregate_stored, counted.rows_unknown) == (5, 2, 1, 1)


def test_first_definition_wins(spark):
    meta = spark.createDataFrame(
        [(1, ("usa", "US", " A ", ("R", "x"), ("I", "i"), ("L", "l"))), (2, ("USA", "US", "B", ("NA", "x"), None, None)), (3, None),
         (4, ("WLD", "1W", "W", ("NA", "Aggregates"), None, None)), (5, (" ", None, "blank", ("R", "x"), None, None))],
        "ingest_order int, record struct<id:string,iso2Code:string,name:string,region:struct<id:string,value:string>,"
        "incomeLevel:struct<id:string,value:string>,lendingType:struct<id:string,value:string>>",
    )
    got = {r.entity: (r.name, r.is_aggregate, r.aggregate_reason) for r in classify.build_universe(meta).collect()}
    assert got == {"USA": ("A", False, None), "WLD": ("W", True, 'region.id is "NA"')}
    reasons = [r.aggregate_reason for r in classify.classify_entities(meta).orderBy("ingest_order").collect()]
    assert reasons[2] == "country metadata was missing or malformed" and reasons[4] == "blank or missing ISO3 code"


def obs(spark, rows):
    return spark.createDataFrame(rows, publish.OBS_SCHEMA)


def test_verdicts(spark):
    stored = obs(spark, [("A", "same", 1, 1.0, "1", "v"), ("A", "value", 1, 1.0, "1", "v"), ("A", "text", 1, 1.0, "1", "v"),
                         ("A", "gone", 1, 1.0, "1", "v"), ("A", "twice", 1, 1.0, "1", "v"), ("A", "null", 1, 1.0, None, "v")])
    staged = obs(spark, [("A", "same", 1, 1.0, "1", "w"), ("A", "value", 1, 2.0, "1", "v"), ("A", "text", 1, 1.0, "1.0", "v"),
                         ("A", "new", 1, 1.0, "1", "v"), ("A", "twice", 1, 1.0, "1", "v"), ("A", "twice", 1, 1.0, "1", "v"),
                         ("A", "null", 1, 1.0, None, "v")])
    got = {r.metric: r.unchanged for r in publish.metric_verdicts(stored, staged).collect()}
    assert got == {"same": True, "null": True, "value": False, "text": False, "gone": False, "new": False, "twice": False}
    state = {r.metric: r.needs_advance for r in publish.vintage_state(stored, "w").collect()}
    assert all(state.values())
    assert not any(r.needs_advance for r in publish.vintage_state(stored, "v").collect())
    assert not any(r.needs_advance for r in publish.vintage_state(stored, "").collect())


def contents(store):
    return sorted((r.entity, r.metric, r.year, r.value, r.vintage) for r in store.read().collect())


def test_publish_replaces_skips_and_advances(spark, dim, codes, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    first = pages_of(spark, page([row("USA", 2000, 1), row("IND", 2000, 2)], 2), page([row("USA", 2000, 5, "IND.Y")], 1))
    assert ingest_batch(store, first, dim, codes, 0, 1960, 2030) == {"exports_current": "replaced", "total_current": "replaced"}
    again = pages_at(spark, "b", page([row("USA", 2000, 1), row("IND", 2000, 2)], 2), page([row("USA", 2000, 6, "IND.Y")], 1))
    assert ingest_batch(store, again, dim, codes, 1, 1960, 2030) == {"exports_current": "replaced", "total_current": "skipped"}
    later = pages_at(spark, "c", page([row("USA", 2000, 1)], 1, "2024-07-01"), page([row("USA", 2000, 6, "IND.Y")], 1, "2024-07-01"))
    assert ingest_batch(store, later, dim, codes, 2, 1960, 2030) == {"exports_current": "advanced", "total_current": "replaced"}
    assert contents(store) == [("USA", "exports_current", 2000, 6.0, "2024-07-01"), ("USA", "total_current", 2000, 1.0, "2024-07-01")]
    # A replayed version changes nothing, and an older version is still readable.
    assert ingest_batch(store, first, dim, codes, 2, 1960, 2030) == {}
    assert store.read(0).count() == 3
    assert store.side_table("runs").count() == 3


def test_partial_payloads_wait_for_their_pages(spark, dim, codes, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    half = page([row("USA", 2000, 1)], 2, pages=2)
    assert ingest_batch(store, pages_at(spark, "a", half, "broken"), dim, codes, 0, 1960, 2030) == {}
    assert store.read().count() == 0 and store.manifest()[0] == 0
    whole = page([row("USA", 2000, 5, "IND.Y")], 1)
    assert ingest_batch(store, pages_at(spark, "b", whole), dim, codes, 1, 1960, 2030) == {"exports_current": "replaced"}
    rest = page([row("IND", 2000, 2)], 2, number=2, pages=2)
    assert ingest_batch(store, pages_at(spark, "c", rest), dim, codes, 2, 1960, 2030) == {"total_current": "replaced"}
    assert [c[:4] for c in contents(store)] == [
        ("IND", "total_current", 2000, 2.0), ("USA", "exports_current", 2000, 5.0), ("USA", "total_current", 2000, 1.0)
    ]
    runs = {r.run_id: (r.status, r.pages_fetched) for r in store.side_table("runs").collect()}
    assert runs == {0: ("held", 0), 1: ("success", 1), 2: ("success", 2)}
    assert [r.status for r in store.side_table("rejected_pages").collect()] == ["malformed"]
    state = store.side_table("dataset_state").where("run_id = 2").first()
    assert state.observation_count == 3 and state.max_fetched_at is not None


def test_of_two_releases_the_newer_counts(spark, dim, codes, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    old, new = page([row("USA", 2000, 1), row("IND", 2000, 2)], 2), page([row("USA", 2000, 3)], 1, "2024-07-01")
    ingest_batch(store, pages_at(spark, "a", new, old), dim, codes, 0, 1960, 2030)
    assert contents(store) == [("USA", "total_current", 2000, 3.0, "2024-07-01")]


def test_a_failed_batch_leaves_a_run(spark, dim, codes, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        ingest_batch(store, pages_at(spark, "a", page([row("USA", 2000, 1)], 1)), dim, codes.drop("metric"), 0, 1960, 2030)
    assert [r.status for r in store.table("runs").collect()] == ["failed"] and store.manifest() == (-1, {})


def test_a_second_publish_writes_nothing(spark, tmp_path):
    """Stamps outside the range are left alone, and do not count as stale."""
    store = PanelStore(spark, str(tmp_path / "store"))
    rows = obs(spark, [("A", "m", 1950, 1.0, "1", "old"), ("A", "m", 2000, 1.0, "1", "new")])
    store.publish(0, rows, 1900, 2030)
    inside = rows.where("year = 2000")
    assert store.publish(1, inside, 1960, 2030, "new") == {"m": "skipped"}
    assert store.publish(2, inside.unionByName(inside), 1960, 2030, "new") == {"m": "replaced"}
    assert sorted((r.year, r.vintage) for r in store.read().collect()) == [(1950, "old"), (2000, "new")]


def test_stream_is_incremental_and_replay_safe(spark, dim, codes, tmp_path):
    landing, store = tmp_path / "landing", PanelStore(spark, str(tmp_path / "store"))
    landing.mkdir()
    options = dict(first=1960, last=2030)

    def drain(name):
        start_ingest(spark, str(landing), store, dim, codes, checkpoint=str(tmp_path / name), **options).awaitTermination()

    (landing / "one.json").write_text(page([row("USA", 2000, 1), row("IND", 2000, 2)], 2))
    drain("progress")
    assert [c[3] for c in contents(store)] == [2.0, 1.0]
    # A correction and a vanished value arrive in the next payload.
    (landing / "two.json").write_text(page([row("USA", 2000, 7)], 1))
    drain("progress")
    assert contents(store) == [("USA", "total_current", 2000, 7.0, "2024-01-01")]
    before = store.manifest()
    drain("progress")
    assert store.manifest() == before


def test_coverage_precedence(spark):
    rows = [  # eligible, valid, received, removed deltas, comparable, changed, runs differ -> case
        (0, 0, 0, 0, True, True, True, "NONE"), (1, 1, 1, 1, True, True, True, "B"), (0, 1, 1, 1, True, False, False, "C"),
        (0, 1, 0, 0, True, False, False, "A"), (0, 1, None, None, False, False, False, "A"), (0, 1, 0, 0, False, False, True, "D"),
        (0, 0, None, None, True, False, False, "D"),
    ]
    df = spark.createDataFrame(rows, "e int, v int, r int, x int, c boolean, u boolean, d boolean, want string")
    case = coverage.explain_change(*[F.col(n) for n in "evrxcud"])
    assert df.where(case != F.col("want")).count() == 0


def test_integrity_finds_each_fault(spark):
    good = [("A", "m", 2000, 1.0, "1", "v")]
    dim = spark.createDataFrame([("A", False)], "entity string, is_aggregate boolean")
    faults = {
        "A.null_value": [("A", "m", 2000, None, None, "v")], "C.unknown_iso3": [("Z", "m", 2000, 1.0, "1", "v")],
        "D.duplicate_observation": good, "E.invalid_year": [("A", "m", 1900, 1.0, "1", "v")],
        "F.non_finite_value": [("A", "m", 2001, math.inf, None, "v")], "F.raw_round_trip": [("A", "m", 2001, 1.0, "2", "v")],
    }
    state = spark.createDataFrame([("v",)], "max_vintage string")

    def checks_of(table):
        totals = integrity.observation_totals(table, dim, "A", 2020)
        return integrity.merge_checks(integrity.observation_checks(totals, state, ["m"]))

    for name, extra in faults.items():
        table = obs(spark, good + extra)
        report = checks_of(table)
        assert name in {r.check for r in report.where("status = 'fail'").collect()}
    clean = obs(spark, good)
    report = checks_of(clean)
    assert [r.check for r in report.where("status = 'fail'").collect()] == []
