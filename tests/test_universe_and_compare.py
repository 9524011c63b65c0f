"""The frozen universe, its hash, entity specs and the compare rules."""

import pytest
from pyspark.sql import functions as F

from panelyst.functions.hashing import membership_hash
from panelyst.operators import compare as C, entities, groups, universe as U


def fnv(codes):
    h = 0x811C9DC5
    for byte in ("".join(c + "," for c in sorted(codes))).encode():
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return f"fnv1a32:{h:08x}"


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_sliced_hash(spark, slices, monkeypatch):
    monkeypatch.setattr(U, "FANOUT", 2)  # the maps of three and eight slices are joined in a tree
    sets = {"p": [f"E{i:03d}" for i in range(57)], "q": ["USA"], "r": ["IND", "USA", "BRA"]}
    rows = [(g, c) for g, codes in sets.items() for c in reversed(codes)]
    df = spark.createDataFrame(rows, "plan string, entity string").repartition(5)
    got = {r.plan: r.membership_hash for r in U.membership_hashes(df, "plan", F.lit(True), slices).collect()}
    assert got == {g: fnv(codes) for g, codes in sets.items()}
    small = df.groupBy("plan").agg(membership_hash(F.collect_list("entity")).alias("h"))
    assert {r.plan: r.h for r in small.collect()} == got


def obs_of(spark, series):
    rows = [(e, m, y, float(v)) for (e, m), values in series.items() for y, v in values.items()]
    return spark.createDataFrame(rows, "entity string, metric string, year int, value double")


def dim_of(spark, codes, aggregates=()):
    return spark.createDataFrame([(c, f"Name {c}", c in aggregates) for c in codes], "entity string, name string, is_aggregate boolean")


def test_universe_and_ledger(spark):
    obs = obs_of(spark, {("A", "m"): {1: 1, 2: 1}, ("B", "m"): {1: 1}, ("C", "m"): {1: 0, 2: -1}, ("D", "m"): {3: 1}})
    people = U.participants_frame(spark, [("k", "A", "entity"), ("k", "A", "group_member"), ("k", "B", "entity"), ("k", "Z", "entity")])
    members = U.universe(obs, [U.UniversePlan("k", "m", (1, 2))], people).cache()
    got = {r.entity: r for r in members.collect()}
    assert set(got) == {"A", "B", "C", "Z"} and [e for e in got if got[e].reference] == ["C"]
    assert got["A"].role == "entity_and_group_member" and got["A"].complete
    assert got["B"].reasons == [U.PARTICIPANT, U.MISSING_YEARS] and got["B"].missing_years == [2]
    assert not got["Z"].candidate and got["Z"].reasons == [U.PARTICIPANT]
    counts = U.universe_counts(members).first()
    assert (counts.candidates, counts.complete, counts.reference, counts.excluded) == (3, 2, 1, 3)


def test_specs(spark):
    rows = [(1, "country:usa", None), (2, "group: b , a", "G"), (3, "group:a,a", None), (4, "nope", None), (5, "aggregate:W", None),
            (6, "country:W", None), (7, "group:a,W", None), (8, "group:a,b,c", None)]
    specs = spark.createDataFrame(rows, "id int, spec string, label string")
    out = entities.resolve_specs(entities.parse_specs(specs, max_members=2), dim_of(spark, ["USA", "A", "B", "C", "W"], ["W"]))
    got = {r.id: (r.kind, r.members, r.error_code) for r in out.collect()}
    assert got[1] == ("COUNTRY", ["USA"], None) and got[2] == ("CUSTOM_GROUP", ["A", "B"], None)
    assert [got[i][2] for i in (3, 4, 5, 6, 7, 8)] == [
        "INVALID_GROUP", "INVALID_ENTITY", None, "INVALID_COUNTRY", "INVALID_GROUP_MEMBER", "INVALID_GROUP",
    ]


def run(spark, series, *requests, aggregates=("W",)):
    codes = sorted({e for e, _ in series})
    out = C.compare(obs_of(spark, series), dim_of(spark, codes, aggregates), list(requests), rows_bound=100)
    return {(r.request, r.interval): r for r in out.collect()}


def test_group_coverage_blocks_a_change_but_not_like_for_like(spark):
    m = "exports_current"
    series = {("A", m): {1: 10, 2: 20}, ("B", m): {1: 5}, ("C", m): {1: 1, 2: 3}, ("W", m): {1: 100, 2: 110}}
    got = run(
        spark, series,
        C.Request("obs", "country:C", "group:A,B", m, "percent_change", 1, 2),
        C.Request("lfl", "country:C", "group:A,B", m, "percent_change", 1, 2, mode="like_for_like"),
        C.Request("agg", "country:C", "aggregate:W", m, "absolute_change", 1, 2, mode="like_for_like"),
        C.Request("lvl", "country:C", "group:A,B", m, "level", 1, 2),
    )
    assert got["obs", "AB"].b_reason == "COVERAGE_INCOMPLETE" and got["obs", "AB"].block == "COVERAGE_INCOMPLETE"
    assert got["lfl", "AB"].gap == pytest.approx(200 - 100) and got["lfl", "AB"].block is None
    assert got["agg", "AB"].gap_reason == "AGGREGATE_COVERAGE_NOT_COMPARABLE" and got["agg", "AB"].a_value == 2
    assert got["lvl", "1"].gap == 1 - 15 and got["lvl", "2"].gap_reason == "COVERAGE_INCOMPLETE" and got["lvl", "2"].b_value == 20


def test_plans():
    plan = C.resolve_plan("period_total", "exports_current", 2004, 2014, 2024)
    assert [(i.name, len(i.years)) for i in plan.intervals] == [("AB", 10), ("BC", 10), ("AC", 20)]
    assert [len(i.years) for i in C.resolve_plan("movement_period_total", "exports_current", 2004, 2014).intervals] == [11]
    assert [len(i.years) for i in C.resolve_plan("movement_period_total", "fdi_inflows", 2004, 2014).intervals] == [10]
    assert [i.name for i in C.resolve_plan("segmented_growth", "total_current", 1, 2, 3).intervals] == ["AM", "MB", "AB"]
    assert C.resolve_plan("segmented_growth", "total_current", 1, 2).error == "MISSING_YEAR"
    assert C.resolve_plan("level", "total_current", 1, 1).error == "SAME_YEAR_SELECTED"
    assert C.resolve_plan("cross_rate", "fx_official", 1, 2).error == "INVALID_OPERATION"
    assert C.resolve_plan("period_total_growth", "exports_current", 1, None, 3).intervals[0].statistic == "MISSING_MIDDLE_YEAR"


def test_group_ratio_needs_both_legs_and_one_vintage(spark):
    num, den, own = "fdi_inflows", "total_current", "fdi_inflows_pct_gdp"
    rows = [(e, m, 1, v, s) for e, s, values in (
        ("A", "v1", (10, 100, 10)), ("B", "v1", (5, 200, 2.5)), ("C", "v2", (1, 50, 2)), ("D", "v1", (1, None, None)),
    ) for m, v in zip((num, den, own), map(lambda x: None if x is None else float(x), values)) if v is not None]
    obs = spark.createDataFrame(rows, "entity string, metric string, year int, value double, vintage string")
    members = spark.createDataFrame(
        [("ok", "A"), ("ok", "B"), ("mixed", "A"), ("mixed", "C"), ("gap", "A"), ("gap", "D")], "group_key string, member string"
    )
    got = {r.group_key: r for r in groups.group_ratio_series(members, obs, own, [1]).collect()}
    assert got["ok"].observed == pytest.approx(5.0)
    assert got["mixed"].observed_reason == "INCOMPATIBLE_LEGS"
    assert got["gap"].observed_reason == "MISSING_REQUIRED_DATA" and got["gap"].like_for_like == pytest.approx(10.0)
