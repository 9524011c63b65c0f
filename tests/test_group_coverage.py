import random

from pyspark.sql import functions as F

from panelyst.operators import groups

YEARS = [2000, 2002, 2005]


def _panel(spark):
    rng = random.Random(7)
    rows = [(f"E{e}", m, y, float(rng.randrange(-5, 9))) for e in range(30) for m in ("m", "other") for y in range(1999, 2007) if rng.random() < 0.6]
    rows += [("E0", "m", 2001, float("nan"))]
    return rows, spark.createDataFrame(rows, "entity string, metric string, year int, value double").repartition(4)


def test_vectors_and_coverage_against_plain_loops(spark):
    rows, obs = _panel(spark)
    value = {(e, y): v for e, m, y, v in rows if m == "m" and v == v}
    member = [(f"g{i % 4}", f"E{i}") for i in range(35)] + [("g0", "E1")]  # E30 to E34 have nothing; E1 is in two groups
    members = spark.createDataFrame(member, "group_key string, member string")
    gaps = {e: [y for y in YEARS if (e, y) not in value] for _, e in member}
    got = {(r.group_key, r.member): (r.role, r.missing_years) for r in groups.member_coverage(members, obs, "m", YEARS).collect()}
    assert got == {(g, e): ("missing" if gaps[e] else "used", gaps[e]) for g, e in member}
    for r in groups.group_coverage(members, obs, "m", YEARS).collect():
        mine = [e for g, e in member if g == r.group_key]
        assert (r.members, r.used) == (len(mine), sum(not gaps[e] for e in mine)) and r.complete == (r.members == r.used)
        assert (r.valid, r.missing) == (sum((e, r.year) in value for e in mine), sum((e, r.year) not in value for e in mine))
    for r in groups.group_series(members, obs, "m", YEARS).collect():
        mine = [e for g, e in member if g == r.group_key]
        held = [value[e, r.year] for e in mine if (e, r.year) in value]
        assert r.observed == (sum(held) if held else None)
        whole = [value[e, r.year] for e in mine if not gaps[e]]
        assert r.like_for_like == (sum(whole) if whole else None)


def test_points(spark):
    _, obs = _panel(spark)
    points = spark.createDataFrame([("E1", False), ("NONE", True)], "entity string, is_aggregate boolean")
    got = {r.entity: r for r in groups.point_coverage(points, obs, "m", YEARS).collect()}
    assert got["NONE"].basis == "published_aggregate" and got["NONE"].missing_years == YEARS and not got["NONE"].complete
    assert got["E1"].years_held + len(got["E1"].missing_years) == len(YEARS)


def test_members_meet_the_panel_once(spark):
    """One join by entity; no row for each member and year before the groups add up."""
    _, obs = _panel(spark)
    members = spark.createDataFrame([("g", "E1")], "group_key string, member string")
    plan = groups.group_series(members, obs, "m", YEARS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
    assert "Generate" not in plan[plan.index("Aggregate") :]
    assert members.where(F.lit(False)).count() == 0
