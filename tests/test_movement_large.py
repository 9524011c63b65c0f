"""Movement and its checks store, order and shuffle nothing as large as entities x requests, and miss no row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from panelyst.operators import movement as mv, ordered, rank, verify

YEARS = [1900, 1961, 1962, 2003]  # more years than a word has bits


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(5)
    rows = [
        (f"E{i:03d}", m, y, float(rng.randrange(1, 9)))
        for m in ("total_current", "inflation_cpi") for i in range(40) for y in YEARS if rng.random() < 0.6
    ]
    return spark.createDataFrame(rows, "entity string, metric string, year int, value double").cache()


def _moved_by_request(df):
    """Lines of the plan that deal out or order rows of entities by the years of a request."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = [x for x in plan if re.search(r"\+- (Exchange hash|Window|Sort) ?", x) or "Exchange hashpartitioning" in x]
    return [x for x in lines if re.search(r"(hashpartitioning|windowspecdefinition)\([^)]*\b[ab]#", x) and "entity#" in x]


@pytest.mark.parametrize("window_rows", [1_000_000, 10])
def test_movement_is_counted_in_the_panel(obs, monkeypatch, window_rows):
    """Every count against brute force, by groups of both kinds, and no request's rows are moved or stored."""
    ranked = rank.level_rank(obs, 100)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: pytest.fail("rows are stored"), raising=False)
    pairs, triples = mv.year_pairs(YEARS), mv.year_triples(YEARS)
    two, three = mv.two_year(ranked, pairs, rows_bound=40), mv.three_year(ranked, triples, rows_bound=40)
    assert not _moved_by_request(two) and not _moved_by_request(three)
    assert "Window [sum(_is__common_a" not in two._jdf.queryExecution().executedPlan().toString()
    at = {(r.metric, r.year, r.entity): r["rank"] for r in ranked.collect()}
    held = {}
    for m, y, e in at:
        held.setdefault((m, e), set()).add(y)

    def upto(metric, years, y, entity):
        return sum(at[metric, y, e] <= at[metric, y, entity] for (m, e), ys in held.items() if m == metric and set(years) <= ys)

    for df, requests, sides in ((two, pairs, "ab"), (three, triples, "amb")):
        got = df.collect()
        assert len(got) == sum(any(y in ys for y in years) for years in requests for ys in held.values())
        for r in got:
            years = [r[s] for s in sides]
            everyone = [ys for (m, _), ys in held.items() if m == r.metric]
            common = set(years) <= held[r.metric, r.entity]
            assert (r.status == "common") == common
            assert r.n_common == sum(set(years) <= ys for ys in everyone)
            for s, y in zip(sides, years):
                assert r[f"rank_{s}"] == at.get((r.metric, y, r.entity)) and r[f"n_{s}"] == sum(y in ys for ys in everyone)
                assert r[f"common_rank_{s}"] == (upto(r.metric, years, y, r.entity) if common else None)
            if sides == "amb":
                assert r.n_outside == sum(any(y in ys for y in years) for ys in everyone) - r.n_common
            else:
                assert (r.n_exited, r.n_entered) == (r.n_a - r.n_common, r.n_b - r.n_common)


def test_no_request_gives_no_rows(obs):
    assert mv.two_year(rank.level_rank(obs, 100), [], rows_bound=100).count() == 0


def _failed(report):
    return {(tuple(r)[:-2], r.check) for r in verify.failures(report).collect()}


def test_checks_store_and_move_no_rows_of_requests(obs, monkeypatch):
    monkeypatch.setattr(verify, "cut_lineage", lambda df: pytest.fail("rows are stored"))
    ranked = rank.level_rank(obs, 100)
    pairs, triples = mv.year_pairs(YEARS), mv.year_triples(YEARS)
    for report in (
        verify.verify_two_year(mv.two_year(ranked, pairs, rows_bound=100), ranked, pairs, rows_bound=100),
        verify.verify_three_year(mv.three_year(ranked, triples, rows_bound=100), ranked, triples, rows_bound=100),
    ):
        assert not _moved_by_request(report)
        assert verify.failures(report).collect() == []


@pytest.mark.parametrize("window_rows", [1_000_000, 10])
def test_every_lost_invented_or_changed_row_is_found(spark, obs, monkeypatch, window_rows):
    """One row at a time: the request it belongs to is refused, and no other."""
    ranked = rank.level_rank(obs, 100)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", window_rows)
    pairs = mv.year_pairs(YEARS)
    rows = mv.two_year(ranked, pairs, rows_bound=100).where("metric = 'total_current'").cache()
    ranked = ranked.where("metric = 'total_current'")
    counts = {r.entity: r["count"] for r in rows.groupBy("entity").count().collect()}
    entity = next(e for e, n in sorted(counts.items()) if n == len(pairs))
    check = lambda df: _failed(verify.verify_two_year(df, ranked, pairs, rows_bound=100))
    mine = F.col("entity") == entity
    for (a, b), also in ((pairs[2], True), (pairs[0], False), (pairs[-1], False)):
        one = mine & (F.col("a") == a) & (F.col("b") == b)
        group = ("total_current", a, b)
        lost = check(rows.where(~one))
        assert {g for g, _ in lost} == {group} and (group, "A.set_partition") in lost
        if not also:
            continue
        twice = check(rows.unionByName(rows.where(one)))
        assert {g for g, _ in twice} == {group} and (group, "members.unique_and_partitioned") in twice
        invented = check(rows.unionByName(rows.where(one).withColumn("entity", F.lit("X"))))
        assert {g for g, _ in invented} == {group} and (group, "members.disjoint") in invented
        wrong = check(rows.withColumn("n_common", F.when(one, F.col("n_common") + 1).otherwise(F.col("n_common"))))
        assert wrong == {(group, "common.is_exact_intersection")}
    gone = check(rows.where(~mine))
    assert {g for g, _ in gone} == {("total_current", a, b) for a, b in pairs}
    other = check(rows.unionByName(rows.where(mine & (F.col("a") == YEARS[0]) & (F.col("b") == YEARS[1])).withColumn("b", F.lit(2010))))
    assert {g for g, _ in other} == {("total_current", YEARS[0], 2010)}


def test_wrong_ranks_of_the_source_are_refused(obs):
    """The ranks that the movement was made from are proven too: two swapped ones are refused in all their requests."""
    ranked = rank.level_rank(obs, 100)
    swapped = F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank"))
    bad = ranked.withColumn("rank", F.when((F.col("year") == YEARS[1]) & (F.col("metric") == "total_current"), swapped).otherwise(F.col("rank")).cast("long"))
    pairs = mv.year_pairs(YEARS)
    failed = _failed(verify.verify_two_year(mv.two_year(bad, pairs, rows_bound=100), bad, pairs, rows_bound=100))
    assert {g for g, _ in failed} == {("total_current", a, b) for a, b in pairs if YEARS[1] in (a, b)}
    assert {c for _, c in failed} == {"A.ranking_matches_engine_order", "B.ranking_matches_engine_order"}


def test_verified_rows_are_fixed_but_not_laid_out_on_disk(obs, monkeypatch):
    monkeypatch.setattr(verify, "cut_lineage", lambda df: pytest.fail("rows are stored"))
    ranked = rank.level_rank(obs, 100)
    pairs, triples = mv.year_pairs(YEARS), mv.year_triples(YEARS)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(verify.verified_two_year(ranked, pairs, rows_bound=100)) == key(mv.two_year(ranked, pairs, rows_bound=100))
    assert key(verify.verified_three_year(ranked, triples, rows_bound=100)) == key(mv.three_year(ranked, triples, rows_bound=100))
