"""Identities over every pair and focus, the sliced plan, and verifiers that fail closed."""

import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators import growth, movement as mv, ordered, rank, verify

YEARS = [2000, 2001, 2002, 2003]


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(3)
    rows = [
        (f"E{i:03d}", m, y, float(rng.randrange(1, 40)))
        for m in ("total_current", "inflation_cpi") for i in range(60) for y in YEARS if rng.random() < 0.8
    ]
    return spark.createDataFrame(rows, "entity string, metric string, year int, value double").cache()


def _set(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_every_check_passes(obs):
    ranked = rank.level_rank(obs, 100)
    pairs, triples = mv.year_pairs(YEARS), mv.year_triples(YEARS)
    two = mv.two_year(ranked, pairs, rows_bound=100)
    three = mv.three_year(ranked, triples, rows_bound=100)
    requests = [(2000, None, 2003), (2000, 2001, 2003)]
    grown = growth.growth_movement(obs, requests, rows_bound=100)
    for report in (
        verify.verify_two_year(two, ranked, pairs, rows_bound=100),
        verify.verify_three_year(three, ranked, triples, rows_bound=100),
        verify.verify_growth(grown, obs, requests, rows_bound=100),
    ):
        assert verify.failures(report).collect() == []
        verify.assert_verified(report)


def test_sliced_plan_gives_the_same_rows(obs, monkeypatch):
    pairs, requests = [(2000, 2003), (2001, 2002)], [(2000, 2001, 2003)]
    ranked = rank.level_rank(obs, 100)
    plain = [
        _set(mv.two_year(ranked, pairs, rows_bound=100)),
        _set(mv.three_year(ranked, [(2000, 2001, 2003)], rows_bound=100)),
        _set(growth.growth_movement(obs, requests, rows_bound=100)),
    ]
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 20)
    ranked = rank.level_rank(obs)
    sliced = [
        _set(mv.two_year(ranked, pairs, rows_bound=100)),
        _set(mv.three_year(ranked, [(2000, 2001, 2003)], rows_bound=100)),
        _set(growth.growth_movement(obs, requests, rows_bound=100)),
    ]
    assert plain == sliced


def test_partition_count_does_not_matter(spark, obs):
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(_set(growth.growth_movement(obs.repartition(n), [(2000, 2001, 2003)], rows_bound=100)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("change, check", [
    (("common_rank_a", 1), "common-A.ranking_matches_engine_order"),
    (("entered_above", 1), "entered.above_below_reconciles"),
    (("set_effect", 1), "decomposition.identity"),
    (("n_a", 1), "A.set_partition"),
])
def test_tampering_is_noticed(obs, change, check):
    column, by = change
    ranked = rank.level_rank(obs, 100)
    rows = mv.two_year(ranked, [(2000, 2003)], rows_bound=100)
    entity = rows.where("status = 'common' AND metric = 'total_current'").first().entity
    one = (F.col("entity") == entity) & (F.col("metric") == "total_current")
    bad = rows.withColumn(column, F.when(one, F.col(column) + by).otherwise(F.col(column)))
    failed = {r.check for r in verify.failures(verify.verify_two_year(bad, ranked, [(2000, 2003)], rows_bound=100)).collect()}
    assert check in failed


def test_lost_and_doubled_rows_are_noticed(obs):
    ranked = rank.level_rank(obs, 100)
    rows = mv.two_year(ranked, [(2000, 2003)], rows_bound=100)
    entity = rows.where("status = 'common' AND metric = 'total_current'").first().entity
    for bad in (rows.where(F.col("entity") != entity), rows.unionByName(rows.where(F.col("entity") == entity))):
        report = verify.verify_two_year(bad, ranked, [(2000, 2003)], rows_bound=100)
        failed = {r.check for r in verify.failures(report).collect()}
        assert "members.unique_and_partitioned" in failed
        with pytest.raises(AssertionError):
            verify.assert_verified(report)


def test_year_order_is_checked(obs):
    with pytest.raises(ValueError):
        mv.two_year(rank.level_rank(obs, 100), [(2003, 2000)], rows_bound=100)


def test_relations(spark, obs):
    ranked = rank.level_rank(obs, 100)
    rows = mv.two_year(ranked, [(2000, 2003)], rows_bound=100)
    focus = rows.where("status = 'common' AND metric = 'total_current'").first().entity
    seen = mv.relations(rows, [focus]).where("metric = 'total_current'").cache()
    mine = rows.where((F.col("entity") == focus) & (F.col("metric") == "total_current")).first()
    affecting = {r.status: r.n for r in seen.where("affects_position").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert affecting.get("exited", 0) == mine.exited_above and affecting.get("entered", 0) == mine.entered_above
    assert mv.filter_relations(seen, "above_a").count() == mine.rank_a - 1
    assert {r.entity for r in mv.summary_rows(seen).where("status = 'common'").collect()} == {focus}


@pytest.mark.parametrize("window_rows", [1_000_000, 5])
def test_status_positions_go_by_code_and_by_rank(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", window_rows)
    rng = random.Random(9)
    order = {y: rng.sample([f"E{i:02d}" for i in range(30)], 20) for y in (2000, 2003)}
    ranks = {y: {e: i + 1 for i, e in enumerate(entities)} for y, entities in order.items()}
    rows = []
    for e in sorted({*order[2000], *order[2003]}):
        a, b = ranks[2000].get(e), ranks[2003].get(e)
        rows.append(("m", 2000, 2003, e, "exited" if b is None else "entered" if a is None else "common", a, b))
    schema = "metric string, a int, b int, entity string, status string, rank_a long, rank_b long"
    got = mv.status_positions(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(got) == len(rows)
    for status in ("common", "exited", "entered"):
        listed = [(e, b or a) for _, _, _, e, s, a, b in rows if s == status]
        assert listed
        by_rank = {e: i + 1 for i, (_, e) in enumerate(sorted((r, e) for e, r in listed))}
        want = {(e, i + 1, by_rank[e], len(listed)) for i, (e, _) in enumerate(listed)}
        assert {(r.entity, r.position_in_status, r.position_by_rank, r.n_status) for r in got if r.status == status} == want
