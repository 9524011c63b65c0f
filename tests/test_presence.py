"""Years held as bits: words of any number, masks, patterns, and the universes counted from them."""

import random

from pyspark.sql import functions as F

from panelyst.operators import presence as R, universe as U

SPAN = list(range(1950, 2085))  # three words


def panel(spark, seed=3):
    rng = random.Random(seed)
    held = {
        (m, f"E{i:02d}"): sorted(rng.sample(SPAN, rng.choice([0, 1, 2, len(SPAN) - 1, len(SPAN)])))
        for m in ("a", "b") for i in range(30)
    }
    held["a", "E00"] = SPAN[:62]
    held["a", "E01"] = SPAN[62:]
    rows = [(e, m, y, 1.5) for (m, e), years in held.items() for y in years]
    rows += [("E00", "a", 2080, float("nan")), ("E00", "a", 2081, None), ("E00", "a", 1900, 1.0), ("E00", "c", 1960, 1.0)]
    return {k: set(v) for k, v in held.items() if v}, spark.createDataFrame(rows, "entity string, metric string, year int, value double")


def test_words_hold_exactly_the_years_with_a_finite_value(spark):
    held, obs = panel(spark)
    rows = R.presence(obs, ["a", "b"], SPAN).collect()
    assert {(r.metric, r.entity) for r in rows} == set(held)
    for r in rows:
        assert len(r.words) == 3 and list(r.words) == R.masks(SPAN, sorted(held[r.metric, r.entity]))


def test_masks_count_and_name_what_is_missing(spark):
    held, obs = panel(spark)
    for asked in ([1950, 2011, 2012, 2073, 2074, 2084], [2000], SPAN):
        mask = F.array(*[F.lit(w).cast("long") for w in R.masks(SPAN, asked)])
        years = F.array(*map(F.lit, asked))
        words = F.col("words")
        rows = R.presence(obs, ["a", "b"], SPAN).select(
            "metric", "entity", R.held_count(words, mask).alias("n"), R.missing_count(words, mask).alias("k"),
            R.years_not_held(words, years, SPAN[0]).alias("gone"),
        ).collect()
        for r in rows:
            own = held[r.metric, r.entity]
            assert r.gone == [y for y in asked if y not in own]
            assert (r.n, r.k) == (len(own & set(asked)), len(set(asked) - own))


def test_completeness_and_runs_to_the_end(spark):
    held, obs = panel(spark)
    for r in R.completeness(obs, ["a", "b"], SPAN).collect():
        own = sorted(held[r.metric, r.entity])
        gap = max([b - a - 1 for a, b in zip(own, own[1:])], default=0)
        assert (r.years_held, r.complete, r.first_year, r.last_year, r.longest_gap) == (
            len(own), len(own) == len(SPAN), own[0], own[-1], gap)
    got = {(r.metric, r.start): r.entities for r in R.first_complete(R.presence(obs, ["a", "b"], SPAN), SPAN).collect()}
    for (metric, start), n in got.items():
        assert n == sum(m == metric and set(range(start, SPAN[-1] + 1)) <= own for (m, _), own in held.items())
    assert len(got) == 2 * len(SPAN)


def test_sizes_from_patterns_are_the_counted_rows(spark):
    _, obs = panel(spark)
    plans = [U.UniversePlan(f"{m}{i}", m, years) for m in ("a", "b", "none")
             for i, years in enumerate([(1950, 2084), (2011, 2012), (1960,), tuple(SPAN)])]
    people = U.participants_frame(spark, [(p.key, e, role) for p in plans for e, role in
                                          [("E00", "entity"), ("E00", "group_member"), ("E05", "entity"), ("ZZ", "entity")]])
    sizes = {r.plan: r.asDict() for r in U.universe_sizes(obs, plans, people).drop("metric").collect()}
    rows = {r.plan: r.asDict() for r in U.universe_counts(U.universe(obs, plans, people)).collect()}
    assert set(sizes) == {p.key for p in plans} and sizes == rows
    alone = U.universe_sizes(obs, plans, people.limit(0))
    assert {r.participants for r in alone.collect()} == {0} and alone.count() == len(plans)


def test_the_panel_is_read_once_for_all_requests(spark):
    _, obs = panel(spark)
    people = U.participants_frame(spark, [("x", "E00", "entity")])
    few = U.universe(obs, [U.UniversePlan("x", "a", (1950, 1951))], people)
    many = U.universe(obs, [U.UniversePlan(f"x{a}", "a", (a, b)) for a in range(1950, 1980) for b in (1990, 2000)], people)
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (few, many)]
    assert [p.count("Scan") for p in plans][0] == [p.count("Scan") for p in plans][1]


def test_empty_panel(spark):
    _, obs = panel(spark)
    empty = obs.limit(0)
    assert R.completeness(empty, ["a"], SPAN).count() == 0
    plan = [U.UniversePlan("k", "a", (1950,))]
    got = U.universe_sizes(empty, plan, U.participants_frame(spark, [("k", "E00", "entity")])).first()
    assert (got.candidates, got.complete, got.reference, got.excluded, got.participants) == (0, 0, 0, 1, 1)
