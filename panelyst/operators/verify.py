"""Self-checks of movement results: one row per request and check, failing closed.

Every check recounts from the inputs; none trusts a column it is checking. Ranks are not made again: those of the
source are proven by ``certify``, and common ranks are running counts along them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.operators.certificates import certify
from panelyst.operators.growth import NO_MIDDLE, growth_movement, interval_rows
from panelyst.operators.movement import SIDES_THREE, SIDES_TWO, beside_years, by_entity, laid_parts, request_plan, three_year, two_year
from panelyst.operators.ordered import join_small
from panelyst.operators.presence import BITS
from panelyst.operators.rank import direction_sign
from panelyst.session import cut_lineage

LABEL = {"a": "A", "m": "MID", "b": "B"}


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _report(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    flags = {f"_c{i}": c for i, c in enumerate(checks.values())}
    judged = rows.groupBy(*keys).agg(*[
        F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(n) for n, c in flags.items()
    ])
    entries = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(flag).alias("passed")) for name, flag in zip(checks, flags)
    ])
    return judged.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.check", "e.passed")


class _Pass:
    """What one pass over the rows adds up, and checks made of it beside totals of the same group: the rows are never
    read twice, and so never stored."""

    def __init__(self) -> None:
        self.facts: dict[str, Column] = {}

    def add(self, fact: Column) -> Column:
        name = f"_f{len(self.facts)}"
        self.facts[name] = fact
        return F.col(name)

    def count(self, where: Column) -> Column:
        return self.add(F.count_if(where))

    def every(self, check: Column) -> Column:
        return F.coalesce(self.add(F.bool_and(F.coalesce(check, F.lit(False)))), F.lit(True))

    def equal(self, value: Column, total: Column, where: Column | None = None) -> Column:
        """Every row's ``value`` is the group's ``total``."""
        where = F.lit(True) if where is None else where
        mine = F.when(where, value)
        low, high, missing = self.add(F.min(mine)), self.add(F.max(mine)), self.count(where & value.isNull())
        return (missing == 0) & F.coalesce((low == total) & (high == total), F.lit(True))

    def within(self, value: Column, total: Column) -> Column:
        """Every value lies between 1 and the group's ``total``; rows without one do not matter."""
        return F.coalesce((self.add(F.min(value)) >= 1) & (self.add(F.max(value)) <= total), F.lit(True))

    def report(self, rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
        judged = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in self.facts.items()])
        entries = F.array(*[F.struct(F.lit(name).alias("check"), passed.alias("passed")) for name, passed in checks.items()])
        return judged.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.check", "e.passed")


def _source(ranked: DataFrame, requests: list[tuple[int, ...]], key: str, rows_bound: int, metrics: int) -> DataFrame:
    """One row per metric and entity: what the ranked panel says of each year asked for (the key, the rank, whether it
    is proven, and the common entities at or above it in each request), and the years held as bits."""
    wanted = sorted({y for years in requests for y in years})
    rows = ranked.where(F.col("year").isin(wanted)).repartition("metric", "entity").groupBy("metric", "entity", "year").agg(
        F.max(key).alias("key"), F.max("rank").alias("rank")
    )
    held, complete = beside_years(rows, requests, rows_bound)
    by = F.col("key") * direction_sign(F.col("metric"))
    proven = certify(held, ["metric", "year"], "rank", by, "ordered", complete, rows_bound=rows_bound)
    # Dealt out as the movement is, whose rows then stay where they are.
    parts = laid_parts(ranked, len(requests), rows_bound, metrics)
    return by_entity(proven, complete, ["key", "rank", "ordered"], rows_bound, parts, *[c for c in held.columns if c not in rows.columns])


def _against_source(movement: DataFrame, ranked: DataFrame, requests: list[tuple[int, ...]],
                    sides: tuple[str, ...], key: str, rows_bound: int, metrics: int) -> DataFrame:
    """Movement rows beside what the ranked panel says, so that a lost, invented or doubled entity shows.

    The panel's side comes as one row per metric and entity, so that requests are laid out on neither side of the join.
    An entity's rows lie in the order of requests; a request that the panel asks for and that lies in no row, between
    two rows or at the ends, is a lost row.
    """
    requests = sorted(set(requests))
    plan = request_plan(requests, sides)
    span = sorted({y for years in requests for y in years}) or [0]
    source = _source(ranked, requests, key, rows_bound, metrics).withColumn("_in_source", F.lit(True))
    words = [c for c in source.columns if c.startswith("_years_")]
    numbered = movement.sparkSession.range(1).select(F.explode(plan).alias("_p")).select("_p.*")
    rows = movement.withColumn("_in_result", F.lit(True)).join(F.broadcast(numbered), list(sides), "left")
    # An entity has one row a request, so these groups stay tiny; one order serves the window and the join.
    along = Window.partitionBy("metric", "entity").orderBy("request", *sides)
    rows = rows.withColumns({
        "_copies": F.count(F.lit(1)).over(along.rangeBetween(Window.currentRow, Window.currentRow)),
        "_before": F.lag("request").over(along), "_more": F.lead(F.lit(True)).over(along),
    })
    rows = rows.join(source, ["metric", "entity"], "full")
    # Requests between the row before and this one; behind an entity's last row, also all that follow.
    mine, before, many = F.coalesce("request", F.lit(-1)), F.coalesce("_before", F.lit(-1)), F.lit(len(requests))
    last = ~F.coalesce("_more", F.lit(False))

    def lost(first, count):
        return F.when(F.col("_in_source") & (count > 0), F.filter(F.slice(plan, first + 1, count), asked))

    def asked(p):
        # Held by the panel in any year of the request.
        any_held = F.lit(False)
        for s in sides:
            place = p[s] - min(span)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(BITS)).cast("int"))
            word = F.get(F.array(*words), F.floor(place / BITS).cast("int"))
            any_held = any_held | (word.bitwiseAND(bit) != 0)
        return any_held

    own = F.struct("request", *sides, *[f"at_{s}" for s in sides])
    entries = F.concat(
        F.when(F.col("_in_result"), F.array(F.struct(F.lit(False).alias("lost"), own.alias("of")))).otherwise(F.array()),
        *[F.coalesce(F.transform(part, lambda p: F.struct(F.lit(True).alias("lost"), p.alias("of"))), F.array()) for part in (
            lost(before + 1, mine - before - 1), F.when(last, lost(mine + 1, many - mine - 1)),
        )],
    )
    rows = rows.withColumn("_entry", F.explode(entries))
    there = ~F.col("_entry.lost")
    shown = [F.when(there, F.col(c)).alias(c) for c in (*movement.columns, "_in_result", "_copies") if c not in ("metric", "entity", *sides)]
    known = F.col("_entry.of.request").isNotNull()
    picked, seen = [], []
    for s in sides:
        at = F.when(known, F.try_element_at("_seen", F.col(f"_entry.of.{s}")))
        seen.append(at.isNotNull())
        picked += [
            at.isNotNull().alias(f"_seen_{s}"), at["rank"].alias(f"_rank_{s}"), at["key"].alias(f"_key_{s}"),
            F.coalesce(at["ordered"], F.lit(True)).alias(f"_ordered_{s}"),
            F.get(at["upto"], F.col(f"_entry.of.at_{s}")).cast("long").alias(f"_upto_{s}"),
        ]
    rows = rows.select("metric", "entity", *[F.col(f"_entry.of.{s}").alias(s) for s in sides], *shown, *picked)
    every = reduce(lambda x, y: x & y, [F.col(f"_seen_{s}") for s in sides])
    return rows.withColumn("_every", every).withColumns(
        {f"_fresh_common_{s}": F.when(every, F.col(f"_upto_{s}")) for s in sides}
    )


def _counted(rows: DataFrame, keys: list[str], facts: dict[str, Column], groups_bound: int) -> DataFrame:
    """Aggregates of each group beside its rows, which are fixed already: partial sums and a join to one small side."""
    small = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()])
    return join_small(rows, small, keys, groups_bound)


def _totals(done: _Pass, sides: tuple[str, ...]) -> dict[str, Column]:
    """The populations, counted again from what the panel says."""
    every = F.col("_every")
    out = {f"n_{s}": done.count(F.col(f"_seen_{s}")) for s in sides} | {"n_common": done.count(every)}
    out |= {f"n_outside_{s}": done.count(F.col(f"_seen_{s}") & ~every) for s in sides}
    return out | {"n_union": done.count(F.lit(True))}


def _checks_of_sides(done: _Pass, totals: dict[str, Column], sides):
    """Checks both forms share."""
    checks = {}
    for s in sides:
        name = LABEL[s]
        checks[f"{name}.set_partition"] = done.equal(F.col(f"n_{s}"), totals[f"n_{s}"])
        checks[f"{name}.ranking_matches_engine_order"] = done.every(
            F.col(f"_ordered_{s}") & (F.col(f"_seen_{s}") == F.col(f"_rank_{s}").isNotNull())
            & _same(F.col(f"rank_{s}"), F.col(f"_rank_{s}")) & _same(F.col(f"key_{s}"), F.col(f"_key_{s}"))
        )
        checks[f"common-{name}.ranking_matches_engine_order"] = done.every(
            _same(F.col(f"common_rank_{s}"), F.col(f"_fresh_common_{s}"))
        )
    checks["members.unique_and_partitioned"] = done.every((F.col("_copies") == 1) & F.col("_in_result"))
    bounds = F.lit(True)
    for s in sides:
        bounds = bounds & done.within(F.col(f"rank_{s}"), totals[f"n_{s}"])
        bounds = bounds & done.within(F.col(f"common_rank_{s}"), totals["n_common"])
    checks["ranks.within_bounds"] = bounds
    return checks


def _integers_only(movement: DataFrame, names: list[str]) -> Column:
    kinds = {f.name: f.dataType.typeName() for f in movement.schema.fields}
    return F.lit(all(kinds[n] in ("long", "integer") for n in names))


def verify_two_year(movement: DataFrame, ranked: DataFrame, pairs: list[tuple[int, int]], *,
                    rows_bound: int, key: str = "value", metrics: int = 20) -> DataFrame:
    rows = _against_source(movement, ranked, pairs, SIDES_TWO, key, rows_bound, metrics)
    done = _Pass()
    n = _totals(done, SIDES_TWO)
    common, status = F.col("_every"), F.col("status")
    known = F.col("_seen_a") | F.col("_seen_b")
    a_only = ~common & F.when(known, F.col("_seen_a"))
    b_only = ~common & F.when(known, F.col("_seen_b"))
    either = F.when(common, F.lit(None)).otherwise(F.lit(True))
    full = F.col("rank_b") - F.col("rank_a")
    alike = F.col("common_rank_b") - F.col("common_rank_a")
    skip = ~common
    checks = _checks_of_sides(done, n, SIDES_TWO) | {
        "common.is_exact_intersection": done.every(common == (status == "common")) & done.equal(F.col("n_common"), n["n_common"]),
        "exited.is_exact_difference": done.every(a_only == (status == "exited")) & done.equal(F.col("n_exited"), n["n_outside_a"]),
        "entered.is_exact_difference": done.every(b_only == (status == "entered")) & done.equal(F.col("n_entered"), n["n_outside_b"]),
        "members.disjoint": n["n_common"] + n["n_outside_a"] + n["n_outside_b"] == n["n_union"],
        "exited.above_below_reconciles": done.equal(F.col("exited_above") + F.col("exited_below"), n["n_outside_a"], common),
        "entered.above_below_reconciles": done.equal(F.col("entered_above") + F.col("entered_below"), n["n_outside_b"], common),
        "partial_identity_A": done.every(skip | (F.col("_fresh_common_a") == F.col("_rank_a") - F.col("exited_above"))),
        "partial_identity_B": done.every(skip | (F.col("_fresh_common_b") == F.col("_rank_b") - F.col("entered_above"))),
        "decomposition.identity": done.every(
            skip
            | (full == alike + F.col("entered_above") - F.col("exited_above"))
            & (F.col("position_change") == F.col("common_effect") + F.col("set_effect"))
        ),
        "decomposition.observed_set_effect_matches_counts": done.every(
            skip | (F.col("set_effect") == F.col("entered_above") - F.col("exited_above"))
        ),
        "classification.position_based": done.every(
            skip | (F.col("position_change") == full) & (F.col("common_effect") == alike) & (F.col("places_gained") == -full)
        ),
        "members.missing_has_reason": done.every(F.coalesce(either == F.col("reason").isNotNull(), F.col("reason").isNull())),
        "outputs.integers_only": _integers_only(
            movement, ["rank_a", "rank_b", "common_rank_a", "common_rank_b", "position_change", "set_effect"]
        ),
    }
    return done.report(rows, ["metric", "a", "b"], checks)


def verify_three_year(movement: DataFrame, ranked: DataFrame, triples: list[tuple[int, int, int]], *,
                      rows_bound: int, key: str = "value", metrics: int = 20) -> DataFrame:
    rows = _against_source(movement, ranked, triples, SIDES_THREE, key, rows_bound, metrics)
    done = _Pass()
    n = _totals(done, SIDES_THREE)
    common = F.col("_every")
    skip = ~common
    checks = _checks_of_sides(done, n, SIDES_THREE) | {
        "common.is_exact_intersection": done.every(common == (F.col("status") == "common")) & done.equal(F.col("n_common"), n["n_common"]),
        "outside.is_union_minus_common": done.equal(F.col("n_outside"), n["n_union"] - n["n_common"]),
        "common.universe_consistent_across_years": done.every(
            skip
            | (F.col("_fresh_common_a").isNotNull() & F.col("_fresh_common_m").isNotNull() & F.col("_fresh_common_b").isNotNull())
        ),
    }
    for s in SIDES_THREE:
        name, outside = LABEL[s], n[f"n_outside_{s}"]
        above = F.col(f"outside_above_{s}")
        checks[f"outsideIn{name}.is_exact_difference"] = done.equal(F.col(f"n_outside_{s}"), outside)
        checks[f"outside.above_below_reconciles_{name}"] = done.equal(above + F.col(f"outside_below_{s}"), outside, common)
        checks[f"partial_identity_{name}"] = done.every(skip | (F.col(f"_fresh_common_{s}") == F.col(f"_rank_{s}") - above))
    for seg, s, e in (("am", "a", "m"), ("mb", "m", "b"), ("ab", "a", "b")):
        full = F.col(f"_rank_{e}") - F.col(f"_rank_{s}")
        alike = F.col(f"_fresh_common_{e}") - F.col(f"_fresh_common_{s}")
        checks[f"decomposition.identity_{seg.upper()}"] = done.every(skip | (
            (F.col(f"position_change_{seg}") == full)
            & (F.col(f"common_effect_{seg}") == alike)
            & (F.col(f"set_effect_{seg}") == F.col(f"outside_above_{e}") - F.col(f"outside_above_{s}"))
        ))
    adds = F.lit(True)
    for stem in ("position_change", "common_effect", "set_effect"):
        adds = adds & (F.col(f"{stem}_ab") == F.col(f"{stem}_am") + F.col(f"{stem}_mb"))
    checks["decomposition.segments_add_up"] = done.every(skip | adds)
    checks["outputs.integers_only"] = _integers_only(movement, ["position_change_ab", "set_effect_ab", "common_rank_m"])
    return done.report(rows, ["metric", *SIDES_THREE], checks)


def verify_growth(movement: DataFrame, obs: DataFrame, requests, *, rows_bound: int, metrics: int = 20,
                  tolerance: float = 1e-6) -> DataFrame:
    """Growth checks per interval. Peer means are recomputed in doubles, hence the tolerance."""
    ids = ["metric", "a", "_m", "b", "interval", "entity"]
    keys = ids[:-1]

    def keyed(df):
        return df.withColumn("_m", F.coalesce("m", F.lit(NO_MIDDLE))).drop("m")

    source = keyed(interval_rows(obs, requests)).select(
        *ids, F.col("growth").alias("_growth"), F.col("growth_reason").alias("_reason"), F.col("common").alias("_in_common")
    )
    copies = F.count(F.lit(1)).over(Window.partitionBy(*ids))
    rows = source.join(keyed(movement).withColumn("_copies", copies), ids, "full")
    rows = cut_lineage(rows.withColumn("_valid", F.col("_growth").isNotNull()))
    common = F.col("_valid") & F.coalesce("_in_common", F.lit(False))
    facts = {
        "_n": F.count_if("_valid"),
        "_n_common": F.count_if(common),
        "_total": F.sum(F.when(F.col("_valid"), F.col("_growth"))),
        "_total_common": F.sum(F.when(common, F.col("_growth"))),
        "_n_outside": F.count_if(F.col("_valid") & ~common),
    }
    groups = len(set(requests)) * 3 * metrics
    rows = _counted(rows, keys, facts, groups)
    rows = certify(rows, keys, "full_rank", F.col("_growth"), "_ordered", {"_upto": common}, rows_bound=rows_bound)
    rows = rows.withColumn("_fresh_common", F.when(common, F.col("_upto")))

    def mean_is_right(total, count, inside, mean, shown):
        peers = F.col(count) - inside.cast("long")
        right = F.try_divide(F.coalesce(F.col(total), F.lit(0.0)) - F.when(inside, F.col("_growth")).otherwise(0.0), peers)
        near = F.abs(F.col(mean) - right) <= tolerance * F.greatest(F.lit(1.0), F.abs(right))
        return (F.col(shown) == peers) & F.when(peers == 0, F.col(mean).isNull()).otherwise(near)

    counted = F.col("outside_above") + F.col("outside_below")
    checks = {
        "set_partition": (F.col("_copies") == 1) & _same(F.col("growth"), F.col("_growth")) & _same(F.col("growth_reason"), F.col("_reason")),
        "outside_matches_members": _same(F.col("n_observed") - F.col("n_common"), F.col("_n_outside")),
        "common_subset_of_observed": ~F.coalesce("_in_common", F.lit(False)) | F.col("_valid"),
        "observed.ranking_matches_engine_order": F.col("_ordered") & (F.col("_valid") == F.col("full_rank").isNotNull()),
        "common.ranking_matches_engine_order": _same(F.col("common_rank"), F.col("_fresh_common")),
        "denominators_equal_population_sizes": _same(F.col("n_observed"), F.col("_n")) & _same(F.col("n_common"), F.col("_n_common")),
        "partial_identity": ~common | (F.col("common_rank") == F.col("full_rank") - F.col("outside_above")),
        "outside_counts_reconcile": ~F.col("_valid") | (counted == F.col("_n_outside")),
        "peer_mean_recomputed": mean_is_right("_total", "_n", F.col("_valid"), "peer_mean", "peer_count"),
        "peer_mean_common_recomputed": mean_is_right("_total_common", "_n_common", common, "peer_mean_common", "peer_count_common"),
        "difference_is_plain_subtraction": _same(F.col("vs_peer"), F.col("growth") - F.col("peer_mean")),
        "null_coherence": (F.col("growth").isNull() == F.col("reason").isNotNull())
        & (F.col("vs_peer").isNull() == F.col("vs_peer_reason").isNotNull())
        & (F.col("full_rank").isNull() == F.col("growth").isNull()),
        "ranks_within_bounds": F.coalesce(F.col("full_rank").between(1, F.col("_n")), F.lit(True))
        & F.coalesce(F.col("common_rank").between(1, F.col("_n_common")), F.lit(True)),
        "ranked_rows_hold_finite_growth": F.col("full_rank").isNull() | ~F.isnan("growth"),
        "common.members_valid_in_every_interval": ~F.coalesce("_in_common", F.lit(False)) | F.col("growth_reason").isNull(),
    }
    report = _report(rows, keys, checks)
    return report.select(
        "metric", "a", F.when(F.col("_m") != NO_MIDDLE, F.col("_m")).alias("m"), "b", "interval", "check", "passed"
    )


def failures(report: DataFrame) -> DataFrame:
    return report.where(~F.col("passed"))


def assert_verified(report: DataFrame) -> None:
    """Publish nothing from a result that fails any of its checks."""
    first = failures(report).limit(5).collect()
    if first:
        raise AssertionError(f"movement verification failed: {[tuple(r) for r in first]}")


def verified_two_year(ranked: DataFrame, pairs: list[tuple[int, int]], *, rows_bound: int, metrics: int = 20) -> DataFrame:
    """Two-year movement that is handed out only if all its checks hold; raises otherwise."""
    rows = two_year(ranked, pairs, rows_bound=rows_bound, metrics=metrics, fixed=True)
    assert_verified(verify_two_year(rows, ranked, pairs, rows_bound=rows_bound, metrics=metrics))
    return rows


def verified_three_year(ranked: DataFrame, triples: list[tuple[int, int, int]], *, rows_bound: int, metrics: int = 20) -> DataFrame:
    """The same for three years."""
    rows = three_year(ranked, triples, rows_bound=rows_bound, metrics=metrics, fixed=True)
    assert_verified(verify_three_year(rows, ranked, triples, rows_bound=rows_bound, metrics=metrics))
    return rows


def verified_growth(obs: DataFrame, requests, *, rows_bound: int, metrics: int = 20) -> DataFrame:
    """The same for growth movement."""
    rows = cut_lineage(growth_movement(obs, requests, rows_bound=rows_bound))
    assert_verified(verify_growth(rows, obs, requests, rows_bound=rows_bound, metrics=metrics))
    return rows


def ranked_outside_universe(ranked: DataFrame, dim: DataFrame) -> DataFrame:
    """Ranked rows whose entity is unknown or an aggregate. Must be empty."""
    return ranked.join(dim.where(~F.col("is_aggregate")), "entity", "left_anti")
