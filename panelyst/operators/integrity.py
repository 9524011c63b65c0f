"""Integrity checks over the published tables: one row per check, in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions.transforms import finite
from panelyst.registry import PLAUSIBLE_FIRST_YEAR, validate_registry

# fixed values: report order
ORDER = (
    "A.null_value", "B.aggregate_typing", "C.unknown_iso3", "D.duplicate_observation", "E.invalid_year",
    "F.non_finite_value", "F.raw_round_trip", "G.pagination_provenance", "H.registry_indicators",
    "I.focus_observations", "J.metadata_consistency", "K.registry_consistency", "L.vintage_provenance",
)


def _rows(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Several counts from one pass, as check rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("check"), c.cast("long").alias("failing")) for n, c in counts.items()])
    return df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def observation_totals(obs: DataFrame, dim: DataFrame, focus: str, last_year: int) -> DataFrame:
    """One row per metric with everything the checks need of the observations: one scan and one shuffle of them.

    Rows are dealt out by entity, where keys are counted, entities looked up and metrics summed without moving again.
    """
    value, year = F.col("value"), F.col("year")
    plausible = F.coalesce(year.between(PLAUSIBLE_FIRST_YEAR, last_year + 2), F.lit(False))
    parsed = F.col("value_raw").try_cast("double")
    mismatch = finite(value) & F.col("value_raw").isNotNull() & ~F.coalesce(parsed == value, F.lit(False))
    flags = {"nulls": value.isNull(), "years": ~plausible, "infinite": ~finite(value), "mismatches": mismatch}
    keyed = obs.repartition("entity").groupBy("entity", "metric", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.max("vintage").alias("stamp"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    each = keyed.groupBy("entity", "metric").agg(
        F.sum("rows").alias("rows"), F.max("stamp").alias("stamp"), F.count_if(F.col("rows") > 1).alias("doubles"),
        *[F.sum(n).alias(n) for n in flags],
    )
    known = dim.select("entity").distinct().withColumn("_known", F.lit(True))
    placed = each.join(known, "entity", "left")
    return placed.groupBy("metric").agg(
        *[F.sum(n).alias(n) for n in (*flags, "doubles")],
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("rows"))), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum(F.when(F.col("entity") == focus, F.col("rows"))), F.lit(0)).alias("mine"),
        F.max("stamp").alias("stamp"),
    )


def observation_checks(totals: DataFrame, state: DataFrame, expected: list[str]) -> DataFrame:
    """A, C, D, E, both F, H, I and L from the totals of the metrics."""
    sums = ("nulls", "years", "infinite", "mismatches", "doubles", "orphans")
    all_ = totals.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("metric").isin(expected)).alias("known"),
        F.count_if(F.col("mine") == 0).alias("absent"), F.max("stamp").alias("stamp"),
    ).crossJoin(state.select(F.col("max_vintage").alias("cached")))  # one row each
    missing = F.when(F.col("found") == 0, 0).otherwise(F.lit(len(expected)) - F.col("known") + (F.col("found") - F.col("known")))
    return _rows(all_, {
        "A.null_value": F.max("nulls"), "C.unknown_iso3": F.max("orphans"), "D.duplicate_observation": F.max("doubles"),
        "E.invalid_year": F.max("years"), "F.non_finite_value": F.max("infinite"), "F.raw_round_trip": F.max("mismatches"),
        "H.registry_indicators": F.max(missing), "I.focus_observations": F.max("absent"),
        "L.vintage_provenance": F.count_if(~F.col("cached").eqNullSafe(F.col("stamp"))),
    })


def typing_check(dim: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """B: current types against the newest successful snapshot; entities newer than it are not judged."""
    done = runs.where(F.col("status") == "success").select("run_id")
    newest = snapshots.join(done, "run_id", "left_semi").agg(F.max("run_id").alias("run_id"))
    then = snapshots.join(F.broadcast(newest), "run_id", "left_semi").select(
        "entity", F.col("is_aggregate").alias("was_aggregate")
    )
    both = dim.join(then, "entity")
    return _rows(both, {"B.aggregate_typing": F.count_if(F.col("is_aggregate") != F.col("was_aggregate"))})


def metadata_checks(dim: DataFrame, runs: DataFrame) -> DataFrame:
    """G, J and K."""
    newest = runs.where(F.col("status") == "success").agg(
        F.max_by(F.struct("pages_fetched", "requests", "has_snapshot"), "run_id").alias("r")
    )
    r = F.col("r")
    sound = r.isNull() | ((r["pages_fetched"] > 0) & (r["requests"] > 0) & r["has_snapshot"])
    blank = F.col("entity").isNull() | (F.trim("entity") == "")
    return reduce(DataFrame.unionByName, [
        _rows(newest, {"G.pagination_provenance": F.count_if(~F.coalesce(sound, F.lit(False)))}),
        _rows(dim, {"J.metadata_consistency": F.count_if(blank)}),
        dim.sparkSession.range(1).select(
            F.lit("K.registry_consistency").alias("check"), F.lit(len(validate_registry())).cast("long").alias("failing")
        ),
    ])


def merge_checks(*parts: DataFrame) -> DataFrame:
    """One report in the fixed order."""
    rows = reduce(DataFrame.unionByName, parts)
    position = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("check"))
    return rows.select(
        position.alias("position"), "check", F.when(F.col("failing") == 0, "pass").otherwise("fail").alias("status"),
        "failing",
    ).orderBy("position")


def integrity_report(obs: DataFrame, dim: DataFrame, runs: DataFrame, snapshots: DataFrame, state: DataFrame, *,
                     expected: list[str], focus: str, last_year: int) -> DataFrame:
    totals = observation_totals(obs, dim, focus, last_year)
    return merge_checks(
        observation_checks(totals, state, expected), typing_check(dim, snapshots, runs), metadata_checks(dim, runs)
    )


def acceptance_audit(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Recomputed ranks and denominators beside an expected table."""
    mine = ranked.select("metric", "year", "entity", F.col("rank").alias("got_rank"), F.col("n").alias("got_n"))
    both = expected.join(mine, ["metric", "year", "entity"], "left")
    same = F.col("got_rank").eqNullSafe(F.col("rank")) & F.col("got_n").eqNullSafe(F.col("n"))
    return both.withColumn("matches", same)
