"""Coverage panels, and why a year's total differs from another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions.plan import plan_rows
from panelyst.operators.classify import removed_by_universe_rule
from panelyst.operators.rank import denominators, locate
from panelyst.operators.yoy import yoy_coverage, yoy_locate, yoy_rows
from panelyst.session import cut_lineage


def summarize(eligible: Column, valid: Column) -> list[Column]:
    return [
        eligible.alias("eligible"), valid.alias("valid"),
        F.greatest(F.lit(0), eligible - valid).alias("missing"),
    ]


def eligible_count(dim: DataFrame) -> DataFrame:
    return dim.agg(F.count_if(~F.col("is_aggregate")).alias("_eligible"))


def coverage_panel(obs: DataFrame, dim: DataFrame, focus: str, rows_bound: int | None = None) -> DataFrame:
    """Eligible, valid and missing entities of every metric-year, with the focus rank."""
    counts = denominators(obs)
    places = locate(obs, [focus], rows_bound).select("metric", "year", "rank")
    # The universe size is one row.
    panel = counts.crossJoin(F.broadcast(eligible_count(dim)))
    return panel.join(places, ["metric", "year"], "left").select(
        "metric", "year", *summarize(F.col("_eligible"), F.col("n")), F.col("rank").alias("focus_rank")
    )


def yoy_coverage_panel(obs: DataFrame, dim: DataFrame, focus: str, rows_bound: int | None = None) -> DataFrame:
    """Level denominators of both years beside the valid pairs, with the focus's growth and rank."""
    counts = yoy_coverage(obs).crossJoin(F.broadcast(eligible_count(dim)))
    mine = yoy_rows(obs.where(F.col("entity") == focus)).select(
        "metric", "year", F.col("yoy").alias("focus_yoy"), F.col("reason").alias("focus_reason")
    )
    places = yoy_locate(obs, [focus], rows_bound).select("metric", "year", F.col("rank").alias("focus_rank"))
    out = counts.join(mine, ["metric", "year"], "left").join(places, ["metric", "year"], "left")
    return out.select(
        "metric", "year", F.col("_eligible").alias("eligible"), "current_valid", "previous_valid", "valid_pairs",
        "focus_yoy",
        F.when(F.col("focus_yoy").isNull(), F.coalesce("focus_reason", F.lit("current_year_value_missing"))).alias("focus_reason"),
        "focus_rank",
    )


def latest_counters(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Counters of the newest successful run that fetched each metric-year."""
    done = runs.where(F.col("status") == "success").select("run_id")
    rows = stats.join(done, "run_id", "left_semi")
    columns = [c for c in rows.columns if c not in ("metric", "year", "run_id")]
    newest = rows.groupBy("metric", "year").agg(
        F.max_by(F.struct("run_id", *columns), "run_id").alias("s")
    )
    return newest.select("metric", "year", "s.*")


def _moving(snapshots: DataFrame) -> DataFrame:
    """``entity, own, runs``: the runs that hold an entity, for those that some snapshot does not hold."""
    # One row: the runs that left a snapshot.
    runs = snapshots.agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    held = snapshots.where(~F.col("is_aggregate")).groupBy("entity").agg(F.array_sort(F.collect_set("run_id")).alias("own"))
    return held.crossJoin(F.broadcast(runs)).where(F.size("own") < F.size("runs"))


def universe_intervals(snapshots: DataFrame) -> DataFrame:
    """``entity, first_run, last_run``: the longest stretches of consecutive snapshots in which an entity is eligible.

    Only entities that some snapshot does not hold have rows; all others are there throughout.
    """
    places = F.transform("own", lambda r: F.array_position("runs", r).cast("int"))
    at = _moving(snapshots).select("entity", "runs", places.alias("own"))
    starts = F.filter("own", lambda p, i: (i == 0) | (F.get("own", i - 1) != p - 1))
    ends = F.filter("own", lambda p, i: F.coalesce(F.get("own", i + 1) != p + 1, F.lit(True)))
    stretch = F.zip_with(starts, ends, lambda s, e: F.struct(
        F.element_at("runs", s).alias("first_run"), F.element_at("runs", e).alias("last_run")))
    return at.select("entity", F.inline(stretch))


def _ends(run_pairs: DataFrame) -> DataFrame:
    """Both runs of each pair: the run that holds an entity, and the other, which may not."""
    both = F.array(
        F.struct(F.col("to_run").alias("run_id"), F.col("from_run").alias("other"), F.lit("added").alias("change")),
        F.struct(F.col("from_run").alias("run_id"), F.col("to_run").alias("other"), F.lit("removed").alias("change")),
    )
    return run_pairs.select("from_run", "to_run").distinct().select("from_run", "to_run", F.inline(both))


def _changed(held: DataFrame, run_pairs: DataFrame) -> DataFrame:
    rows = held.select("*", F.explode("own").alias("run_id")).join(_ends(run_pairs), "run_id")
    return rows.where(F.array_contains("runs", F.col("other")) & ~F.array_contains("own", F.col("other")))


def universe_changes(snapshots: DataFrame, run_pairs: DataFrame) -> DataFrame:
    """Entities that entered or left the eligible universe between two runs, as rows.

    ``run_pairs`` has from_run and to_run. Entities that every run holds are laid out over no pair. A run without a
    snapshot tells nothing: its pairs have no rows.
    """
    return _changed(_moving(snapshots), run_pairs).select("from_run", "to_run", "entity", "change")


def universe_change_counts(snapshots: DataFrame, run_pairs: DataFrame) -> DataFrame:
    """How many entities entered and left between two runs, for any number of pairs; a row for each pair.

    Entities that the same runs hold are counted once together, so pairs meet the distinct histories, not entities.
    """
    histories = _moving(snapshots).groupBy("own", "runs").agg(F.count("*").alias("entities"))
    counts = _changed(histories, run_pairs).groupBy("from_run", "to_run").agg(*[
        F.sum(F.when(F.col("change") == kind, F.col("entities")).otherwise(0)).alias(kind) for kind in ("added", "removed")
    ])
    pairs = run_pairs.select("from_run", "to_run").distinct()
    return pairs.join(counts, ["from_run", "to_run"], "left").na.fill(0, ["added", "removed"])


def explain_change(eligible_delta: Column, valid_delta: Column, received_delta: Column, removed_delta: Column,
                   comparable: Column, universe_changed: Column, runs_differ: Column) -> Column:
    """The case of a total change: none, then B, C, A and D in that order.

    A missing counter is not a zero delta, so without counters equal totals still fall to D.
    """
    def moved(delta: Column) -> Column:
        return F.coalesce(delta != 0, F.lit(False))

    def still(delta: Column) -> Column:
        return F.coalesce(delta == 0, F.lit(False))

    return (
        F.when(still(eligible_delta) & still(valid_delta) & still(received_delta), "NONE")
        .when(comparable & universe_changed, "B")
        .when(moved(removed_delta) & moved(received_delta), "C")
        .when(moved(valid_delta) & ~(~comparable & runs_differ), "A")
        .otherwise("D")
    )


def explanation(case: Column, valid_delta: Column, received_delta: Column, added: Column, removed: Column) -> Column:
    """The case in a sentence."""
    number = lambda c: F.format_string("%+d", F.coalesce(c, F.lit(0)))
    return (
        F.when(case == "NONE", "The totals, the universe and the rows received are the same.")
        .when(case == "B", F.concat(F.lit("The eligible universe changed: "), added.cast("string"), F.lit(" added, "), removed.cast("string"), F.lit(" removed.")))
        .when(case == "C", F.concat(F.lit("The source sent "), number(received_delta), F.lit(" rows and the universe rule removed another number of them.")))
        .when(case == "A", F.concat(F.lit("Entities with a valid value: "), number(valid_delta), F.lit(".")))
        .otherwise("The stored counters do not tell what changed.")
    )


def total_changes(obs: DataFrame, dim: DataFrame, stats: DataFrame, runs: DataFrame, snapshots: DataFrame,
                  year_pairs: list[tuple[int, int]]) -> DataFrame:
    """Why the ranked total differs between two years, for every metric and pair.

    Each year is judged by the universe of the run that fetched it, and by today's count when that run
    left no snapshot. The runs to compare are those that the two years of a row come from.
    """
    counters = latest_counters(stats, runs).withColumn("_removed", removed_by_universe_rule())
    sizes = snapshots.groupBy("run_id").agg(F.count_if(~F.col("is_aggregate")).alias("_snapshot"))
    facts = denominators(obs).join(
        counters.select("metric", "year", "run_id", "rows_received", "_removed"), ["metric", "year"], "left"
    ).join(sizes, "run_id", "left")
    facts = facts.crossJoin(F.broadcast(eligible_count(dim))).select(
        "metric", "year", "run_id", "n", "rows_received", "_removed",
        F.col("_snapshot").isNotNull().alias("has_snapshot"),
        F.coalesce("_snapshot", "_eligible").alias("universe"),
    )
    plan = plan_rows([{"from": a, "to": b} for a, b in year_pairs], "from int; to int")

    def side(name: str, at: str):
        laid = facts.select("*", F.explode(plan).alias("p")).where(F.col("year") == F.col(f"p.{at}"))
        return laid.select(
            "metric", F.col("p.from").alias("from_year"), F.col("p.to").alias("to_year"),
            *[F.col(c).alias(f"{name}_{c}") for c in
              ("run_id", "n", "rows_received", "_removed", "has_snapshot", "universe")],
        )

    rows = side("from", "from").join(side("to", "to"), ["metric", "from_year", "to_year"])
    rows = cut_lineage(rows)  # a row for each metric and pair; read again for its runs
    pairs = rows.select(F.col("from_run_id").alias("from_run"), F.col("to_run_id").alias("to_run"))
    pairs = pairs.where(F.col("from_run") != F.col("to_run"))
    changes = universe_change_counts(snapshots, pairs)
    rows = rows.join(
        changes,
        (rows["from_run_id"] == changes["from_run"]) & (rows["to_run_id"] == changes["to_run"]), "left",
    ).fillna(0, ["added", "removed"])
    same_run = F.coalesce(F.col("from_run_id") == F.col("to_run_id"), F.lit(False))
    comparable = same_run | F.coalesce(
        F.col("from_run_id").isNotNull() & F.col("to_run_id").isNotNull() & F.col("from_has_snapshot") & F.col("to_has_snapshot"),
        F.lit(False),
    )
    changed = ~same_run & ((F.col("added") > 0) | (F.col("removed") > 0))
    deltas = {
        "universe": F.col("to_universe") - F.col("from_universe"),
        "valid": F.col("to_n") - F.col("from_n"),
        "received": F.col("to_rows_received") - F.col("from_rows_received"),
        "removed_rows": F.col("to__removed") - F.col("from__removed"),
    }
    differ = F.coalesce(F.col("from_run_id") != F.col("to_run_id"), F.lit(False))
    case = explain_change(
        deltas["universe"], deltas["valid"], deltas["received"], deltas["removed_rows"], comparable, changed, differ
    )
    return rows.select(
        "metric", "from_year", "to_year", case.alias("case"),
        explanation(case, deltas["valid"], deltas["received"], F.col("added"), F.col("removed")).alias("explanation"),
        F.col("from_n").alias("from_valid"), F.col("to_n").alias("to_valid"), "from_universe", "to_universe",
        *[c.alias(f"{n}_delta") for n, c in deltas.items()],
        comparable.alias("comparable"), "added", "removed",
    )
