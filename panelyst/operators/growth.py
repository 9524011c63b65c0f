"""Growth movement over intervals: each interval ranks its own valid pairs, and again the entities
valid in every interval of the request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyst.functions.transforms import yoy
from panelyst.functions.years import intervals
from panelyst.operators.ordered import EXACT, group_facts, prefix_counts, rank_rows
from panelyst.operators.yoy import by_year

REQUEST = ["metric", "a", "m", "b"]
# Stands for "no middle year" inside the operator: a key column must not be null.
NO_MIDDLE = -1
GROUP = [*REQUEST, "interval"]

# fixed values: reason codes
NO_GROWTH = "no_calculable_growth_for_focus_in_interval"
NO_PEERS = "no_peer_economies_after_excluding_focus"
PEERS_UNAVAILABLE = "peer_average_unavailable"


def interval_rows(obs: DataFrame, requests: list[tuple[int, int | None, int]]) -> DataFrame:
    """Growth or its reason for each entity holding a level at any year of the request."""
    years = sorted({y for request in requests for y in request if y is not None})
    levels = by_year(obs.where(F.col("year").isin(years)), ["metric", "entity"])
    parts = []
    for a, m, b in sorted(set(requests), key=str):
        spans = intervals(a, b, m)
        seen = [F.try_element_at("values", F.lit(y)) for y in (a, m, b) if y is not None]
        grown = [
            yoy(F.try_element_at("values", F.lit(e)), F.try_element_at("values", F.lit(s))) for _, s, e in spans
        ]
        common = grown[0].reason.isNull()
        for g in grown[1:]:
            common = common & g.reason.isNull()
        cells = F.array(*[
            F.struct(
                F.lit(name).alias("interval"),
                F.lit(s).alias("start"),
                F.lit(e).alias("end"),
                F.try_element_at("values", F.lit(s)).alias("start_value"),
                F.try_element_at("values", F.lit(e)).alias("end_value"),
                g.value.alias("growth"),
                g.reason.alias("growth_reason"),
            )
            for (name, s, e), g in zip(spans, grown)
        ])
        parts.append(
            F.struct(
                F.lit(a).alias("a"),
                F.lit(NO_MIDDLE if m is None else m).alias("m"),
                F.lit(b).alias("b"),
                F.coalesce(*seen).isNotNull().alias("seen"),
                common.alias("common"),
                cells.alias("cells"),
            )
        )
    laid = levels.select("metric", "entity", F.explode(F.array(*parts)).alias("r")).where("r.seen")
    return laid.select(
        "metric", "entity", "r.a", "r.m", "r.b", "r.common", F.explode("r.cells").alias("c")
    ).select("metric", "a", "m", "b", "entity", "common", "c.*")


def growth_movement(obs: DataFrame, requests: list[tuple[int, int | None, int]], *, rows_bound: int,
                    metrics: int = 20, slice_rows: int | None = None) -> DataFrame:
    """Observed and common growth ranks, outsiders above and below, and peer means, for all focuses.

    A request is (a, middle or None, b). Rows without growth keep their reason and carry the peer
    means of everyone else. ``metrics`` bounds the metrics present, which with the requests bounds the groups.
    """
    rows = interval_rows(obs, requests)
    valid = F.col("growth_reason").isNull()
    # Rows without growth rank after all others and lose that rank again below.
    rows = rank_rows(rows, GROUP, "growth", rank="_place", total="_all", rows_bound=rows_bound)
    rows = rows.withColumn("full_rank", F.when(valid, F.col("_place")))
    exact = F.col("growth").cast(EXACT)
    rows = group_facts(
        rows, GROUP,
        {
            "n_observed": F.count_if(valid),
            "n_common": F.count_if(valid & F.col("common")),
            "_sum": F.sum(exact),
            "_sum_common": F.sum(F.when(F.col("common"), exact)),
        },
        rows_bound=rows_bound, groups_bound=len(set(requests)) * 3 * metrics,
    )
    everyone = prefix_counts(rows, GROUP, "full_rank", {"_common": F.col("common")},
                             rows_bound=rows_bound, slice_rows=slice_rows)
    common = valid & F.col("common")
    growth = F.coalesce("growth", F.lit(0.0))
    peers = F.col("n_observed") - valid.cast("long")
    peers_common = F.col("n_common") - common.cast("long")
    mean = F.try_divide(F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)) - growth, peers)
    mean_common = F.try_divide(
        F.coalesce(F.col("_sum_common").cast("double"), F.lit(0.0)) - F.when(common, growth).otherwise(0.0), peers_common
    )
    outside_above = F.col("full_rank") - F.col("_common") - (~F.col("common")).cast("long")
    n_outside = F.col("n_observed") - F.col("n_common")
    reason = F.when(~valid, NO_GROWTH)
    vs_peer = F.when(valid, F.col("growth") - mean)
    vs_common = F.when(common, F.col("growth") - mean_common)
    middle = F.when(F.col("m") != NO_MIDDLE, F.col("m")).alias("m")
    return everyone.select(
        "metric", "a", middle, "b", "interval", "start", "end", "entity",
        F.when(F.col("common"), "common").otherwise("outside").alias("status"),
        "start_value", "end_value", "growth", "growth_reason",
        F.when(valid, F.col("end_value") - F.col("start_value")).alias("absolute_change"),
        "full_rank",
        F.when(common, F.col("_common")).alias("common_rank"),
        "n_observed", "n_common",
        outside_above.alias("outside_above"),
        F.when(valid, n_outside - outside_above).alias("outside_below"),
        mean.alias("peer_mean"),
        peers.alias("peer_count"),
        F.when(peers == 0, NO_PEERS).alias("peer_reason"),
        mean_common.alias("peer_mean_common"),
        peers_common.alias("peer_count_common"),
        F.when(peers_common == 0, NO_PEERS).alias("peer_reason_common"),
        vs_peer.alias("vs_peer"),
        F.when(vs_peer.isNull(), F.when(mean.isNull(), PEERS_UNAVAILABLE).otherwise(reason)).alias("vs_peer_reason"),
        vs_common.alias("vs_peer_common"),
        F.when(
            vs_common.isNull(), F.when(valid | mean_common.isNull(), PEERS_UNAVAILABLE).otherwise(reason)
        ).alias("vs_peer_common_reason"),
        reason.alias("reason"),
    )
