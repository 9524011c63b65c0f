"""Ranks of a few rows among many by counting, without ordering the many.

The few are thresholds. Each of the other rows finds by binary search how many thresholds of its group stand before
it, and adds one to that place of the group's histogram. Partial histograms are as small as the thresholds, so all that
a partition sends is at most twice as many counts as there are thresholds. The rank of a threshold is a prefix sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.operators.ordered import BROADCAST_ROWS, rank_rows


def _upto(line: Column, longest: int, before: Callable[[Column], Column]) -> Column:
    """How many of a sorted array's first entries satisfy ``before``: halving steps from the largest power of two."""
    steps = [1 << k for k in range(max(1, longest).bit_length() - 1, -1, -1)]

    def step(at: Column, width: Column) -> Column:
        further = at + width
        return F.when((further <= F.size(line)) & before(F.get(line, further - 1)), further).otherwise(at)

    return F.reduce(F.lit(steps), F.lit(0), step)


def place(
    rows: DataFrame,
    few: DataFrame,
    keys: list[str],
    value: str,
    entity: str = "entity",
    *,
    few_bound: int | None = None,
    group_bound: int | None = None,
    rank: str = "rank",
    competition: str | None = None,
    total: str = "n",
    rows_bound: int | None = None,
) -> DataFrame:
    """``few`` (some of ``rows``) with their ordinal rank by ``value`` (high first, then entity) and the group's size.

    ``competition`` names an extra column where ties share a rank. There is one row per entity and group in both;
    values are finite. ``few_bound`` bounds the rows of ``few``, which are counted without it; up to BROADCAST_ROWS
    thresholds are broadcast, more are ranked with all the others by ``rank_rows``. ``group_bound`` bounds those of one
    group and so the steps of a search.
    """
    bound = few.count() if few_bound is None else few_bound
    longest = bound if group_bound is None else min(bound, group_bound)
    if bound > BROADCAST_ROWS:
        ranked = rank_rows(rows, keys, value, entity, rank=rank, competition=competition, total=total, rows_bound=rows_bound)
        found = [rank, *([competition] if competition else []), total]
        return few.join(ranked.select(*keys, entity, *found), [*keys, entity]).select(*few.columns, *found)
    # Sorted as ranks go: negated values ascend, equal ones by entity.
    mark = F.struct((-F.col(value)).alias("v"), F.col(entity).alias("e"))
    lines = few.groupBy(*keys).agg(F.array_sort(F.collect_list(mark)).alias("_line"))
    laid = rows.select(*keys, (-F.col(value)).alias("_v"), F.col(entity).alias("_e")).join(F.broadcast(lines), keys)
    own, code = F.col("_v"), F.col("_e")
    places = {"_ahead": _upto(F.col("_line"), longest, lambda t: (t["v"] < own) | ((t["v"] == own) & (t["e"] <= code)))}
    mine = {"_ahead": F.array_position("_line", mark).cast("int") - 1}
    if competition:
        places["_tied"] = _upto(F.col("_line"), longest, lambda t: t["v"] <= own)
        mine["_tied"] = F.size(F.filter("_line", lambda t: t["v"] < -F.col(value)))
    counts = laid.groupBy(*keys, *[c.alias(n) for n, c in places.items()]).agg(F.count(F.lit(1)).alias("_rows"))
    # Thresholds beside the counts, all as few as the thresholds: a rank adds up the counts before its own place.
    kept = few.join(lines, keys).select(*few.columns, *[c.alias(n) for n, c in mine.items()], F.lit(True).alias("_mine"))
    both = kept.unionByName(counts, allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    for name, at in ((rank, "_ahead"), (competition, "_tied")):
        if name:
            upto = group.orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
            both = both.withColumn(name, F.coalesce(F.sum("_rows").over(upto), F.lit(0)) + 1)
    both = both.withColumn(total, F.sum("_rows").over(group)).where("_mine")
    return both.select(*few.columns, rank, *([competition] if competition else []), total)
