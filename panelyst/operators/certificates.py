"""Proof that given ranks are the ranks of an order, without ordering anything by value again.

A dense rank cuts its group into equal slices by arithmetic. Inside a slice, in the order of the claimed ranks, a rank
is right if it is one more than the one before it and the key does not rise (at equal keys the code does). The first
row of a slice must hold the rank that the slice begins with, and follows the last row of the slice before, which one
small row for each slice tells. If all rows hold, the ranks are 1 to n in the one right order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.operators.ordered import WINDOW_ROWS, _slice_rows


def certify(
    rows: DataFrame,
    keys: list[str],
    rank: str,
    key: Column,
    ok: str,
    counts: dict[str, Column] | None = None,
    *,
    rows_bound: int,
    slice_rows: int | None = None,
    entity: str = "entity",
) -> DataFrame:
    """``rows`` with ``ok``: whether a row's rank (high ``key`` first, then entity) follows from the row before it.

    Rows without a rank are ok; the caller compares who has one with who should. ``counts`` adds running counts of
    booleans along the ranks, from the same pass; they are right where all of a group's ranks are.
    """
    counts = counts or {}
    each = slice_rows or _slice_rows()
    sliced = rows_bound > WINDOW_ROWS or slice_rows is not None
    ranked = F.col(rank).isNotNull()
    salt = -1 - F.pmod(F.xxhash64(entity), F.lit(max(1, -(-rows_bound // each))))
    place = F.floor((F.col(rank) - 1) / each) if sliced else F.lit(0).cast("long")
    mark = F.struct(key.alias("k"), F.col(entity).alias("e"))
    marked = rows.withColumn("_slice", F.when(ranked, place).otherwise(salt)).withColumn("_mark", F.when(ranked, mark))
    marked = marked.select("*", *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_is_{n}") for n, c in counts.items()])
    along = Window.partitionBy(*keys, "_slice").orderBy(rank)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(
        "*", F.lag("_mark").over(along).alias("_before"), F.lag(rank).over(along).alias("_last"),
        *[F.sum(f"_is_{n}").over(upto).alias(f"_run_{n}") for n in counts],
    )
    if sliced:
        slices = Window.partitionBy(*keys).orderBy("_slice")
        sums = [F.sum(f"_is_{n}").alias(f"_sum_{n}") for n in counts]
        edges = marked.where(ranked).groupBy(*keys, "_slice").agg(F.max(rank).alias("_top"), F.max_by("_mark", rank).alias("_end"), *sums)
        edges = edges.select(
            *keys, "_slice", F.lag("_end").over(slices).alias("_end"), F.lag("_top").over(slices).alias("_top"),
            *[F.coalesce(F.sum(f"_sum_{n}").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{n}") for n in counts],
        )
        local = local.join(edges, [*keys, "_slice"], "left")
        first = F.col("_before").isNull()
        local = local.withColumns({
            "_before": F.when(first, F.col("_end")).otherwise(F.col("_before")), "_last": F.when(first, F.col("_top")).otherwise(F.col("_last")),
        })
        local = local.select("*", *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(f"_all_{n}") for n in counts])
    step = F.col(rank) == F.coalesce("_last", F.lit(0)) + 1
    falls = (F.col("_before.k") > F.col("_mark.k")) | ((F.col("_before.k") == F.col("_mark.k")) & (F.col("_before.e") < F.col("_mark.e")))
    right = step & (F.col("_before").isNull() | falls) & F.col("_mark.k").isNotNull()
    run = "_all_" if sliced else "_run_"
    return local.select(
        *rows.columns, F.when(ranked, F.coalesce(right, F.lit(False))).otherwise(F.lit(True)).alias(ok),
        *[F.when(ranked, F.col(f"{run}{n}")).alias(n) for n in counts],
    )
