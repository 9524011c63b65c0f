"""Ranks, prefix counts and group totals over ordered groups of any size.

A window over one (metric, year) would put that whole group into one task. The operators here take
that plan only while the largest group is known to be small. Beyond that they order the rows with a
range partitioning, work inside slices, and add each slice's offset:

* ``rank_rows``: the first ordering, by value. Slices are range partitions, fixed as a table.
* ``prefix_counts``: later orderings. A dense rank cuts itself into equal slices by arithmetic, so
  no sampling and no checkpoint is needed.
* ``group_facts``: aggregates of a group beside its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.session import written

# Rows one task may sort in a window, and rows a side may hold to be broadcast.
WINDOW_ROWS = 1_000_000
BROADCAST_ROWS = 200_000
# Exact sums: a decimal total does not depend on the order in which rows arrive.
EXACT = "decimal(38,10)"


def _slice_rows() -> int:
    """Rows one slice aims at: well below what a task may sort, so uneven slices still fit."""
    return max(1, WINDOW_ROWS // 4)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the biggest group: one aggregation, one number to the driver."""
    sizes = df.groupBy(*keys).count().agg(F.max("count").alias("rows"))
    return sizes.first()["rows"] or 0


def group_bound(df: DataFrame, keys: list[str], rows_bound: int | None) -> int:
    """An upper bound of the largest group: the caller's, or else measured. A given bound is never measured again."""
    return largest_group(df, keys) if rows_bound is None else rows_bound


def join_small(big: DataFrame, small: DataFrame, keys: list[str], bound: int | None, how: str = "left") -> DataFrame:
    """Broadcast ``small`` only when its row count is known to fit; else let the planner choose."""
    if bound is not None and bound <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, keys, how)


def _value(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _order(value: str | Column, direction: str) -> Column:
    return _value(value).asc() if direction == "ASC" else _value(value).desc()


def rank_rows(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    entity: str = "entity",
    *,
    direction: str = "DESC",
    competition: str | None = None,
    rank: str = "rank",
    total: str = "n",
    rows_bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Ordinal rank by value then entity, with the group's row count.

    ``competition`` names an extra column where ties share a rank and the next one skips. There is
    one row per entity and group. Values are finite or, ranking high to low, null: those come last. ``value`` is a
    column's name, or what is made of columns and not kept.
    """
    order = [_order(value, direction), F.col(entity).asc()]
    bound = group_bound(df, keys, rows_bound)
    if bound <= WINDOW_ROWS:
        group = Window.partitionBy(*keys)
        out = df.withColumn(rank, F.row_number().over(group.orderBy(*order)).cast("long"))
        if competition:
            out = out.withColumn(competition, F.rank().over(group.orderBy(order[0])).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(group))
    return _rank_by_range(df, keys, value, order, competition, rank, total, bound, slices)


def _rank_by_range(df, keys, value, order, competition, rank, total, bound, slices):
    spark = df.sparkSession
    # Range partitioning reads its input twice, once to sample; fix the input first. Its sorted slices are fixed too,
    # with each row's place, which every later branch relies on. Both as tables: columns pack well, and a branch reads
    # only its own.
    source = written(df)
    parts = slices or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // _slice_rows())
    )
    order = [F.col(k).asc() for k in keys] + order
    # This id is the partition's number above 33 bits and the row's place in it below.
    sliced = source.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sliced = written(sliced.withColumn("_id", F.monotonically_increasing_id()))
    sliced = sliced.select("*", F.shiftright("_id", 33).cast("int").alias("_slice"), F.expr("_id & 8589934591").alias("_place"))
    sliced = sliced.drop("_id")
    # At most slices + groups rows, since slices follow the order: they are broadcast.
    edges = sliced.groupBy("_slice", *keys).agg(
        F.min("_place").alias("_start"),
        F.count(F.lit(1)).alias("_rows"),
        *([F.min_by(value, "_place").alias("_first"), F.max_by(value, "_place").alias("_last")] if competition else []),
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    if competition:
        # Where the run of equal values that ends the slice begins in it.
        ends = _beside(sliced, edges.select("_slice", *keys, "_last"), ["_slice", *keys])
        ends = ends.where(_value(value).eqNullSafe(F.col("_last"))).groupBy("_slice", *keys).agg(F.min("_place").alias("_run_place"))
        edges = _beside(edges, ends, ["_slice", *keys])
    edges = edges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    edges = edges.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    edges = edges.withColumn("_offset", F.col("_before") - F.col("_start") + 1)
    found = ["_offset", total]
    if competition:
        edges = (
            # Nulls tie with each other, so every comparison of values here is null-safe.
            edges.withColumn("_joined", F.lag("_slice").over(along).isNotNull() & F.lag("_last").over(along).eqNullSafe(F.col("_first")))
            # Where the run of equal values that ends this slice began; null while one run goes on
            # through the whole slice.
            .withColumn(
                "_run",
                F.when(
                    ~(F.col("_joined") & F.col("_first").eqNullSafe(F.col("_last"))),
                    F.col("_offset") + F.col("_run_place"),
                ),
            )
            .withColumn(
                "_lead",
                F.when(F.col("_joined"), F.last("_run", ignorenulls=True).over(before)).otherwise(
                    F.col("_before") + 1
                ),
            )
        )
        found += ["_before", "_lead", "_first"]
        sliced = sliced.withColumn("_tie", F.rank().over(Window.partitionBy("_slice", *keys).orderBy(order[len(keys)])).cast("long"))
    out = _beside(sliced, edges.select("_slice", *keys, *found), ["_slice", *keys])
    out = out.withColumn(rank, F.col("_place") + F.col("_offset"))
    if competition:
        out = out.withColumn(
            competition,
            F.when(_value(value).eqNullSafe(F.col("_first")), F.col("_lead")).otherwise(
                F.col("_before") + F.col("_tie")
            ),
        )
    extra = [rank] + ([competition] if competition else []) + [total]
    return out.select(*df.columns, *extra)


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the one row of ``small`` of the same keys, null ones too."""
    named = small.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(named), reduce(lambda x, y: x & y, same)).drop(*[f"_of_{i}" for i in range(len(keys))])


def prefix_counts(
    df: DataFrame,
    keys: list[str],
    rank: str,
    counts: dict[str, Column],
    *,
    rows_bound: int,
    slice_rows: int | None = None,
    entity: str = "entity",
) -> DataFrame:
    """Running counts along a dense rank: rows of the group ranked at or above each row.

    ``counts`` maps an output column to the boolean it counts. Rows without a rank get null; they
    are spread over salted slices, whose number follows the group's size.
    """
    ranked = F.col(rank).isNotNull()
    names = list(counts)
    flagged = df.select("*", *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_is_{n}") for n, c in counts.items()])
    rows = slice_rows or _slice_rows()
    sliced = rows_bound > WINDOW_ROWS or slice_rows is not None
    # Rows without a rank need no order: as many slices as rows of that number would fill.
    salt = -1 - F.pmod(F.xxhash64(entity), F.lit(max(1, -(-rows_bound // rows))))
    place = F.floor((F.col(rank) - 1) / rows) if sliced else F.lit(0).cast("long")
    flagged = flagged.withColumn("_slice", F.when(ranked, place).otherwise(salt))
    running = Window.partitionBy(*keys, "_slice").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.select(
        "*", *[F.when(ranked, F.sum(f"_is_{n}").over(running)).alias(f"_run_{n}") for n in names]
    )
    if not sliced:
        return local.select(*df.columns, *[F.col(f"_run_{n}").alias(n) for n in names])
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        flagged.where(ranked)
        .groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_is_{n}").alias(f"_sum_{n}") for n in names])
        .select(*keys, "_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(along), F.lit(0)).alias(f"_off_{n}") for n in names])
    )
    joined = local.join(offsets, [*keys, "_slice"], "left")
    return joined.select(
        *df.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in names]
    )


def group_facts(df: DataFrame, keys: list[str], facts: dict[str, Column], *, rows_bound: int,
                groups_bound: int | None = None) -> DataFrame:
    """Aggregates of each group beside its rows. ``facts`` are plain aggregates, cast by the caller.

    Small groups take a window, which shares the partitioning of the ranks around it. Large ones take
    partial sums and a join to one small side, with the rows fixed first, as a table, because both branches read them.
    """
    if rows_bound <= WINDOW_ROWS:
        group = Window.partitionBy(*keys)
        return df.select("*", *[c.over(group).alias(n) for n, c in facts.items()])
    fixed = written(df)
    small = fixed.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()])
    return join_small(fixed, small, keys, groups_bound)
