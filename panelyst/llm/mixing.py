"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks. With integer weights that sum to W, the j-th block of a source with weight a is
released at slot floor((j - 1) * W / a) and due by slot ceil(j * W / a); giving each slot to the released block that
is due first keeps every source within less than one block of its share after every slot. The schedule repeats every
W slots, so it is computed for W slots only, whatever the number of rows.

Nothing is dropped: when a source runs out, the others go on by their weights, from then on relative to each other.
A phase is the stretch between two such moments.

Any number of sources may share the default weight. They are one stream whose weight is their sum; inside it every
round gives a block to each of them. A block then lies in the window that its own weight gives it, so the bound holds
for each of them too. The driver schedules the named sources only; where a pooled block stands in its stream is
arithmetic on the rank of its source.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce
from math import gcd

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelyst.functions.plan import plan_rows
from panelyst.llm.batches import temporary
from panelyst.session import written

BLOCK_ROWS = 16
#: Rows that one task numbers; larger sources are cut into hashed slices of about this many.
SLICE_ROWS = 4_000


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots, of as many as the weights' sum, that each source gets: earliest deadline first.

    >>> period({"a": 2, "b": 1})
    {'a': [0, 2], 'b': [1]}
    """
    total = sum(weights.values())
    waiting = [(0, s, 1) for s in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(slot)
        if j < weights[s]:
            heapq.heappush(waiting, (j * total // weights[s], s, j + 1))
    return slots


def shared_period(named: dict[str, int], pool: int) -> dict[str, list[int]]:
    """The slots of each named stream in a period that one more stream, of weight ``pool``, shares: that takes the others.

    The same schedule as ``period`` gives, but the pool's blocks are passed over in runs, so the work follows the named
    weights however heavy the pool is.

    >>> shared_period({"a": 1}, 3)
    {'a': [1]}
    """
    if not pool:
        return period(named)
    total = sum(named.values()) + pool
    waiting = [(0, s, 1) for s in sorted(named)]
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in named}
    slot, done = 0, 0  # slots so far, pool blocks so far
    heapq.heapify(waiting)
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // named[s]), s, j))
        upto = waiting[0][0] - slot if waiting else total  # until then nothing new is released
        if ready:
            # Pool blocks that are due before the first ready one, as far as each is released when its slot comes.
            before = ((ready[0][0] - 1) * pool) // total - done
            released = -(-((slot + 1) * pool - done * total) // (total - pool))
            upto = min(upto, before, released)
        if upto > 0:
            slot, done = slot + upto, done + upto
            continue
        _, s, j = heapq.heappop(ready)
        slots[s].append(slot)
        if j < named[s]:
            heapq.heappush(waiting, (j * total // named[s], s, j + 1))
        slot += 1
    return slots


#: The stream of all sources without a weight of their own.
POOL = ""


def rounds(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """For pooled sources by their number of blocks: ``first round, blocks before it, blocks in each round`` from there on.

    A round gives a block to every pooled source that has one left.

    >>> rounds({1: 2, 3: 1})
    [(0, 0, 3), (1, 3, 1)]
    """
    out, at, before, active = [], 0, 0, sum(sizes.values())
    for size in sorted(sizes):
        out.append((at, before, active))
        before += (size - at) * active
        at, active = size, active - sizes[size]
    return out


def phases(
    blocks: dict[str, int], weights: dict[str, int], pooled: dict[int, int] | None = None, default: int = 1
) -> list[tuple[str, int, int, int, int, list[int]]]:
    """``stream, first block, first slot, period length, blocks in a period, its slots``, for each phase and stream.

    ``pooled`` counts the sources of weight ``default`` by their blocks. They are one stream whose weight falls as they
    run out; its last column holds the slots that others take, each less the number of such slots before it.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    line = rounds(pooled or {})
    ends = [*(x[1] for x in line[1:]), sum(n * k for n, k in (pooled or {}).items())]
    at, pool_done, start, out = 0, 0, 0, []
    while left or at < len(line):
        heavy = default * line[at][2] if at < len(line) else 0
        common = reduce(gcd, [weights[s] for s in left], heavy)
        active, pool = {s: weights[s] // common for s in left}, heavy // common
        slots = shared_period(active, pool)
        total = sum(active.values()) + pool
        taken = sorted(x for own in slots.values() for x in own)
        gaps = [x - i for i, x in enumerate(taken)]
        stops = [(n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] + 1 for s, n in left.items()]
        if pool:
            last = ends[at] - pool_done - 1
            stops.append(last // pool * total + last % pool + bisect_right(gaps, last % pool) + 1)
        end = min(stops)
        for s in list(left):
            n = end // total * active[s] + bisect_left(slots[s], end % total)
            if n:
                out.append((s, done[s], start, total, active[s], slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        if pool:
            n = end // total * pool + end % total - bisect_left(taken, end % total)
            if n:
                out.append((POOL, pool_done, start, total, pool, gaps))
            pool_done += n
            at += pool_done == ends[at]
        start += end
    return out


def _last(line: Column, size: int, first: Callable[[Column], Column], at: Column) -> Column:
    """The last entry of a sorted array whose ``first`` is at most ``at``; halving steps, JVM-side."""
    steps = [1 << k for k in range(max(1, size).bit_length() - 1, -1, -1)]
    place = F.reduce(
        F.lit(steps), F.lit(0), lambda i, w: F.when((i + w < F.size(line)) & (first(F.get(line, i + w)) <= at), i + w).otherwise(i)
    )
    return F.get(line, place)


def _ranked(sources: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``sources`` numbered from 0 in order: one range partitioning and an offset for each of its tasks."""
    part, row = temporary("part"), temporary("row")
    numbered = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(numbered.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(row)))
    sizes = placed.groupBy(part).agg(F.count("*").alias("many"), F.min(row).alias("least"))
    before = F.sum("many").over(Window.orderBy(part)) - F.col("many") - F.col("least")
    return placed.join(sizes.select(part, before.alias(f"{row}o")), part).withColumn(rank, F.col(row) + F.col(f"{row}o")).drop(part, row, f"{row}o")


def _number(docs: DataFrame, key: str, number: str, rank: str, named: list[str], block_rows: int) -> tuple[DataFrame, dict[str, int], dict[int, int]]:
    """Rows of each key numbered from 0 in hashed order, and how many blocks there are.

    Pooled keys, all but the ``named``, also get their ``rank`` among them: those with more blocks first. No key is
    gathered in one task, and the driver gets a number for each named key and for each number of blocks that a pooled
    key has.
    """
    order, piece = temporary("order"), temporary("piece")
    counted = written(docs.groupBy(key).agg(F.ceil(F.count("*") / block_rows).alias("blocks"), F.count("*").alias("many")))
    pooled = counted.where(~F.col(key).isin(named))
    rows = {r[key]: r["blocks"] for r in counted.where(F.col(key).isin(named)).collect()}
    sizes_of = {r["blocks"]: r["sources"] for r in pooled.groupBy("blocks").agg(F.count("*").alias("sources")).collect()}
    most = counted.agg(F.max("many")).first()[0] or 0
    pieces = max(1, -(-most // SLICE_ROWS))
    # One number of slices for all sources: a small source then has small slices.
    hashed = docs.withColumn(order, F.xxhash64("doc_id", "text")).withColumn(piece, F.pmod(order, F.lit(pieces)))
    sizes = hashed.groupBy(key, piece).count()
    before = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    ranks = _ranked(pooled, [F.col("blocks").desc(), F.col(key)], rank).select(F.col(key).alias(f"{key}k"), rank)
    sizes = sizes.select(
        F.col(key).alias(f"{key}k"), F.col(piece).alias(f"{piece}k"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{number}o"),
    ).join(ranks, f"{key}k", "left")
    inside = Window.partitionBy(key, piece).orderBy(order, "doc_id")
    placed = hashed.withColumn(number, F.row_number().over(inside) - 1)
    joined = placed.join(sizes, (F.col(key) == F.col(f"{key}k")) & (F.col(piece) == F.col(f"{piece}k")))
    joined = joined.withColumn(number, (F.col(number) + F.col(f"{number}o")).cast("long"))
    return joined.drop(order, piece, f"{key}k", f"{piece}k", f"{number}o"), rows, sizes_of


def _key() -> Column:
    """Sources by name; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("?"))


def _scheduled(docs: DataFrame, weights: dict[str | None, int], default: int, block_rows: int):
    """``docs`` with temporary columns for the block and the position."""
    key, number, rank, block, slot = (temporary(n) for n in ("key", "number", "rank", "block", "slot"))
    if default < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    named = {"?" if s is None else f"={s}": w for s, w in weights.items()}
    numbered, blocks, pooled = _number(docs.withColumn(key, _key()), key, number, rank, list(named), block_rows)
    plan: dict[str, list] = {}
    for stream, *phase in phases(blocks, named, pooled, default):
        plan.setdefault(stream, []).append(tuple(phase))
    stream, line, at, here = (temporary(n) for n in ("stream", "line", "at", "here"))
    kind = "array<struct<first:long,start:long,total:long,each:long,slots:array<long>>>"
    # A row for each named source and the pool: its phases, as many as named sources and pooled sizes at most.
    table = docs.sparkSession.createDataFrame(list(plan.items()), f"{stream} string, {line} {kind}")
    # A pooled source's block stands in its round behind those of larger sources.
    each = [dict(zip(("first", "before", "active"), r, strict=True)) for r in rounds(pooled)]
    turn = plan_rows(each, "first long; before long; active long")
    own = F.floor(F.col(number) / block_rows)
    round_ = _last(turn, len(each), lambda x: x["first"], F.col(block))
    pool_at = round_["before"] + (F.col(block) - round_["first"]) * round_["active"] + F.col(rank)
    placed = numbered.withColumn(block, own).withColumns({
        stream: F.when(F.col(rank).isNull(), F.col(key)).otherwise(F.lit(POOL)),
        at: F.when(F.col(rank).isNull(), F.col(block)).otherwise(pool_at),
    })
    longest = max(map(len, plan.values()), default=1)
    joined = placed.join(F.broadcast(table), stream).withColumn(here, _last(F.col(line), longest, lambda x: x["first"], F.col(at)))
    within = F.col(at) - F.col(f"{here}.first")
    turn_at = F.pmod(within, F.col(f"{here}.each"))
    taken = F.size(F.filter(F.col(f"{here}.slots"), lambda x: x <= turn_at))
    in_period = F.when(F.col(stream) == POOL, turn_at + taken).otherwise(F.get(F.col(f"{here}.slots"), turn_at.cast("int")))
    joined = joined.withColumn(slot, F.col(f"{here}.start") + F.floor(within / F.col(f"{here}.each")) * F.col(f"{here}.total") + in_period)
    position = temporary("position")
    joined = joined.withColumn(position, F.col(slot) * block_rows + F.pmod(number, F.lit(block_rows)))
    return joined.drop(key, number, rank, stream, line, at, here), block, slot, position


def mix(
    docs: DataFrame, weights: dict[str | None, int], *, default: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``doc_id, source, block, slot, position`` for every row of ``docs``.

    ``weights`` are positive integers by source; others, and the null source, have ``default``. ``position`` orders
    all rows: slots in order, and rows inside a block. Only a source's last block may be short, so positions are
    distinct and ascend within a slot but have gaps. Rows of a source come in a hashed order; repeated rows get a
    place each. Null texts and ids are rows like others. No rows give no rows.
    """
    placed, block, slot, position = _scheduled(docs.select("doc_id", "source", "text"), weights, default, block_rows)
    return placed.select(
        "doc_id", "source", F.col(block).alias("block"), F.col(slot).alias("slot"), F.col(position).alias("position")
    )


def mixed(docs: DataFrame, weights: dict[str | None, int], *, default: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows and columns of ``docs`` in mixed order: partitions are ranges of positions, sorted inside.

    The placed rows are written once, since the ranges are sampled before the rows are dealt out. Nulls, repeated rows
    and empty tables as in ``mix``; other columns are carried, whatever their names.
    """
    placed, block, slot, position = _scheduled(docs, weights, default, block_rows)
    fixed = written(placed.drop(block, slot))
    return fixed.repartitionByRange(position).sortWithinPartitions(position).drop(position)


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of a Parquet table in the order in which its partitions were written, whatever order its files are read in.

    Partitions are ranges of that order, sorted inside. Rows that come from no Parquet file stay as they are.
    """
    part, name, row = (temporary(n) for n in ("part", "name", "row"))
    try:
        placed = docs.withColumns({name: F.col("_metadata.file_name"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        return docs
    placed = placed.withColumn(part, F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"))
    return placed.repartitionByRange(part, name, row).sortWithinPartitions(part, name, row).drop(part, name, row)
