"""The frozen comparison universe: candidates, complete and reference members, with a ledger of why
each excluded entity is out. Members are rows; a set is never gathered into one list."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelyst.functions.hashing import MASK, OFFSET_BASIS, PRIME
from panelyst.functions.plan import plan_map, plan_rows
from panelyst.functions.transforms import finite
from panelyst.operators.presence import held_count, masks, missing_count, patterns, presence, years_not_held

# fixed values: ledger reasons
PARTICIPANT = "comparison_participant"
MISSING_YEARS = "missing_required_observation"


@dataclass(frozen=True)
class UniversePlan:
    key: str
    metric: str
    years: tuple[int, ...]


def participants_frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(plan, entity, role) rows; an entity in two roles gets the merged one."""
    df = spark.createDataFrame(rows, "plan string, entity string, role string")
    roles = F.collect_set("role")
    merged = F.when(F.size(roles) > 1, "entity_and_group_member").otherwise(F.get(roles, F.lit(0)))
    return df.groupBy("plan", "entity").agg(merged.alias("role"))


def _masked(plans: list[UniversePlan], span: list[int]) -> Column:
    """The plans of each metric, with the required years as bits."""
    by_metric: dict[str, list[dict]] = {}
    for p in plans:
        required = sorted(set(p.years))
        by_metric.setdefault(p.metric, []).append({"plan": p.key, "required": required, "mask": masks(span, required)})
    return plan_map(by_metric, "plan string; required array<int>; mask array<bigint>")


def _span(plans: list[UniversePlan]) -> list[int]:
    return sorted({y for p in plans for y in p.years})


def _held(obs: DataFrame, plans: list[UniversePlan]) -> DataFrame:
    return presence(obs, sorted({p.metric for p in plans}), _span(plans))


def universe(obs: DataFrame, plans: list[UniversePlan], participants: DataFrame) -> DataFrame:
    """One row per plan and entity that is a candidate or a participant.

    ``obs`` holds eligible rows. A candidate holds any required year, a complete member all of them, and
    the reference set is the complete members that take no part in the comparison. The panel is read once, into
    bits; every plan is a mask on them.
    """
    laid = _held(obs, plans).select("*", F.explode(F.try_element_at(_masked(plans, _span(plans)), F.col("metric"))).alias("p"))
    seen = laid.where(held_count(F.col("words"), F.col("p.mask")) > 0).select(
        F.col("p.plan").alias("plan"), "entity", F.lit(True).alias("seen"),
        years_not_held(F.col("words"), F.col("p.required"), _span(plans)[0]).alias("missing_years"),
    )
    joined = seen.join(participants, ["plan", "entity"], "full")
    candidate = F.col("seen").isNotNull()
    complete = candidate & (F.size("missing_years") == 0)
    taking_part = F.col("role").isNotNull()
    incomplete = candidate & ~complete
    return joined.select(
        "plan", "entity",
        candidate.alias("candidate"),
        complete.alias("complete"),
        (complete & ~taking_part).alias("reference"),
        "role",
        F.array_compact(F.array(
            F.when(taking_part, PARTICIPANT), F.when(incomplete, MISSING_YEARS)
        )).alias("reasons"),
        F.when(incomplete, F.col("missing_years")).otherwise(F.array().cast("array<int>")).alias("missing_years"),
    )


def universe_sizes(obs: DataFrame, plans: list[UniversePlan], participants: DataFrame) -> DataFrame:
    """``universe_counts`` of any number of plans without a row for each entity and plan.

    Plans meet the distinct patterns of years held; only participants are looked up by entity. Every plan has a row,
    also one without candidates.
    """
    held = _held(obs, plans)
    layout = _masked(plans, _span(plans))
    of_metric = F.explode(F.try_element_at(layout, F.col("metric"))).alias("p")
    got, lacks = held_count(F.col("words"), F.col("p.mask")), missing_count(F.col("words"), F.col("p.mask"))
    candidate, complete = got > 0, (got > 0) & (lacks == 0)

    def counted(condition: Column, times: Column = F.lit(1)) -> Column:
        return F.sum(F.when(condition, times * F.col("entities")).otherwise(0))

    everyone = patterns(held).select("words", "entities", of_metric).groupBy(F.col("p.plan").alias("plan")).agg(
        counted(candidate).alias("candidates"), counted(complete).alias("complete"),
        counted(candidate, lacks).alias("missing_observations"),
    )
    metrics = plan_rows([{"plan": p.key, "metric": p.metric} for p in plans], "plan string; metric string")
    wanted = participants.sparkSession.range(1).select(F.inline(metrics))
    asked = participants.groupBy("plan", "entity").agg(F.max("role").alias("role")).join(wanted, "plan")
    roles = asked.join(held, ["metric", "entity"], "left").select(
        "plan", F.explode(F.filter(F.try_element_at(layout, F.col("metric")), lambda p: p["plan"] == F.col("plan"))).alias("p"),
        "words",
    ).groupBy("plan").agg(
        F.count("*").alias("participants"),
        F.count_if(F.coalesce(complete, F.lit(False))).alias("_complete"),
        F.count_if(F.coalesce(candidate & ~complete, F.lit(False))).alias("_incomplete"),
    )
    rows = wanted.join(everyone, "plan", "left").join(roles, "plan", "left").na.fill(0)
    incomplete = F.col("candidates") - F.col("complete")
    return rows.select(
        "plan", "metric", "candidates", "complete", (F.col("complete") - F.col("_complete")).alias("reference"),
        (F.col("participants") + incomplete - F.col("_incomplete")).alias("excluded"), "participants",
        incomplete.alias("incomplete"), "missing_observations",
    )


def ledger(members: DataFrame) -> DataFrame:
    """Excluded entities, each once with every reason."""
    return members.where(F.size("reasons") > 0).select("plan", "entity", "role", "complete", "reasons", "missing_years")


def missing_pairs(members: DataFrame) -> DataFrame:
    """Every missing entity and year."""
    return members.select("plan", "entity", F.explode("missing_years").alias("year"))


def universe_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("plan").agg(
        F.count_if("candidate").alias("candidates"),
        F.count_if("complete").alias("complete"),
        F.count_if("reference").alias("reference"),
        F.count_if(F.size("reasons") > 0).alias("excluded"),
        F.count_if(F.col("role").isNotNull()).alias("participants"),
        F.count_if(F.col("candidate") & ~F.col("complete")).alias("incomplete"),
        F.sum(F.size("missing_years")).alias("missing_observations"),
    )


# --- membership hash of a set of any size -----------------------------------------------------------
# The fold's functions travel with the plan: executors need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024
FANOUT = 64


def _chunk_maps(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes' bytes as affine maps, one for each CHUNK bytes: factors, and offsets for each incoming low byte.

    FNV-1a mixes a byte into the low eight bits and multiplies. For a given incoming low byte a run of bytes is
    therefore one affine map, h -> h * P**n + c. All chunks are folded together, one byte position at a time.
    """
    data = (np.frombuffer("".join(f"{c}," for c in codes).encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFF).astype(np.uint64)
    count = -(-len(data) // CHUNK)
    rows = np.zeros((count, CHUNK), np.uint64)
    rows.ravel()[: len(data)] = data
    sizes = np.full(count, CHUNK)
    sizes[-1] = len(data) - (count - 1) * CHUNK
    low = np.arange(256, dtype=np.uint64)
    state = np.repeat(low[None, :], count, axis=0)
    for at in range(CHUNK):
        live = count if at < sizes[-1] else count - 1
        state[:live] = ((state[:live] ^ rows[:live, at, None]) * np.uint64(PRIME)) & np.uint64(MASK)
    factors = np.array([pow(PRIME, int(n), 1 << 32) for n in sizes], np.uint64)
    return factors, (state - low * factors[:, None]) & np.uint64(MASK)


def _composed(factors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps applied one after the other as one map; pairs are joined until one is left."""
    low = np.arange(256, dtype=np.uint64)
    while len(factors) > 1:
        if len(factors) % 2:
            factors = np.append(factors, np.uint64(1))
            offsets = np.concatenate([offsets, np.zeros((1, 256), np.uint64)])
        f, g = factors[::2, None], factors[1::2, None]
        first, second = offsets[::2], offsets[1::2]
        # The low byte that reaches the second map depends on the incoming low byte alone.
        reached = ((low * f + first) & np.uint64(255)).astype(np.int64)
        offsets = (first * g + np.take_along_axis(second, reached, axis=1)) & np.uint64(MASK)
        factors = (f * g & np.uint64(MASK))[:, 0]
    return factors, offsets


def _slice_tables(group: str, code: str):
    """Fold each partition's sorted codes of each group into one map."""
    def fold(batches):
        import pandas as pd

        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        partition = None
        for batch in batches:
            if len(batch):
                partition = batch["_part"].iloc[0]
            for key, codes in batch.groupby(group, sort=False, dropna=False)[code]:
                done = _composed(*_chunk_maps(codes.tolist()))
                if key in held:
                    done = _composed(*(np.concatenate(x) for x in zip(held[key], done)))
                held[key] = done
        rows = [(k, partition, int(f[0]), o[0].astype(np.int64).tolist()) for k, (f, o) in held.items()]
        yield pd.DataFrame(rows, columns=[group, "part", "power", "offsets"])

    return fold


def _joined_tables(group: str):
    """Maps of neighbouring slices as one map."""
    def join(rows):
        rows = rows.sort_values("part")
        f, o = _composed(rows["power"].to_numpy(np.uint64), np.stack(rows["offsets"].to_list()).astype(np.uint64))
        out = rows.iloc[:1].copy()
        out["part"], out["power"], out["offsets"] = out["part"] // FANOUT, [int(f[0])], [o[0].astype(np.int64).tolist()]
        return out[[group, "part", "power", "offsets"]]

    return join


def membership_hashes(members: DataFrame, group: str, where: Column, slices: int | None = None,
                      code: str = "entity") -> DataFrame:
    """``fnv1a32`` of each group's sorted members: independent of row order and of partitioning.

    Members are range-partitioned and folded slice by slice, each slice in chunks that advance together; the
    slices' maps are composed in order, in a tree.
    """
    chosen = members.where(where).select(F.col(group).cast("string").alias(group), code)
    spark = members.sparkSession
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = chosen.repartitionByRange(parts, group, code).sortWithinPartitions(group, code)
    schema = f"{group} string, part int, power long, offsets array<long>"
    tables = ordered.withColumn("_part", F.spark_partition_id()).mapInPandas(_slice_tables(group, code), schema)
    while parts > FANOUT:  # a tree: no task and no row ever holds more than FANOUT slices of a group
        tables = tables.groupBy(group, F.floor(F.col("part") / FANOUT)).applyInPandas(_joined_tables(group), schema)
        parts = -(-parts // FANOUT)
    steps = F.array_sort(F.collect_list(F.struct("part", "power", "offsets")))
    value = F.reduce(
        steps,
        F.lit(OFFSET_BASIS).cast("long"),
        # h * power can pass 2**63, so the high and low halves of h are multiplied apart.
        lambda h, s: (
            (F.shiftright(h, 16) * s["power"]).bitwiseAND(F.lit(0xFFFF)) * 65536
            + h.bitwiseAND(F.lit(0xFFFF)) * s["power"]
            + F.get(s["offsets"], h.bitwiseAND(F.lit(255)).cast("int"))
        ).bitwiseAND(F.lit(MASK)),
    )
    text = F.concat(F.lit("fnv1a32:"), F.lpad(F.lower(F.hex(value)), 8, "0"))
    return tables.groupBy(group).agg(text.alias("membership_hash"))


def overlap_members(pairs: DataFrame) -> DataFrame:
    """Every member of either group of a pair once: ``shared``, ``only_a`` or ``only_b``."""
    sides = pairs.groupBy("pair", "member").agg(
        F.bool_or(F.col("slot") == "a").alias("_a"), F.bool_or(F.col("slot") == "b").alias("_b")
    )
    side = F.when(F.col("_a") & F.col("_b"), "shared").when(F.col("_a"), "only_a").otherwise("only_b")
    return sides.select("pair", "member", side.alias("side"))


def align_series(points: DataFrame, keys: list[str], group: list[str], series: str = "series") -> DataFrame:
    """Several year-keyed series side by side: a row for each year that any of ``keys`` has, gaps null.

    Column ``s0`` belongs to the first key, and so on. Values that are not finite are gaps.
    """
    value = F.when(finite(F.col("value")), F.col("value"))
    return points.where(F.col(series).isin(keys)).groupBy(*group, "year").agg(
        *[F.max(F.when(F.col(series) == k, value)).alias(f"s{i}") for i, k in enumerate(keys)]
    )


def overlap(pairs: DataFrame) -> DataFrame:
    """Shared and own members of two groups, with nesting. Input: (pair, slot, member) rows."""
    sides = pairs.groupBy("pair", "member").agg(
        F.bool_or(F.col("slot") == "a").alias("in_a"), F.bool_or(F.col("slot") == "b").alias("in_b")
    )
    counts = sides.groupBy("pair").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
    )
    shared, only_a, only_b = F.col("shared"), F.col("only_a"), F.col("only_b")
    nested = (
        F.when(shared == 0, F.lit(None).cast("string"))
        .when((only_b == 0) & (only_a > 0), "a_contains_b")
        .when((only_a == 0) & (only_b > 0), "b_contains_a")
        .when((only_a == 0) & (only_b == 0), "identical")
    )
    return counts.withColumn("nested", nested)
