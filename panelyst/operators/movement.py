"""Rank movement between two or three years, for every entity and every requested pair at once.

A rank change splits exactly into like-for-like movement and population entry and exit:

    F_B - F_A = (K_B - K_A) + entered_above_B - exited_above_A

F ranks the whole year, K ranks only the entities present in all compared years. The comparator is
row-local, so K is the count of common entities at or above a row in the full order. The counts of all
requests run along the ranks of a year at once; no (focus, other) pair is built.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyst.functions.plan import plan_rows
from panelyst.operators import ordered
from panelyst.operators.ordered import group_bound, join_small, rank_rows
from panelyst.operators.presence import BITS, masks, word_count
from panelyst.session import written

# Rows of entities x requests that one task lays out.
LAID_ROWS = 250_000
SIDES_TWO = ("a", "b")
SIDES_THREE = ("a", "m", "b")
MISSING_TWO = {"a": "focus_missing_in_yearA", "b": "focus_missing_in_yearB", "both": "focus_missing_in_both_years"}
MISSING_YOY = {
    "a": "no_valid_yoy_pair_in_period_A",
    "b": "no_valid_yoy_pair_in_period_B",
    "both": "no_valid_yoy_pair_in_either_period",
}


def year_pairs(years: list[int]) -> list[tuple[int, int]]:
    years = sorted(set(years))
    return [(a, b) for i, a in enumerate(years) for b in years[i + 1:]]


def year_triples(years: list[int]) -> list[tuple[int, int, int]]:
    """Every triple with the middle year strictly between."""
    return [(a, m, b) for a, b in year_pairs(years) for m in sorted(set(years)) if a < m < b]


def _checked(requests: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    for years in requests:
        if any(later <= earlier for earlier, later in zip(years, years[1:])):
            raise ValueError("INVALID_YEAR_ORDER")
    return sorted(set(requests))


def _asked(requests: list[tuple[int, ...]]) -> dict[int, list[tuple[int, ...]]]:
    """The requests that each year takes part in."""
    years = sorted({y for request in requests for y in request}) or [0]  # no request: a year that nothing takes part in
    return {y: [r for r in requests if y in r] for y in years}


def request_plan(requests: list[tuple[int, ...]], sides: tuple[str, ...]) -> Column:
    """A struct for each request: its number, its years, and its place among the requests of each of them."""
    asked = _asked(requests)
    rows = [
        {"request": n} | dict(zip(sides, r)) | {f"at_{s}": asked[y].index(r) for s, y in zip(sides, r)}
        for n, r in enumerate(requests)
    ]
    return plan_rows(rows, "; ".join(["request int", *(f"{s} int" for s in sides), *(f"at_{s} int" for s in sides)]))


def year_words(span: list[int], where: Column) -> list[Column]:
    """Aggregates: the years of ``span`` whose rows satisfy ``where``, as bits."""
    first = min(span)
    bit = F.expr(f"shiftleft(1L, cast(pmod(year - {first}, {BITS}) as int))")
    word = F.floor((F.col("year") - first) / BITS)
    none = F.lit(0).cast("long")
    return [F.bit_or(F.when(where & (word == w), bit).otherwise(none)) for w in range(word_count(span))]


def holds_all(words: list[str], required: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(w).bitwiseAND(r) == r for w, r in zip(words, required)])


def beside_years(rows: DataFrame, requests: list[tuple[int, ...]], rows_bound: int) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` (metric, entity, year ...) with the years each entity holds, and for each place among a year's requests
    whether the entity holds all years of the request there.

    Rows of large groups are fixed, because what counts along them reads them twice.
    """
    asked = _asked(requests)
    span = list(asked)
    words = [f"_years_{w}" for w in range(word_count(span))]
    entity = Window.partitionBy("metric", "entity")
    held = rows.select("*", *[c.over(entity).alias(w) for w, c in zip(words, year_words(span, F.lit(True)))])
    if rows_bound > ordered.WINDOW_ROWS:
        held = written(held)
    at = F.col("year").cast("int") - min(span)
    every = range(min(span), max(span) + 1)
    complete = {}
    for place in range(max(1, *map(len, asked.values()))):
        required = [masks(span, asked[y][place]) if place < len(asked.get(y, ())) else None for y in every]
        lines = [F.from_json(F.lit(json.dumps([m and m[w] for m in required])), "array<bigint>") for w in range(len(words))]
        complete[f"_all_{place}"] = holds_all(words, [F.get(line, at) for line in lines])
    return held, complete


def laid_parts(rows: DataFrame, requests: int, rows_bound: int, metrics: int) -> int:
    """Partitions of entities such that a task lays out about LAID_ROWS rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows_bound * requests * metrics // LAID_ROWS))


def by_entity(rows: DataFrame, complete: dict[str, Column], fields: list[str], rows_bound: int, parts: int,
              *kept: str) -> DataFrame:
    """One row per metric and entity: ``_seen``, a map from its years to ``fields`` and ``upto``, the running counts
    of ``complete`` at the entity's rank in that year; beside it the columns ``kept``, alike in all of an entity's rows."""
    kind = "int" if rows_bound < 2**31 else "long"
    upto = F.array(*[F.col(c).cast(kind) for c in complete]).alias("upto")
    entry = F.struct(F.col("year"), F.struct(*fields, upto)).alias("_entry")
    dealt = rows.select("metric", "entity", entry, *kept).repartition(parts, "metric", "entity")
    return dealt.groupBy("metric", "entity").agg(
        F.map_from_entries(F.collect_list("_entry")).alias("_seen"), *[F.max(c).alias(c) for c in kept]
    )


def _totals(held: DataFrame, plan: Column, requests: list[tuple[int, ...]], sides: tuple[str, ...],
            counts: dict[str, Column]) -> DataFrame:
    """Population counts of each metric and request. Entities that hold the same years count alike, so each pattern of
    years is laid out once, not each entity."""
    span = list(_asked(requests))
    size = word_count(span)
    words, ranked = [f"_years_{w}" for w in range(size)], [f"_ranked_{w}" for w in range(size)]
    each = held.groupBy("metric", "entity").agg(
        *[F.max(w).alias(w) for w in words],
        *[c.alias(r) for r, c in zip(ranked, year_words(span, F.col("rank").isNotNull()))],
    )
    patterns = each.groupBy("metric", *words, *ranked).agg(F.count(F.lit(1)).alias("_entities"))
    laid = patterns.select("*", F.explode(plan).alias("_plan"))

    def there(prefix, side):
        place = F.col("_plan")[side] - min(span)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(BITS)).cast("int"))
        word = F.get(F.array(*[f"{prefix}{w}" for w in range(size)]), F.floor(place / BITS).cast("int"))
        return word.bitwiseAND(bit) != 0

    present = [there("_years_", s) for s in sides]
    laid = laid.where(reduce(lambda x, y: x | y, present)).withColumn("common", reduce(lambda x, y: x & y, present))
    laid = laid.withColumns({f"rank_{s}": F.when(there("_ranked_", s), F.lit(1)) for s in sides})
    added = [F.coalesce(F.sum(F.when(c, F.col("_entities"))), F.lit(0)).alias(n) for n, c in counts.items()]
    return laid.groupBy(F.col("metric").alias("_of"), F.col("_plan.request").alias("_request")).agg(*added)


def align(ranked: DataFrame, requests: list[tuple[int, ...]], sides: tuple[str, ...], counts: dict[str, Column], *,
          rows_bound: int, metrics: int, key: str = "value", carry: tuple[str, ...] = (),
          slice_rows: int | None = None, fixed: bool = False) -> DataFrame:
    """One row per (metric, request, entity) seen in any of its years, a column set per side, with the request's
    ``counts`` and how many common entities stand at or above the row (``_common_a`` ...).

    All that is counted is counted in the panel itself, a row per entity and year, and comes back to the entity in its
    map of years, which is bounded by the years asked for. Requests are laid out from that map in the end, so that
    nothing as large as entities x requests is ordered, shuffled or stored. With ``fixed`` the maps are a table: all
    that reads the result reads the same rows.
    """
    requests = _checked(requests)
    plan = request_plan(requests, sides)
    wanted = sorted({y for years in requests for y in years})
    narrow = ranked.where(F.col("year").isin(wanted)).select("metric", "entity", "year", F.col(key).alias("key"), "rank", *carry)
    held, complete = beside_years(narrow, requests, rows_bound)
    totals = _totals(held, plan, requests, sides, counts)
    counted = ordered.prefix_counts(held, ["metric", "year"], "rank", complete, rows_bound=rows_bound, slice_rows=slice_rows)
    parts = laid_parts(ranked, len(requests), rows_bound, metrics)
    seen = by_entity(counted, complete, ["key", "rank", *carry], rows_bound, parts)
    if fixed:
        seen, totals = written(seen).repartition(parts, "metric", "entity"), written(totals)
    laid = seen.select("metric", "entity", "_seen", F.explode(plan).alias("_plan"))
    for side in sides:
        laid = laid.withColumn(f"_{side}", F.try_element_at("_seen", F.col("_plan")[side]))
    columns = [F.col("_plan")[s].alias(s) for s in sides]
    for side in sides:
        columns += [
            F.col(f"_{side}.{field}").alias(f"{field}_{side}") for field in ("key", "rank", *carry)
        ]
        columns.append(F.get(F.col(f"_{side}.upto"), F.col("_plan")[f"at_{side}"]).cast("long").alias(f"_common_{side}"))
    present = [F.col(f"_{s}").isNotNull() for s in sides]
    any_present, all_present = present[0], present[0]
    for p in present[1:]:
        any_present, all_present = any_present | p, all_present & p
    laid = laid.where(any_present).select("metric", "entity", all_present.alias("common"), F.col("_plan.request").alias("request"), *columns)
    small = F.broadcast(totals) if len(requests) * metrics <= ordered.BROADCAST_ROWS else totals
    same = F.col("metric").eqNullSafe(F.col("_of")) & (F.col("request") == F.col("_request"))
    return laid.join(small, same, "left").drop("_of", "_request", "request")


def two_year(ranked: DataFrame, pairs: list[tuple[int, int]], *, rows_bound: int, metrics: int = 20,
             key: str = "value", reasons: dict[str, str] = MISSING_TWO, carry: tuple[str, ...] = (),
             slice_rows: int | None = None, fixed: bool = False) -> DataFrame:
    """Movement of every entity over every pair.

    Entities missing a year get a reason instead of a decomposition; a rank they do hold stays.
    ``metrics`` bounds the metrics present, which with the pairs bounds the totals table. ``fixed`` is that of ``align``.
    """
    status = F.when(F.col("common"), "common").when(F.col("rank_b").isNull(), "exited").otherwise("entered")
    counts = {
        "n_a": F.col("rank_a").isNotNull(),
        "n_b": F.col("rank_b").isNotNull(),
        "n_common": F.col("common"),
        "n_exited": status == "exited",
        "n_entered": status == "entered",
    }
    rows = align(ranked, pairs, SIDES_TWO, counts, rows_bound=rows_bound, metrics=metrics, key=key, carry=carry,
                 slice_rows=slice_rows, fixed=fixed)
    rows = rows.withColumn("status", status)
    status = F.col("status")
    common = F.col("common")
    exited_above = F.col("rank_a") - F.col("_common_a")
    entered_above = F.col("rank_b") - F.col("_common_b")
    change = F.col("rank_b") - F.col("rank_a")
    effect = F.col("_common_b") - F.col("_common_a")
    both = {
        "common_rank_a": F.col("_common_a"),
        "common_rank_b": F.col("_common_b"),
        "exited_above": exited_above,
        "exited_below": F.col("n_exited") - exited_above,
        "entered_above": entered_above,
        "entered_below": F.col("n_entered") - entered_above,
        "position_change": change,
        "common_effect": effect,
        "set_effect": change - effect,
        "places_gained": -change,
    }
    carried = [f"{c}_{s}" for s in SIDES_TWO for c in carry]
    return rows.select(
        "metric", "a", "b", "entity", "status", "key_a", "key_b", "rank_a", "rank_b", *carried,
        "n_a", "n_b", "n_common", "n_exited", "n_entered",
        *[F.when(common, c).alias(n) for n, c in both.items()],
        F.when(status == "entered", reasons["a"]).when(status == "exited", reasons["b"]).alias("reason"),
    )


def two_year_yoy(yoy_ranked: DataFrame, pairs: list[tuple[int, int]], **options) -> DataFrame:
    """The same movement where each year's population is its valid growth pairs."""
    return two_year(yoy_ranked, pairs, key="yoy", reasons=MISSING_YOY, **options)


def three_year(ranked: DataFrame, triples: list[tuple[int, int, int]], *, rows_bound: int,
               metrics: int = 20, key: str = "value", slice_rows: int | None = None, fixed: bool = False) -> DataFrame:
    """Movement through a middle year over one universe common to all three."""
    outside = ~F.col("common")
    counts = {f"n_{s}": F.col(f"rank_{s}").isNotNull() for s in SIDES_THREE}
    counts |= {"n_common": F.col("common"), "n_outside": outside}
    counts |= {f"n_outside_{s}": outside & F.col(f"rank_{s}").isNotNull() for s in SIDES_THREE}
    rows = align(ranked, triples, SIDES_THREE, counts, rows_bound=rows_bound, metrics=metrics, key=key,
                 slice_rows=slice_rows, fixed=fixed)
    common = F.col("common")
    parts: dict[str, Column] = {f"common_rank_{s}": F.col(f"_common_{s}") for s in SIDES_THREE}
    for s in SIDES_THREE:
        above = F.col(f"rank_{s}") - F.col(f"_common_{s}")
        parts[f"outside_above_{s}"] = above
        parts[f"outside_below_{s}"] = F.col(f"n_outside_{s}") - above
    for name, s, e in (("am", "a", "m"), ("mb", "m", "b"), ("ab", "a", "b")):
        change = F.col(f"rank_{e}") - F.col(f"rank_{s}")
        effect = F.col(f"_common_{e}") - F.col(f"_common_{s}")
        parts[f"position_change_{name}"] = change
        parts[f"common_effect_{name}"] = effect
        parts[f"set_effect_{name}"] = change - effect
        parts[f"places_gained_{name}"] = -change
    missing = [F.col(f"rank_{s}").isNull() for s in SIDES_THREE]
    missing_count = sum((c.cast("int") for c in missing[1:]), missing[0].cast("int"))
    reason = (
        F.when(missing_count == 0, F.lit(None).cast("string"))
        .when(missing_count == 3, "focus_missing_in_both_years")
        .when(missing_count > 1, "focus_missing_in_multiple_years")
        .when(missing[0], "focus_missing_in_yearA")
        .when(missing[1], "focus_missing_in_yearMid")
        .otherwise("focus_missing_in_yearB")
    )
    return rows.select(
        "metric", *SIDES_THREE, "entity",
        F.when(common, "common").otherwise("outside").alias("status"),
        *[f"key_{s}" for s in SIDES_THREE], *[f"rank_{s}" for s in SIDES_THREE],
        *counts, *[F.when(common, c).alias(n) for n, c in parts.items()], reason.alias("reason"),
    )


# --- rows seen from chosen focus entities --------------------------------------------------------
def relation(rank: Column, focus_rank: Column, is_focus: Column) -> Column:
    return (
        F.when(rank.isNull() | focus_rank.isNull(), "unknown")
        .when(is_focus, "focus")
        .when(rank < focus_rank, "above")
        .otherwise("below")
    )


def relations(movement: DataFrame, focuses: list[str], sides: tuple[str, ...] = SIDES_TWO,
              groups_bound: int = 10_000) -> DataFrame:
    """Each row beside each chosen focus: above or below per year, ties, effect on its position."""
    keys = ["metric", *sides]
    mine = movement.where(F.col("entity").isin(focuses)).select(
        *keys,
        F.col("entity").alias("focus"),
        *[F.col(f"rank_{s}").alias(f"_focus_rank_{s}") for s in sides],
        *[F.col(f"key_{s}").alias(f"_focus_key_{s}") for s in sides],
    )
    rows = join_small(movement, mine, keys, len(focuses) * groups_bound, "inner")
    is_focus = F.col("entity") == F.col("focus")
    related = {s: relation(F.col(f"rank_{s}"), F.col(f"_focus_rank_{s}"), is_focus) for s in sides}
    rows = rows.select("*", *[c.alias(f"relation_{s}") for s, c in related.items()])
    above = {s: F.col(f"relation_{s}") == "above" for s in sides}
    status = F.col("status")
    if sides == SIDES_TWO:
        shown = F.when(status == "exited", F.col("relation_a")).otherwise(F.col("relation_b"))
        affects = F.when(status == "exited", above["a"]).when(status == "entered", above["b"]).otherwise(F.lit(False))
    else:
        shown = (
            F.when(F.col("rank_b").isNotNull(), F.col("relation_b"))
            .when(F.col("rank_m").isNotNull(), F.col("relation_m"))
            .otherwise(F.col("relation_a"))
        )
        affects = (status == "outside") & (above["a"] | above["m"] | above["b"])
    tied = {
        s: F.coalesce(~is_focus & (F.col(f"key_{s}") == F.col(f"_focus_key_{s}")), F.lit(False)) for s in sides
    }
    sided = F.array(*[F.col(f"relation_{s}") for s in sides])
    ordered = F.filter(sided, lambda r: r.isin("above", "below"))
    return rows.select(
        *keys, "focus", "entity", "status",
        *[f"rank_{s}" for s in sides], *[f"relation_{s}" for s in sides],
        shown.alias("relation"),
        affects.alias("affects_position"),
        F.when(status == "common", "not_applicable").when(affects, "affects_position").otherwise("denominator_only").alias("effect"),
        *[c.alias(f"tied_{s}") for s, c in tied.items()],
        (F.size(F.array_distinct(ordered)) > 1).alias("crossed"),
    )


def relation_condition(where: str, sides: tuple[str, ...] = SIDES_TWO) -> Column:
    """``above_a``, ``below_b``, ``above_all``, ``below_all``, ``crossed``, ``affects``, or ``outside_above_m`` and
    the like for rows outside the common set by one year's relation."""
    if where == "crossed":
        return F.col("crossed")
    if where == "affects":
        return F.col("affects_position")
    if where.startswith("outside_"):
        return (F.col("status") == "outside") & relation_condition(where.removeprefix("outside_"), sides)
    wanted, at = where.split("_", 1)
    return reduce(lambda x, y: x & y, [F.col(f"relation_{s}") == wanted for s in (sides if at == "all" else (at,))])


def filter_relations(rows: DataFrame, where: str, sides: tuple[str, ...] = SIDES_TWO) -> DataFrame:
    return rows.where(relation_condition(where, sides))


def relation_filters(rows: DataFrame, names: list[str], sides: tuple[str, ...] = SIDES_TWO) -> DataFrame:
    """The rows of several filters from one pass: a row comes once for each filter it passes."""
    passed = F.array_compact(F.array(*[F.when(relation_condition(n, sides), F.lit(n)) for n in names]))
    return rows.select(F.explode(passed).alias("filter"), "*")


def status_positions(rows: DataFrame, sides: tuple[str, ...] = SIDES_TWO, *, rows_bound: int | None = None) -> DataFrame:
    """Each entity's place in the list of its status, which goes by code, and its place there by its last rank."""
    group = ["metric", *sides, "status"]
    shown = F.coalesce(*[F.col(f"rank_{s}") for s in reversed(sides)]).cast("double")
    listed = rows.select(*group, "entity", shown.alias("_shown"), F.lit(0.0).alias("_same"))
    bound = group_bound(listed, group, rows_bound)
    by_rank = rank_rows(listed, group, "_shown", direction="ASC", rank="position_by_rank", total="_n", rows_bound=bound)
    placed = rank_rows(
        by_rank.drop("_shown", "_n"), group, "_same", direction="ASC", rank="position_in_status", total="n_status",
        rows_bound=bound,
    )
    return placed.drop("_same")


def summary_rows(rows: DataFrame) -> DataFrame:
    """Everything that is not common, and the focus."""
    return rows.where((F.col("status") != "common") | (F.col("entity") == F.col("focus")))


def relation_counts(rows: DataFrame, sides: tuple[str, ...] = SIDES_TWO) -> DataFrame:
    """How many entities stand in each relation to the focus."""
    return rows.groupBy("metric", *sides, "focus").agg(
        F.count_if(F.col("status") == "common").alias("common"),
        F.count_if(F.col("effect") == "affects_position").alias("affecting"),
        F.count_if(F.col("effect") == "denominator_only").alias("denominator_only"),
        F.count_if(F.col("crossed")).alias("crossed"),
        *[F.count_if(F.col(f"relation_{s}") == "above").alias(f"above_{s}") for s in sides],
        *[F.count_if(F.col(f"tied_{s}")).alias(f"tied_{s}") for s in sides],
    )


def sort_movement(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows without the value come last either way; ties go by code."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.orderBy(key, "entity")
