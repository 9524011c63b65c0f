"""Which years an entity holds, as bits: one aggregate answers any number of completeness questions.

A bit stands for a year of ``span``; a word holds 62 of them, so spans of any length fit. A required set of years is
a mask, and whether an entity is a candidate, is complete or lacks years are tests of its words against that mask.
Entities that hold the same years are alike to every request, so counts are taken from the distinct patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyst.functions.transforms import finite

BITS = 62


def word_count(span: list[int]) -> int:
    return (max(span) - min(span)) // BITS + 1


def masks(span: list[int], years: list[int] | tuple[int, ...]) -> list[int]:
    """The words of a required set of years, all of which lie in ``span``."""
    words = [0] * word_count(span)
    for y in set(years):
        words[(y - min(span)) // BITS] |= 1 << ((y - min(span)) % BITS)
    return words


def presence(obs: DataFrame, metrics: list[str], span: list[int]) -> DataFrame:
    """``metric, entity, words``: the years of ``span`` with a finite value. An entity without any has no row."""
    place = F.col("year") - F.lit(min(span))
    bit = F.expr(f"shiftleft(1L, cast(pmod(year - {min(span)}, {BITS}) as int))")
    held = [F.bit_or(F.when(F.floor(place / BITS) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(word_count(span))]
    rows = obs.where(F.col("metric").isin(metrics) & F.col("year").isin(sorted(set(span))) & finite(F.col("value")))
    rows = rows.groupBy("metric", "entity").agg(*[c.alias(f"_w{w}") for w, c in enumerate(held)])
    return rows.select("metric", "entity", F.array(*[f"_w{w}" for w in range(word_count(span))]).alias("words"))


def patterns(held: DataFrame) -> DataFrame:
    """How many entities hold exactly the same years: ``metric, words, entities``."""
    return held.groupBy("metric", "words").agg(F.count("*").alias("entities"))


def held_count(words: Column, required: Column) -> Column:
    """How many of the required years are there."""
    return _bits(words, required, lambda w, r: w.bitwiseAND(r))


def missing_count(words: Column, required: Column) -> Column:
    return _bits(words, required, lambda w, r: r.bitwiseAND(F.bitwise_not(w)))


def _bits(words: Column, required: Column, meet) -> Column:
    return F.reduce(F.zip_with(words, required, lambda w, r: F.bit_count(meet(w, r))), F.lit(0), lambda n, k: n + k)


def years_not_held(words: Column, years: Column, first: int) -> Column:
    """Those of the ascending ``years`` whose bit is not set."""
    def there(y):
        place = y - F.lit(first)
        return F.getbit(F.get(words, F.floor(place / BITS).cast("int")), F.pmod(place, F.lit(BITS)).cast("int")) == 1

    return F.filter(years, lambda y: ~there(y))


def completeness(obs: DataFrame, metrics: list[str], span: list[int]) -> DataFrame:
    """Every entity's series against all years of ``span``: years held, whether all are, first and last, longest gap.

    ``longest_gap`` counts the missing years in a row between two held ones.
    """
    span = sorted(set(span))
    years = F.array(*[F.lit(y) for y in span])
    held = presence(obs, metrics, span).withColumn("_not", years_not_held(F.col("words"), years, span[0]))
    own = held.withColumn("_own", F.array_except(years, F.col("_not")))
    steps = F.transform(
        F.sequence(F.lit(2), F.size("_own")), lambda i: F.element_at("_own", i) - F.element_at("_own", i - 1) - 1
    )
    return own.select(
        "metric", "entity",
        F.size("_own").alias("years_held"),
        (F.size("_not") == 0).alias("complete"),
        F.get("_own", F.lit(0)).alias("first_year"),
        F.element_at("_own", -1).alias("last_year"),
        F.when(F.size("_own") > 1, F.array_max(steps)).otherwise(0).alias("longest_gap"),
    )


def first_complete(held: DataFrame, span: list[int]) -> DataFrame:
    """For each metric and start year: the entities that hold every year from there to the end of ``span``."""
    span = sorted(set(span))
    runs = F.array(*[
        F.struct(F.lit(y).alias("start"), F.array(*[F.lit(m).cast("long") for m in masks(span, span[i:])]).alias("mask"))
        for i, y in enumerate(span)
    ])
    laid = patterns(held).select("metric", "words", "entities", F.explode(runs).alias("_run"))
    whole = missing_count(F.col("words"), F.col("_run.mask")) == 0
    return laid.groupBy("metric", F.col("_run.start").alias("start")).agg(
        F.sum(F.when(whole, F.col("entities")).otherwise(0)).alias("entities")
    )
