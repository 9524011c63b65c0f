"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in DataFrame operations only.

A text is cut into units: paragraphs, cut again at sentence ends and after ``UNIT`` characters so that an edit touches
few of them. Each unit is hashed to a wide vector of small numbers, and the vectors are summed modulo a power of two.
So the fingerprint does not depend on the units' order, units are added or removed by adding or subtracting their
vectors, and equal multisets have equal fingerprints. The difference of two fingerprints is the sum of the vectors of
the units that only one text has, and its mean square tells how many those are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

UNIT = 80
#: Lanes of the vector, two in each hash; a lane holds values of VALUE_BITS bits and is kept modulo 2**LANE_BITS.
LANES, VALUE_BITS, LANE_BITS = 64, 8, 16
HASHES = LANES // 2
MASK = 0x000000FF000000FF
MEAN, VARIANCE = (2**VALUE_BITS - 1) / 2, (4**VALUE_BITS - 1) / 12
#: Rows that are ordered together to find each document's next one.
GROUP_ROWS, MOST_GROUPS = 1024, 16384


def units(text: Column) -> Column:
    """The units of a text, in order; together they are the whole text."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n.!?]{{1,{UNIT}}}[\n.!?]*|[\n.!?]+"), F.lit(0))


def _hash(k: int) -> Column:
    """The k-th hash of a unit, from 128 bits of it: two lanes with room for eight million units."""
    return F.xxhash64(F.col("h1"), F.col("h2"), F.lit(k)).bitwiseAND(F.lit(MASK))


def vector_sums(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique for each row), ``n`` units and the ``lanes`` of the summed vectors, for each row of ``df``."""
    each = df.select(*keys, F.explode_outer(units(F.coalesce(text, F.lit("")))).alias("unit"))
    hashed = each.select(
        *keys, F.col("unit").isNotNull().alias("is_unit"), F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")
    )
    sums = [F.coalesce(F.sum(F.when(F.col("is_unit"), _hash(k))), F.lit(0)).alias(f"s{k}") for k in range(HASHES)]
    summed = hashed.groupBy(*keys).agg(F.count(F.when(F.col("is_unit"), 1)).alias("n"), *sums)
    lane = lambda x: F.pmod(x, F.lit(1 << LANE_BITS)).cast("int")
    lanes = [lane(F.col(f"s{k}")) for k in range(HASHES)] + [lane(F.shiftright(F.col(f"s{k}"), 32)) for k in range(HASHES)]
    return summed.select(*keys, "n", F.array(*lanes).alias("lanes"))


def combined(n1: Column, lanes1: Column, n2: Column, lanes2: Column, sign: int = 1) -> tuple[Column, Column]:
    """Units and lanes of two multisets together, or with ``sign`` -1 of the first without the second."""
    return n1 + sign * n2, F.zip_with(lanes1, lanes2, lambda a, b: F.pmod(a + sign * b, F.lit(1 << LANE_BITS)))


def written(n: Column, lanes: Column) -> Column:
    """A fingerprint as text: the number of units and the lanes, in hexadecimal."""
    digits = F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), LANE_BITS // 4, "0"))
    return F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), F.array_join(digits, ""))


def _size(n: Column, lanes: Column) -> Column:
    """The estimated sum of the squared multiplicities of a (signed) multiset.

    A lane is a sum modulo a power: take out the mean times n and square the representative nearest to 0. The mean is
    half a whole number, so everything is doubled.
    """
    whole = 2 << LANE_BITS
    near = lambda x: F.pmod(2 * x - F.lit(int(2 * MEAN)) * n + whole // 2, F.lit(whole)) - whole // 2
    total = F.aggregate(lanes, F.lit(0.0), lambda sum_, x: sum_ + near(x.cast("long")) * near(x.cast("long")))
    return total / (4 * VARIANCE * LANES)


def likeness(n1: Column, lanes1: Column, n2: Column, lanes2: Column) -> Column:
    """Estimated common share of two texts' units, 0 to 1; 1 for equal fingerprints."""
    both = _size(n1, lanes1) + _size(n2, lanes2)
    apart = _size(*combined(n1, lanes1, n2, lanes2, -1))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - apart) / F.greatest(both + apart, F.lit(1e-9))))
    return F.when((n1 == n2) & (lanes1 == lanes2), F.lit(1.0)).otherwise(share)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint, n_units, lanes`` for every row of ``docs``; null texts are empty ones.

    Rows that repeat an id and a text give one row; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"), "text")
    keys = ["doc_id", "n_chars", "digest"]
    once = vector_sums(named.dropDuplicates(["doc_id", "digest"]), keys, "text")
    return once.select("doc_id", "n_chars", written(F.col("n"), F.col("lanes")).alias("fingerprint"), F.col("n").alias("n_units"), "lanes")


def _range_starts(docs: DataFrame, group_rows: int) -> list[int]:
    """The least ids of ranges of about ``group_rows`` rows, ascending: at most MOST_GROUPS numbers."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    parts = max(1, min(MOST_GROUPS, -(-ids.count() // group_rows)))
    ranged = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least"))
    return sorted(r["least"] for r in ranged.collect()) or [0]


def _range(starts: list[int], step: int = 128) -> Column:
    """The index of the range that holds ``doc_id``, found in two steps; null ids belong to the first."""
    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("doc_id")))

    coarse = upto(F.lit(starts[::step])) - 1
    fine = upto(F.slice(F.lit(starts), F.greatest(coarse, F.lit(0)) * step + 1, F.lit(step))) - 1
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(coarse * step + fine, F.lit(0)))


def edited_fingerprints(docs: DataFrame, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by ascending id, after the last one the first. Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Null texts are empty; null ids come first; rows with one id are
    ordered by their texts; a single row is its own next. Other columns are not read; no rows give no rows.

    Rows are dealt out by ranges of ids, once; the first row of each range also goes to the range before it.
    """
    starts = _range_starts(docs, group_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("g", _range(starts))
    # A row that begins a range is also the next one of the last row of the range before.
    begins = (F.col("doc_id") == F.get(F.lit(starts), F.col("g"))) | F.col("doc_id").isNull()
    own = F.struct(F.col("g").alias("g"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("g") - 1, F.lit(len(starts))).alias("g"), F.lit(True).alias("ghost"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(begins, F.array(own, ghost)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.g", "to.ghost")
    ordered = Window.partitionBy("g").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed = dealt.select("*", F.row_number().over(ordered).alias("i"), F.lead("text").over(ordered).alias("next"))
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    named = placed.select("g", "i", "ghost", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    keys = ["g", "i", "ghost", "doc_id", "n_chars", "edited_sha256", "side"]
    sides = named.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "g", "i", "ghost", "doc_id", "n_chars", "edited_sha256",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("text").alias("of")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("of")),
        )).alias("s"),
    ).where("NOT (ghost AND s.side = 1)")
    sums = vector_sums(sides.select(*keys[:-1], "s.side", "s.of"), keys, "of")
    # Both sides of a row, and the next row's own side, stand next to each other within the range.
    line = Window.partitionBy("g").orderBy("i", "side")
    pair = sums.select(
        "*",
        *[F.lead(c, k).over(line).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "lanes")],
    ).where("side = 0 AND NOT ghost")
    return pair.select(
        "doc_id", "n_chars", "edited_sha256",
        written(F.col("n"), F.col("lanes")).alias("fingerprint"), written(F.col("n1"), F.col("lanes1")).alias("edited_fingerprint"),
        likeness(F.col("n"), F.col("lanes"), F.col("n1"), F.col("lanes1")).alias("near_edited"),
        likeness(F.col("n"), F.col("lanes"), F.col("n2"), F.col("lanes2")).alias("near_next"),
    )
