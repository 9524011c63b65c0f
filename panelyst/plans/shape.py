"""Last step of a registered query: fixed column order and rounding, so results compare by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DIGITS = 4
# Money divided by a power of two ends exactly on a half, which engines round either way. This
# factor moves such a value off the half; it is far below the digits kept.
NUDGE = 1.000000000001


def shaped(df: DataFrame, *columns: str) -> DataFrame:
    kept = df.select(*columns) if columns else df
    rounded = []
    for f in kept.schema.fields:
        if f.dataType.typeName() == "double":
            # Adding zero turns a negative zero into zero.
            rounded.append((F.round(F.col(f.name) * NUDGE, DIGITS) + 0.0).alias(f.name))
        else:
            rounded.append(F.col(f.name))
    return kept.select(*rounded)


def same_rounding(sql: str) -> str:
    """Give the SQL side the same nudge: every double there is rounded as ``round(x, 4)``."""
    return sql.replace(f", {DIGITS})", f" * {NUDGE:.12f}, {DIGITS})")
