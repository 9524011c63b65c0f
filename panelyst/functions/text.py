"""Code normalisation, decimal text, rank search and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelyst.functions.transforms import finite

DECIMAL_TEXT = r"^[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?$"
RANK_QUERY = r"^\s*#?(\d+)\s*$"

# fixed values: display scales
SCALES = {"trillions": (1e12, " trillion"), "billions": (1e9, " billion")}


def normalize_code(code: Column) -> Column:
    """Trimmed, upper-cased; blank becomes null."""
    return F.nullif(F.upper(F.trim(code)), F.lit(""))


def canonical_decimal(text: Column) -> Column:
    """The source's own spelling of a decimal when it is one, else null."""
    trimmed = F.trim(text)
    parsed = trimmed.try_cast("double")
    return F.when(trimmed.rlike(DECIMAL_TEXT) & finite(parsed), trimmed)


def decimal_or_shortest(text: Column, value: Column) -> Column:
    return F.coalesce(canonical_decimal(text), F.when(finite(value), value.cast("string")))


def search_match(query: Column, rank: Column, code: Column, name: Column) -> Column:
    """``100`` or ``#100`` asks for that rank; other text is looked up in code and name."""
    wanted = F.regexp_extract(query, RANK_QUERY, 1)
    text = F.lower(F.trim(query))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(True))
        .when(wanted != "", rank == wanted.try_cast("long"))
        .otherwise(
            F.contains(F.lower(code), text) | F.coalesce(F.contains(F.lower(name), text), F.lit(False))
        )
    )


# --- display only: never an input of a calculation, sort or tie check ----------------------------
def format_number(value: Column, decimals: int = 0) -> Column:
    # Round first: half-up on the decimal value, where format_number alone rounds half-even.
    return F.when(finite(value), F.format_number(F.round(value, decimals), decimals))


def format_value(value: Column, symbol: str = "", decimals: int = 0, scale: str | None = None) -> Column:
    if scale in SCALES:
        divisor, suffix = SCALES[scale]
        return F.concat(F.lit(symbol), format_number(value / divisor, 2), F.lit(suffix))
    return F.concat(F.lit(symbol), format_number(value, decimals))


def _signed(value: Column, suffix: str, decimals: int) -> Column:
    sign = F.when(value > 0, "+").otherwise("")
    return F.concat(sign, format_number(value, decimals), F.lit(suffix))


def format_percent(value: Column, decimals: int = 2) -> Column:
    return _signed(value, "%", decimals)


def format_points(value: Column, decimals: int = 2) -> Column:
    return _signed(value, " pp", decimals)


def format_index_points(value: Column, decimals: int = 2) -> Column:
    return _signed(value, " index pts", decimals)
