"""Small driver-side plans as one literal column.

A request's intervals or year pairs are a handful of rows. Passed as a single JSON literal they are
folded to a constant once, instead of growing the query tree by one expression per field.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def plan_rows(rows: list[dict], fields: str) -> Column:
    """An array of structs, e.g. ``plan_rows([{"a": 1}], "a int")``."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{struct_fields(fields)}>>")


def plan_map(rows: dict[str, list[dict]], fields: str) -> Column:
    """A map from a key to an array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"map<string,array<struct<{struct_fields(fields)}>>>")


def text_map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def struct_fields(fields: str) -> str:
    out = []
    for field in fields.split(";"):
        name, kind = field.strip().split(" ", 1)
        out.append(f"`{name}`:{kind}")
    return ",".join(out)
