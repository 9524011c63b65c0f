"""All registered queries."""

from __future__ import annotations

from panelyst.plans import bases, compare, movement, quality, ranking
from panelyst.plans.shape import same_rounding

MODULES = (ranking, movement, bases, compare, quality)
QUERIES = {
    name: (query, same_rounding(sql) if sql else None)
    for module in MODULES
    for name, (query, sql) in module.QUERIES.items()
}
