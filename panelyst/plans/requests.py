"""The requests the registered queries run: years, focuses and entity pairs. All over whole tables."""

from __future__ import annotations

from panelyst.operators.movement import year_pairs, year_triples

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
PAIRS = year_pairs(YEARS)
TRIPLES = year_triples(YEARS)
A, M, B = 1996, 1998, 2000
FOCUS = "C000000007"
FOCUSES = ["C000000007", "C000000042", "C000000100"]
FOCUS_PART = "P000000010"
