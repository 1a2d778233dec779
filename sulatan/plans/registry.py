"""All registered queries and their reference SQL."""

from __future__ import annotations

from sulatan.plans import boxes, lexicon, records, scoring, text

_MODULES = (text, lexicon, boxes, scoring, records)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
