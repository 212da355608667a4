"""All queries of the library over the shared tables, with their SQL where SQL can express them."""

from __future__ import annotations

from . import alignments, events, intervals, pileups, popgen, reads, variants

MODULES = (intervals, popgen, alignments, pileups, reads, variants, events)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, (_, text) in module.QUERIES.items() if text}
