"""All registered queries."""

from __future__ import annotations

from catalog import columns, frequency, plans, rates, recode, redistribution, reshape, sources

MODULES = (frequency, columns, recode, reshape, rates, redistribution, plans, sources)


def _resolved():
    """SQL texts that list the rule table are functions; a missing rule outline is an error."""
    for module in MODULES:
        for name, (run, sql) in module.QUERIES.items():
            yield name, (run, sql() if callable(sql) else sql)


ALL_QUERIES = dict(_resolved())
