"""Registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

from convsignals.plans.catalog import corpus, files, learning, messages, outcomes, streams

FAMILIES = [messages, outcomes, corpus, learning, streams, files]


def all_queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
