"""Registered queries of the record jobs and their SQL oracles."""

from __future__ import annotations

import importlib

#: Modules of this package that have QUERIES and ORACLES.
MODULES = ["contests", "people", "facts", "feeds", "more", "messy", "intake", "filings", "deeper"]


def queries():
    found = {}
    for module in MODULES:
        found |= importlib.import_module(f"hustings.plans.{module}").QUERIES
    return found


def oracle_sql():
    found = {}
    for module in MODULES:
        found |= importlib.import_module(f"hustings.plans.{module}").ORACLES
    return found
