"""Every registered query and its SQL twin."""

from __future__ import annotations

from . import q_ingest, q_logs, q_rules, q_signals

MODULES = (q_logs, q_signals, q_rules, q_ingest)


def queries():
    found = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql():
    found = {}
    for module in MODULES:
        found |= module.SQL
    return found
