"""All queries outside the optional subpackage."""

from __future__ import annotations

from locusframe.plans import files, intervals, scores, sequences, tables, tracks

MODULES = (tables, sequences, intervals, scores, tracks, files)


def queries():
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
