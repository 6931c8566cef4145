"""All registered queries: importing the modules below fills QUERIES and ORACLES."""

from __future__ import annotations

from maploom.plans import ORACLES, QUERIES
from maploom.plans import aggregates, expectations, joins, memory, retrieval, scalars, sequences, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["r1_retrieve"](spark, sf_dir)
