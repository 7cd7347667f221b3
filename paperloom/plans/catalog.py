"""All queries of the package by name, and their SQL."""

from paperloom.plans import cards, gather, interest, labels, library, mentions, records, relational, second_stage, triage, vault  # noqa: F401
from paperloom.plans.registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
