"""Queries of the domain's operators over the mapped tables, and their reference SQL."""

from __future__ import annotations

from lymphframe.plans import aggregates, chain, files, functions, groups, more, noise, structures  # noqa: F401
from lymphframe.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
